"""File sources (SRC1-SRC9) with explicit schemas.

Whole-document JSON (an array, an object keyed by id, an array of arrays) is
read in parallel too, see ``json_documents``.  Everything after the parse is
ordinary columnar work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_documents import DIALOGUE_TURN, read_conversations, read_json_array, read_keyed_json  # noqa: F401

INSTRUCTION_SCHEMA = T.StructType([
    T.StructField("input", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("answer_choices", T.ArrayType(T.StringType())),
    T.StructField("task_type", T.StringType()),
    T.StructField("task_dataset", T.StringType()),
    T.StructField("sample_id", T.StringType()),
])

BOM = "\ufeff"


def read_jsonl(spark: SparkSession, path, schema: T.StructType = INSTRUCTION_SCHEMA) -> DataFrame:
    """SRC1: JSON Lines with an explicit schema."""
    return spark.read.schema(schema).json(path)


def read_tsv_pairs(spark: SparkSession, path, names: list[str], types: list[str], strip: bool = True) -> DataFrame:
    """SRC5: positional TSV without header or quoting; fields cast by position.

    The source kept the line end in the last field; ``strip=True`` removes it.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", False).csv(path)
    cols = []
    for n, t in zip(names, types):
        c = F.col(n)
        if strip:
            c = F.regexp_replace(c, "^[\r\n]+|[\r\n]+$", "")
        cols.append(c.cast(t).alias(n))
    return df.select(*cols)


FORMATS = {"csv": "csv", "json": "json", "txt": "text"}


def read_by_extension(spark: SparkSession, train: str | None = None, validation: str | None = None,
                      schema: T.StructType | None = None, keep_linebreaks: bool = True) -> DataFrame:
    """SRC6: csv / json / txt chosen by the file extension; other extensions and no input raise.

    Returns one DataFrame with a ``split`` column (train / validation).
    """
    files = {k: v for k, v in (("train", train), ("validation", validation)) if v}
    if not files:
        raise ValueError("need a train or a validation file")
    out = None
    for split, path in files.items():
        ext = path.rsplit(".", 1)[-1]
        if ext not in FORMATS:
            raise ValueError(f"{split} file should be a csv, a json or a txt file, got {ext!r}")
        if ext == "txt":
            df = read_text(spark, path, keep_linebreaks)
        else:
            r = spark.read
            if schema is not None:
                r = r.schema(schema)
            df = r.option("header", True).csv(path) if ext == "csv" else r.json(path)
        df = df.withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_text(spark: SparkSession, path, keep_linebreaks: bool = True) -> DataFrame:
    """SRC7: one row per line; ``keep_linebreaks`` puts the newline back."""
    df = spark.read.text(path)
    return df.withColumn("text", F.concat("value", F.lit("\n")) if keep_linebreaks else F.col("value")).drop("value")


def read_splits(spark: SparkSession, directory: str, schema: T.StructType = INSTRUCTION_SCHEMA,
                splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """SRC8: ``<dir>/<split>.json`` (JSON Lines) files, on any file system, with a literal ``split`` column."""
    out = None
    for s in splits:
        p = f"{directory.rstrip('/')}/{s}.json"
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
            df = read_jsonl(spark, p, schema).withColumn("split", F.lit(s))
            out = df if out is None else out.unionByName(df)
    if out is None:
        raise FileNotFoundError(f"no split files under {directory}")
    return out


def drop_bom_rows(df: DataFrame, col: str = "value") -> DataFrame:
    """SRC9: drop raw lines that carry a byte-order mark inside the line."""
    return df.filter(~F.col(col).contains(BOM))


def read_jsonl_text(spark: SparkSession, path, schema: T.StructType, drop_bom: bool = True) -> DataFrame:
    """Raw JSON Lines read through text so BOM lines can be dropped before parsing (SRC1 + SRC9)."""
    raw = spark.read.text(path)
    if drop_bom:
        raw = drop_bom_rows(raw)
    return raw.select(F.from_json("value", schema).alias("r")).select("r.*")
