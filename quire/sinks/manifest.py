"""Content digests (SNK7, SNK8, SCL15).

``content_manifest`` is an order-free digest per group: every row's SHA-256 is cut into five numbers of up to 52 bits,
each summed as a decimal, so the digest does not depend on partitioning, file layout or row order, uses every bit of
the hash and is computed with one partial aggregate (map-side combine) per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.once import with_once


def item_text(c: Column) -> Column:
    """Length-prefixed, so that different items never join to the same text."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("N"))


def row_text(df: DataFrame, cols: Sequence[str]) -> Column:
    def one(name):
        if not isinstance(df.schema[name].dataType, T.ArrayType):
            return item_text(F.col(name))
        items = F.array_join(F.transform(name, item_text), "")
        return F.coalesce(F.concat(F.lit("A"), F.size(name).cast("string"), F.lit(":"), items), F.lit("N"))

    return F.concat(*[one(c) for c in cols])


def row_sha(df: DataFrame, cols: Sequence[str]) -> Column:
    """SCL15: SHA-256 hex of a row's fields."""
    return F.sha2(row_text(df, cols), 256)


def content_manifest(df: DataFrame, by: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """SNK8: per group: row count and the sums of the row hashes' parts (as text)."""
    h = with_once(df, {"_h": row_sha(df, list(cols or df.columns))}).select(*by, "_h")
    sums = [F.sum(F.conv(F.substring("_h", i, 13), 16, 10).cast("decimal(38,0)")).cast("string") for i in (1, 14, 27, 40, 53)]
    return h.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws("-", *sums).alias("digest"))


#: Files up to this size are read as one cell; larger ones are streamed.
CELL_BYTES = 128 << 20


def file_manifest(spark, path: str, glob: str = "*", cell_bytes: int = CELL_BYTES) -> DataFrame:
    """SNK7: (path, length, sha256), one SHA-256 per file under ``path`` (file names containing 'sha256' skipped), in the
    order of the paths.

    Small files are digested as one cell, in parallel.  A larger file's lines are read in splits, sorted back into their
    order (a sort that spills) and fed to one running digest, so a task holds a batch of lines whatever the file's size.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    files = reader.format("binaryFile").load(path)
    wanted = ~F.substring_index(F.col("path"), "/", -1).contains("sha256")
    small = files.filter(wanted & (F.col("length") <= cell_bytes)).select("path", "length", F.sha2("content", 256).alias("sha256"))
    # Names and sizes of the large files: as many as fit the data over cell_bytes.
    large = [r["path"] for r in files.filter(wanted & (F.col("length") > cell_bytes)).select("path").collect()]
    out = small.unionByName(streamed_digests(spark, large)) if large else small
    return out.unionByName(empty_files(files)).orderBy("path")


def empty_files(files: DataFrame) -> DataFrame:
    """(path, length, sha256) of the empty files among a reader's, whose rows it leaves out."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    listed = files.sparkSession.createDataFrame([(f,) for f in files.inputFiles()], "path string")
    listed = listed.select(plain("path").alias("path")).filter(~F.substring_index("path", "/", -1).contains("sha256"))
    there = files.select(plain("_metadata.file_path").alias("path"))
    return listed.join(there, "path", "left_anti").select(
        F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"), F.lit(0).cast("long").alias("length"),
        F.sha2(F.lit(b""), 256).alias("sha256"))


def streamed_digests(spark, paths: Sequence[str]) -> DataFrame:
    """(path, length, sha256) of files of any size; between two line ends may lie 2 GB at most."""
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
        F.col("value").cast("binary").alias("line"))

    def run(batches):
        import hashlib

        import pandas as pd

        at, size, digest, fed = None, 0, None, 0

        def done():
            # The reader leaves out line ends, and a byte-order mark at the start; the size tells what was there.
            if size - fed not in (0, 1):
                raise ValueError(f"{at}: {fed} of {size} bytes were read")
            if size - fed == 1:
                digest.update(b"\n")
            return pd.DataFrame([(at, size, digest.hexdigest())], columns=["path", "length", "sha256"])

        for pdf in batches:
            for path, length, lead, line in zip(pdf["path"], pdf["length"], pdf["lead"], pdf["line"]):
                if path != at:
                    if at:
                        yield done()
                    at, size, digest, fed = path, length, hashlib.sha256(), 0
                    digest.update(lead)
                    fed = len(lead)
                else:
                    digest.update(b"\n")
                    fed += 1
                digest.update(line)
                fed += len(line)
        if at:
            yield done()

    # A file that starts with a byte-order mark is three bytes longer than what the lines add up to.
    sums = lines.groupBy("path").agg(F.sum(F.octet_length("line") + 1).alias("n"))
    marked = lines.join(sums, "path").withColumn("lead", F.when(F.col("length") - F.col("n") >= 2, F.lit(b"\xef\xbb\xbf")).otherwise(
        F.lit(b"")))
    ordered = marked.repartition("path").sortWithinPartitions("path", "block", "row")
    return ordered.select("path", "length", "lead", "line").mapInPandas(run, "path string, length long, sha256 string")
