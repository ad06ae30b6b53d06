"""Large JSON documents read in parallel (SRC2, SRC3, SRC4).

A JSON array or object is one value, but its elements are rows.  The document is read as text cut at commas, which the
file source does in parallel splits, on any file system.  Whether a comma separates two elements depends on all that
comes before it: on being outside a string and at depth 1.  Quotes that are not escaped flip the one, brackets outside
strings change the other, and an escape never spans a comma; so a first pass reduces every split, for both states it may
start in, to its number of quotes, its change of depth and its commas by depth.  The driver adds these up, a few numbers
per split as in the scheduler's own list of tasks, and the second pass starts each split in its true state.  Elements
that lie within a split are done there; only the pieces of those that cross a border are shuffled and joined.

Scanning is vectorised over the bytes of Arrow batches.  A compressed file that can't be split is one task's work.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIALOGUE_TURN = T.StructType([T.StructField("id", T.StringType()), T.StructField("Sentence", T.StringType())])
_SPLIT = "file_hash long, block long"


def _fragments(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("lineSep", ",").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file_hash"), F.col("_metadata.file_block_start").alias("block"), "value")


def _scanned(values, inside: bool):
    """(inside, depth) before every fragment of an Arrow string array and after the last: whether a string is open, and
    the depth relative to the first fragment's."""
    import numpy as np

    offsets = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset:values.offset + len(values) + 1]
    raw = values.buffers()[2]
    if raw is None or offsets[-1] == offsets[0]:
        return np.full(len(values) + 1, inside), np.zeros(len(values) + 1, dtype=np.int64)
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    quote = data == ord('"')
    back = data == ord("\\")
    if back.any():
        at = np.arange(len(data))
        plain = np.maximum.accumulate(np.where(back, -1, at))  # the last byte up to here that is no backslash
        run = np.concatenate([[0], (at - plain)[:-1]])
        quote &= run % 2 == 0
    flips = np.concatenate([[0], np.cumsum(quote)])
    opened = (flips % 2 == 1) ^ inside
    lower = data | 0x20  # "[" and "{", "]" and "}" differ in this bit alone
    step = (lower == ord("{")).astype(np.int64) - (lower == ord("}"))
    step[opened[:-1]] = 0
    depth = np.concatenate([[0], np.cumsum(step)])
    return opened[offsets], depth[offsets]


def _runs(batch):
    """(file_hash, block, fragments) of the splits in an Arrow batch, in order."""
    import numpy as np

    file_hash, block = (batch.column(i).to_numpy() for i in (0, 1))
    new = np.flatnonzero((file_hash[1:] != file_hash[:-1]) | (block[1:] != block[:-1])) + 1
    for a, b in zip([0, *new], [*new, batch.num_rows]):
        yield int(file_hash[a]), int(block[a]), batch.column(2).slice(a, b - a)


def _split_summaries(fragments: DataFrame) -> DataFrame:
    """(file_hash, block, inside, ends_inside, change, depths, counts): a split that starts inside a string or not."""
    schema = _SPLIT + ", inside boolean, ends_inside boolean, change long, depths array<long>, counts array<long>"

    def run(batches):
        import pyarrow as pa

        at, states = None, {}

        def done():
            rows = [(*at, s, inside, depth, list(commas), list(commas.values())) for s, (inside, depth, commas) in states.items()]
            columns = list(zip(*rows))
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["file_hash", "block", "inside", "ends_inside", "change", "depths", "counts"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

        for batch in batches:
            for file_hash, block, values in _runs(batch) if batch.num_rows else ():
                if at != (file_hash, block):
                    if at:
                        yield done()
                    at, states = (file_hash, block), {s: (s, 0, Counter()) for s in (False, True)}
                for s, (inside, depth, commas) in states.items():
                    opened, depths = _scanned(values, inside)
                    commas.update((depths[:-1][~opened[:-1]] + depth).tolist())
                    states[s] = (bool(opened[-1]), depth + int(depths[-1]), commas)
        if at:
            yield done()

    return fragments.mapInArrow(run, schema)


def _starts(summaries) -> dict[tuple[int, int], tuple[bool, int, int]]:
    """(inside, depth, elements begun) at the start of every split."""
    by_split: dict[int, dict[int, dict[bool, object]]] = {}
    for r in summaries:
        by_split.setdefault(r["file_hash"], {}).setdefault(r["block"], {})[r["inside"]] = r
    out = {}
    for file_hash, blocks in by_split.items():
        inside, depth, begun = False, 0, 0
        for block in sorted(blocks):
            out[file_hash, block] = (inside, depth, begun)
            r = blocks[block][inside]
            begun += dict(zip(r["depths"], r["counts"])).get(1 - depth, 0)
            inside, depth = r["ends_inside"], depth + r["change"]
    return out


def read_elements(spark: SparkSession, path) -> DataFrame:
    """(file, element, text): the elements of JSON arrays, the ``"key": value`` entries of JSON objects, one document per
    file, numbered from 0.  Two passes over the files; the first runs at once."""
    fragments = _fragments(spark, path)
    starts = _starts(_split_summaries(fragments).collect())
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file")).withColumn(
        "file_hash", F.xxhash64("file"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def rows(found):
            columns = list(zip(*found)) if found else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                              ["file_hash", "block", "element", "whole", "text"])

        at, held, whole = None, [], False
        inside = depth = element = 0
        for batch in batches:
            found = []

            def close(whole_end):
                if held:
                    found.append((*at, element, whole and whole_end, ",".join(held)))

            for file_hash, block, values in _runs(batch) if batch.num_rows else ():
                if at != (file_hash, block):
                    close(False)  # goes on in the file's next split, or is its last element
                    at, held, whole = (file_hash, block), [], False
                    inside, depth, begun = starts[at]
                    element = begun
                opened, depths = _scanned(values, inside)
                texts = values.to_pylist()
                begins = np.flatnonzero(~opened[:-1] & (depths[:-1] + depth == 1)).tolist()
                last = 0
                for b in begins:
                    held += texts[last:b]
                    close(True)
                    held, whole, last, element = [], True, b, element + 1
                held += texts[last:]
                inside, depth = bool(opened[-1]), depth + int(depths[-1])
            if found:
                yield rows(found)
        if held:
            yield rows([(*at, element, False, ",".join(held))])

    pieces = fragments.mapInArrow(run, _SPLIT + ", element long, whole boolean, text string")
    whole = pieces.where("whole").select("file_hash", "element", "text")
    parts = pieces.where("not whole").groupBy("file_hash", "element").agg(
        F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p")).select("file_hash", "element", F.array_join(
            F.transform("p", lambda s: s["text"]), ",").alias("text"))
    # The first element comes after the document's bracket, the last before its end; both are pieces, never whole.
    end = F.regexp_replace(F.when(F.col("element") == 0, F.regexp_replace("text", "^[\\ufeff\\s]*[\\[{]", "")).otherwise(
        F.col("text")), "^\\s+|\\s+$", "")
    last = F.max("element").over(Window.partitionBy("file_hash"))
    parts = parts.withColumn("text", F.when(F.col("element") == last, F.regexp_replace(end, "\\s*[\\]}]$", "")).otherwise(end))
    return whole.unionByName(parts).join(files, "file_hash").where(F.trim("text") != "").select("file", "element", "text")


def read_json_array(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """SRC2: a JSON array document; each element is a row."""
    return read_elements(spark, path).select(F.from_json("text", schema).alias("r")).select("r.*")


def read_keyed_json(spark: SparkSession, path, value_schema: T.DataType, item_field: str | None = None) -> DataFrame:
    """SRC3: a JSON object keyed by id -> (key, value); ``item_field`` explodes a list inside the value."""
    entry = F.from_json(F.concat(F.lit("{"), F.col("text"), F.lit("}")), T.MapType(T.StringType(), value_schema))
    out = read_elements(spark, path).select(F.explode(entry).alias("key", "value"))
    if item_field:
        out = out.select("key", F.posexplode(F.col(f"value.{item_field}")).alias("pos", "item"))
    return out


def read_conversations(spark: SparkSession, path, turn_schema: T.StructType = DIALOGUE_TURN) -> DataFrame:
    """SRC4: an array of conversations (arrays of turns) -> (file, conv, turn, turn fields...)."""
    turns = F.from_json("text", T.ArrayType(turn_schema))
    return read_elements(spark, path).select("file", F.col("element").cast("int").alias("conv"), F.posexplode(turns).alias(
        "turn", "t")).select("file", "conv", "turn", "t.*")
