"""Encoding by chunk dictionaries (TOK1).

``code_tokens`` reads every text once: a task cuts its rows into chunks of about ``CHUNK_TOKENS`` tokens, numbers each
chunk's distinct tokens in order of appearance and writes the rows as arrays of those numbers, and the chunk's tokens
with their counts.  What is shuffled afterwards is a row per chunk and distinct token, not per occurrence: counts are
added up from it (``token_counts``), and ``encode_coded`` joins it once to the vocabulary, carries the ids back as one
array per chunk and looks the numbers up by position inside the row.

The numbering needs a hash map per chunk, which no built-in function keeps, so it runs in Arrow batches
(``mapInArrow``); key columns pass through as they are.  A text longer than a chunk makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import stored

CHUNK_TOKENS = 1 << 20


@dataclass
class Coded:
    """``rows``: the key columns, ``_chunk`` and an array of codes per text; ``tokens``: (_chunk, _code, token, count).
    ``texts`` names the arrays."""

    rows: DataFrame
    tokens: DataFrame
    texts: list[str]


def code_tokens(df: DataFrame, key: Sequence[str], texts: dict[str, str], pattern: str,
                chunk_tokens: int = CHUNK_TOKENS) -> Coded:
    """Tokens of the text columns (output name -> column) as codes of their chunk; a null text has no tokens."""
    key, names = list(key), list(texts)
    source = df.select(*key, *[F.col(c).alias(f"_text_{n}") for n, c in texts.items()])
    codes = T.ArrayType(T.IntegerType())
    schema = T.StructType([*source.select(*key).schema.fields, T.StructField("_chunk", T.LongType()),
                           *[T.StructField(n, codes) for n in names],
                           T.StructField("_tokens", T.ArrayType(T.StringType())),
                           T.StructField("_counts", T.ArrayType(T.LongType()))])
    # Key columns may be null in a chunk's row of tokens.
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import regex
        from pyspark import TaskContext

        class Numbers(dict):
            def __missing__(self, token):
                self[token] = n = len(self)
                return n

        find = regex.compile(pattern).findall
        chunk, number, held = TaskContext.get().partitionId() << 32, Numbers(), 0
        counts = np.zeros(0, dtype=np.int64)

        def listed(parts):
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))

        for batch in batches:
            columns = [batch.column(i) for i in range(len(key))]
            at, n_rows = 0, batch.num_rows
            texts_of = [batch.column(len(key) + i).to_pylist() for i in range(len(names))]
            parts: list[list] = [[] for _ in names]
            for r in range(n_rows):
                for i, values in enumerate(texts_of):
                    found = find(values[r]) if values[r] else []
                    part = np.fromiter(map(number.__getitem__, found), np.int32, len(found))
                    parts[i].append(part)
                    held += len(part)
                if held >= chunk_tokens or r == n_rows - 1:
                    rows = [c.slice(at, r + 1 - at) for c in columns]
                    n = r + 1 - at
                    flat = np.concatenate([p for ps in parts for p in ps]) if n else np.zeros(0, np.int32)
                    more = np.bincount(flat, minlength=len(number)).astype(np.int64)
                    more[:len(counts)] += counts
                    counts = more
                    nothing = [pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(
                        [*rows, pa.array(np.full(n, chunk)), *map(listed, parts), *nothing], schema.names)
                    at, parts = r + 1, [[] for _ in names]
                    if held >= chunk_tokens:
                        yield tokens_row(pa, columns, chunk, number, counts)
                        chunk, number, held, counts = chunk + 1, Numbers(), 0, np.zeros(0, dtype=np.int64)
        if number:
            yield tokens_row(pa, columns, chunk, number, counts)

    def tokens_row(pa, columns, chunk, number, counts):
        empty = [pa.nulls(1, c.type) for c in columns]
        return pa.RecordBatch.from_arrays(
            [*empty, pa.array([chunk]), *[pa.nulls(1, pa.list_(pa.int32())) for _ in names],
             pa.array([list(number)], pa.list_(pa.string())), pa.array([counts.tolist()], pa.list_(pa.int64()))],
            schema.names)

    table = stored(source.mapInArrow(run, schema), "coded-tokens")
    rows = table.where(F.col("_tokens").isNull()).select(*key, "_chunk", *names)
    each = F.posexplode(F.arrays_zip("_tokens", "_counts")).alias("_code", "_t")
    tokens = table.where(F.col("_tokens").isNotNull()).select("_chunk", each).select(
        "_chunk", "_code", F.col("_t._tokens").alias("token"), F.col("_t._counts").alias("count"))
    return Coded(rows, tokens, names)


def token_counts(coded: Coded) -> DataFrame:
    """(token, count) over all texts."""
    return coded.tokens.groupBy("token").agg(F.sum("count").alias("count"))


def chunk_ids(coded: Coded, vocab: DataFrame, unknown: int) -> DataFrame:
    """(_chunk, _ids): the ids of a chunk's tokens, by code."""
    known = coded.tokens.select("_chunk", "_code", "token").join(
        vocab.select("token", F.col("id").cast("int").alias("_id")), "token", "left")
    pair = F.struct("_code", F.coalesce("_id", F.lit(unknown)).alias("_id"))
    return known.groupBy("_chunk").agg(F.transform(F.array_sort(F.collect_list(pair)), lambda s: s["_id"]).alias("_ids"))


def encode_coded(coded: Coded, vocab: DataFrame, unknown: int) -> DataFrame:
    """The key columns and an array of ids per text."""
    joined = coded.rows.join(chunk_ids(coded, vocab, unknown), "_chunk", "left")
    # A chunk without any token has no row of ids, and its arrays are empty.
    ids = {n: F.transform(F.col(n), lambda c: F.get(F.col("_ids"), c)) for n in coded.texts}
    return joined.withColumns(ids).drop("_chunk", "_ids")
