"""Exact top-k inner-product search: columnar branch and bound.

Candidates lie in blocks of ``BLOCK_ROWS`` vectors, stored vertically: one matrix per group of dimensions.  For a query
the products of the first dimensions are accumulated for the whole block; the best partial sums are finished at once
and give a threshold; a candidate whose partial sum plus the remaining-mass bound (product of the norms of what is left,
by Cauchy and Schwarz) lies under it is dropped, the others are compacted, and the next dimensions follow.

Every candidate block meets every query block once: query blocks are replicated to the candidate blocks and streamed
past them, so a task holds one block of each.  Each pair of blocks returns the best k per query; a rank over those
gives the result.

Defined cases: a vector that is null or holds a null or non-finite component takes no part, nor does a null vec_id;
shorter vectors are as if padded with zeros; rows that repeat a vec_id are candidates each, and the least vector of a
repeated id is its query; ties go to the smaller vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK_ROWS = 8192
QUERY_ROWS = 256
DIMENSIONS = 16


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, v): floor(scale * component) as long, of the rows that take part."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(
        float("inf"))))
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(vec_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")).alias("v"))


def blocks(vectors: DataFrame, rows: int, dim: int, n: int) -> DataFrame:
    """(block, ids, data): ``rows`` vectors on average, packed as 64-bit integers, dimension by dimension."""

    def one(key, pdf):
        pdf = pdf.sort_values("id", ignore_index=True)
        data = np.zeros((len(pdf), dim), dtype="<i8")
        for i, v in enumerate(pdf["v"]):
            data[i, :len(v)] = v
        return pd.DataFrame({"block": [key[0]], "ids": [pdf["id"].to_numpy("<i8").tobytes()],
                             "data": [np.ascontiguousarray(data.T).tobytes()]})

    block = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(max(1, -(-n // rows)))).cast("int")
    return vectors.withColumn("block", block).groupBy("block").applyInPandas(
        one, "block int, ids binary, data binary")


class Columns:
    """A candidate block in vertical layout with the mass that remains after each group of dimensions."""

    def __init__(self, ids: bytes, data: bytes, dim: int, width: int = DIMENSIONS):
        self.ids = np.frombuffer(ids, dtype="<i8")
        whole = np.frombuffer(data, dtype="<i8").reshape(dim, len(self.ids))
        self.exact = whole
        most = int(np.abs(whole).max(initial=0))
        self.most = most
        self.parts = [np.ascontiguousarray(whole[a:a + width].T, dtype=np.float64) for a in range(0, dim, width)]
        self.rest = remaining(whole, width)


def remaining(whole: np.ndarray, width: int) -> list[np.ndarray]:
    square = np.cumsum((whole[::-1].astype(np.float64)) ** 2, axis=0)[::-1]
    dim = len(whole)
    return [np.sqrt(square[a]) if a < dim else np.zeros(whole.shape[1]) for a in range(width, dim + width, width)]


def search_block(cands: Columns, query_ids: np.ndarray, queries: np.ndarray, k: int,
                 width: int = DIMENSIONS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of the k best candidates of one block, for each column of ``queries``."""
    dim = len(queries)
    # Sums of products stay exact in doubles below 2 ** 53; beyond, 64-bit integers are multiplied without bounds.
    small = cands.most * int(np.abs(queries).max(initial=0)) * max(1, dim) < 1 << 52
    if dim == 0 or not small:
        for j, q in enumerate(query_ids.tolist()):
            scores = (cands.exact * queries[:, j:j + 1]).sum(axis=0) if dim else np.zeros(len(cands.ids), np.int64)
            yield best(q, cands.ids[cands.ids != q], scores[cands.ids != q], k)
        return
    parts = [queries[a:a + width].astype(np.float64) for a in range(0, dim, width)]
    rest = remaining(queries, width)
    opening = cands.parts[0] @ parts[0]
    for j, q in enumerate(query_ids.tolist()):
        sums = opening[:, j]
        live = np.flatnonzero(cands.ids != q)
        sums = sums[live]
        if len(live) > 4 * k and len(parts) > 1:
            # Finish the most promising ones: the k-th best of them is a threshold for all.
            first = live[np.argpartition(-sums, 4 * k)[:4 * k]]
            full = opening[first, j]
            for p in range(1, len(parts)):
                full = full + cands.parts[p][first] @ parts[p][:, j]
            floor = np.partition(full, len(full) - k)[len(full) - k]
            for p in range(1, len(parts)):
                bound = sums + cands.rest[p - 1][live] * rest[p - 1][j]
                keep = bound + 1e-9 * np.abs(bound) + 1e-6 >= floor
                live, sums = live[keep], sums[keep]
                sums = sums + cands.parts[p][live] @ parts[p][:, j]
        else:
            for p in range(1, len(parts)):
                sums = sums + cands.parts[p][live] @ parts[p][:, j]
        yield best(q, cands.ids[live], np.rint(sums).astype(np.int64), k)


def best(query: int, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return query, ids[order], scores[order]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score); both inputs are (id, v) as ``integer_vectors`` gives them."""
    cands = stored(candidates, "topk-candidates")
    asked = stored(queries.groupBy("id").agg(F.min("v").alias("v")), "topk-queries")
    n, dim = cands.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_asked, dim_asked = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dim = max(dim, dim_asked)
    held = blocks(cands, block_rows, dim, n).withColumn("kind", F.lit(0))
    n_blocks = max(1, -(-n // block_rows))
    streamed = blocks(asked, QUERY_ROWS, dim, n_asked).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("kind", F.lit(1))

    def run(batches):
        here: Columns | None = None
        at = None
        for pdf in batches:
            for block, ids, data, kind in zip(pdf["block"], pdf["ids"], pdf["data"], pdf["kind"]):
                if kind == 0:
                    here, at = Columns(ids, data, dim), block
                elif at == block:
                    asked_ids = np.frombuffer(ids, dtype="<i8")
                    found = list(search_block(here, asked_ids, np.frombuffer(data, dtype="<i8").reshape(
                        dim, len(asked_ids)), k))
                    yield pd.DataFrame({"query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]),
                                        "vec_id": np.concatenate([f[1] for f in found]),
                                        "score": np.concatenate([f[2] for f in found])})

    pairs = held.unionByName(streamed).repartition(n_blocks, "block").sortWithinPartitions("block", "kind")
    found = pairs.mapInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
