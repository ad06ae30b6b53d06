"""Order-dependent row operators without a one-task window (WIN5-WIN8, SMP2).

``with_global_index`` gives every row its dense position in a total order.
A window ``row_number()`` with no ``PARTITION BY`` would pull the whole table
into one task; instead rows are cut into order-preserving buckets, each
bucket is numbered by its own (parallel) window, and bucket offsets come
from a running sum over the small bucket-count table.  Rows per bucket are
bounded by the bucket width when the first order column is a unique integer
key, so no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import u

DEFAULT_WIDTH = 1 << 16
NULL_BUCKET = -(1 << 63)  # null order keys come first


def _bucket_of(order: Sequence[str], width: int) -> Column:
    return F.floor(F.col(order[0]) / F.lit(width)).cast("long")


def prefix_bits(col: str, n_bytes: int) -> Column:
    """The first ``n_bytes`` (7 at most) bytes of a string as a number, in the order of strings."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(col, "UTF-8"), 1, n_bytes)), 2 * n_bytes, "0"), 16, 10).cast("long")


def bucket_offsets(sizes: DataFrame, bucket: str, size: str, name: str, total: str | None = None,
                   levels: int = 2) -> DataFrame:
    """Exclusive running sum of ``size`` over buckets in order, by ``levels``: within groups of ``DEFAULT_WIDTH``
    neighbouring buckets, over the groups by groups of groups, and so on.  Only the topmost table is one task's window."""
    if levels == 1:
        cols = [F.col(bucket), F.coalesce(F.sum(size).over(Window.orderBy(bucket).rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias(name)]
        return sizes.select(*cols, *([F.sum(size).over(Window.partitionBy()).cast("long").alias(total)] if total else []))
    up, n, offset = f"_g{levels}", f"_g{levels}n", f"_g{levels}o"
    s = sizes.select(bucket, size, F.shiftright(bucket, 16).alias(up))
    groups = bucket_offsets(s.groupBy(up).agg(F.sum(size).alias(n)), up, n, offset, total, levels - 1)
    inside = Window.partitionBy(up).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    out = s.withColumn(n, F.coalesce(F.sum(size).over(inside), F.lit(0))).join(groups, up)
    return out.select(bucket, (F.col(offset) + F.col(n)).cast("long").alias(name), *([total] if total else []))


def with_global_index(df: DataFrame, order: Sequence[str], name: str = "row_idx",
                      bucket: Column | None = None, width: int = DEFAULT_WIDTH,
                      total: str | None = None, levels: int = 2) -> DataFrame:
    """Add ``name`` = 0-based position of the row when sorted by ``order``.

    ``order`` must be a unique row order.  ``bucket`` must be a non-decreasing
    function of ``order``; by default ``floor(order[0] / width)`` for an
    integral first column.  ``total`` (optional) adds the row count.  Buckets
    spread thinly over the numbers (such as prefixes) take more ``levels``.
    """
    b = bucket if bucket is not None else _bucket_of(order, width)
    d = df.withColumn("_gb", F.coalesce(b.cast("long"), F.lit(NULL_BUCKET).cast("long")))
    offsets = bucket_offsets(d.groupBy("_gb").agg(F.count(F.lit(1)).alias("_gn")), "_gb", "_gn", "_goff", total, levels)
    in_bucket = Window.partitionBy("_gb").orderBy(*order)
    return (d.withColumn("_grn", F.row_number().over(in_bucket))
            .join(offsets, "_gb")
            .withColumn(name, (F.col("_goff") + F.col("_grn") - 1).cast("long"))
            .drop("_gb", "_grn", "_goff"))


def cap_rows(df: DataFrame, cap: int, order: Sequence[str], bucket: Column | None = None,
             width: int = DEFAULT_WIDTH) -> DataFrame:
    """WIN8: the first ``min(n, cap)`` rows in ``order``.

    Bucket sizes give the bucket in which row ``cap`` lies (a scalar subquery); rows of earlier buckets pass a filter
    and only that bucket's rows are ranked, so the table is neither shuffled nor sorted.
    """
    if cap <= 0:
        return df.limit(0)
    b = bucket if bucket is not None else _bucket_of(order, width)
    d = df.withColumn("_gb", F.coalesce(b.cast("long"), F.lit(NULL_BUCKET).cast("long")))
    sizes = d.groupBy("_gb").agg(F.count(F.lit(1)).alias("_gn"))
    offsets = bucket_offsets(sizes, "_gb", "_gn", "_goff").join(sizes, "_gb")
    edge = F.min(F.when((F.col("_goff") < cap) & (F.col("_goff") + F.col("_gn") >= cap), F.struct(
        F.col("_gb").alias("b"), (F.lit(cap) - F.col("_goff")).alias("need"))))
    none = F.struct(F.lit((1 << 63) - 1).cast("long").alias("b"), F.lit(0).cast("long").alias("need"))
    e = offsets.agg(edge.alias("e")).select(F.coalesce("e", none)).scalar()
    rank = F.row_number().over(Window.partitionBy("_gb").orderBy(*order))
    last = d.filter(F.col("_gb") == e["b"]).withColumn("_r", rank).filter(F.col("_r") <= e["need"]).drop("_r")
    return d.filter(F.col("_gb") < e["b"]).unionByName(last).drop("_gb")


def assign_shard(df: DataFrame, n_shards: int, order: Sequence[str], name: str = "shard",
                 **kw) -> DataFrame:
    """WIN5: contiguous blocks of ``ceil(n / n_shards)`` rows (trailing shards may be empty)."""
    d = with_global_index(df, order, "_sh_idx", total="_sh_n", **kw)
    per = F.ceil(F.col("_sh_n") / F.lit(n_shards))
    return (d.withColumn(name, F.floor(F.col("_sh_idx") / per).cast("int"))
            .withColumn("shard_row", (F.col("_sh_idx") - F.col(name) * per).cast("long"))
            .drop("_sh_idx", "_sh_n"))


def assign_batch(df: DataFrame, size: int, order: Sequence[str], name: str = "batch",
                 **kw) -> DataFrame:
    """WIN6: batches of ``size`` rows in order, the last one possibly short."""
    d = with_global_index(df, order, "_bt_idx", **kw)
    return (d.withColumn(name, F.floor(F.col("_bt_idx") / F.lit(size)).cast("long"))
            .withColumn("batch_row", (F.col("_bt_idx") % F.lit(size)).cast("int"))
            .drop("_bt_idx"))


def head_split(df: DataFrame, pct: int, order: Sequence[str], name: str = "split",
               **kw) -> DataFrame:
    """WIN7: first ``pct`` percent of rows (rounded half up) is validation, the rest train."""
    d = with_global_index(df, order, "_hs_idx", total="_hs_n", **kw)
    cut = F.floor(F.col("_hs_n") * F.lit(pct) / F.lit(100) + F.lit(0.5))
    return (d.withColumn(name, F.when(F.col("_hs_idx") < cut, F.lit("validation")).otherwise(F.lit("train")))
            .drop("_hs_idx", "_hs_n"))


def split_if_missing(df: DataFrame, pct: int, order: Sequence[str], name: str = "split", **kw) -> DataFrame:
    """WIN7's rule over loaded splits: where no row is of a validation split, the first ``pct`` percent of the train
    rows become one; otherwise every row keeps its split."""
    has = df.filter(F.col(name) == "validation").agg(F.count(F.lit(1))).scalar()
    train = head_split(df.filter(F.col(name) == "train").drop(name), pct, order, "_new", **kw)
    train = train.withColumn(name, F.when(has > 0, F.lit("train")).otherwise(F.col("_new"))).select(*df.columns)
    return train.unionByName(df.filter(F.coalesce(F.col(name) != "train", F.lit(True))))


def shuffle_rows(df: DataFrame, key: Sequence[str], seed, task: str = "shuffle",
                 name: str = "position", n_buckets: int = 1 << 20) -> DataFrame:
    """SMP2: a reproducible permutation; ``name`` is the row's new position."""
    d = df.withColumn("_sh_u", u(seed, task, key, "shuffle"))
    bucket = F.floor(F.col("_sh_u") * F.lit(n_buckets)).cast("long")
    return with_global_index(d, ["_sh_u", *key], name, bucket=bucket).drop("_sh_u")
