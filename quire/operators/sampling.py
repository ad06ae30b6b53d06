"""Sampling and random list edits (SMP1, SMP3-SMP6).

``sample_k`` is an exact k-of-N sample without replacement and without a
global sort: rows are ranked by a keyed draw ``u``; a histogram of ``u`` over
2**20 buckets (a small table, aggregated map-side) finds the bucket where the
running count reaches k; whole buckets below it are kept and only that one
bucket (about N / 2**20 rows) is ranked.  The draws and keys are stored once,
the key columns alone, and histogram and cut read that table; so the input is
evaluated once for its keys and once for its rows, which are filtered without
a join, a broadcast or a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import u
from ..scratch import stored

SAMPLE_BUCKETS = 1 << 20


def sample_k(df: DataFrame, key: Sequence[str], seed, task: str, k: int | None = None,
             fraction: float | None = None, n_buckets: int = SAMPLE_BUCKETS) -> DataFrame:
    """SMP1: exactly ``k`` rows (or ``floor(fraction * N)``) with the smallest draws; a larger k than N fails."""
    if (k is None) == (fraction is None):
        raise ValueError("give exactly one of k or fraction")
    key = list(key)
    d = df.withColumn("_su", u(seed, task, key, "sample"))
    order = F.struct(F.col("_su"), *[F.col(c) for c in key])
    keys = stored(d.select("_su", *key, F.floor(F.col("_su") * F.lit(n_buckets)).cast("int").alias("_sb")), "sample-keys")
    hist = keys.groupBy("_sb").agg(F.count(F.lit(1)).alias("_sn"))
    upto = Window.orderBy("_sb").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(1))
    cum = hist.select("_sb", "_sn", F.sum("_sn").over(upto).alias("_sc"), F.sum("_sn").over(every).alias("_st"))
    want = F.lit(k).cast("long") if k is not None else F.floor(F.col("_st") * F.lit(float(fraction))).cast("long")
    hit = F.min(F.when((F.col("_sc") >= want) & (want > 0), F.struct(
        F.col("_sb").alias("b"), (want - F.col("_sc") + F.col("_sn")).alias("need"))))
    total = F.coalesce(F.max("_st"), F.lit(0))
    edge = cum.agg(hit.alias("hit"), total.alias("total"))
    if k is not None:
        edge = edge.withColumn("hit", F.when(F.col("total") < k, F.raise_error(F.concat(F.lit(
            f"sample_k({task}): k={k} is larger than the population "), F.col("total").cast("string"))).cast(
            "struct<b:int,need:bigint>")).otherwise(F.col("hit")))
    edge = edge.select("hit.b", "hit.need")
    at_edge = keys.select(F.col("_sb").alias("b"), order.alias("o")).join(edge, "b")
    rank = F.row_number().over(Window.partitionBy("b").orderBy("o"))
    cut = at_edge.withColumn("r", rank).filter(F.col("r") <= F.col("need")).agg(F.max("o").alias("cut")).scalar()
    return d.filter(order <= cut).drop("_su")


def random_insert(arr: Column, items: Column, seed, task: str, key: Sequence[str],
                  draw: str = "ins") -> Column:
    """SMP3: insert items one by one, each at ``randint(0, len(list))``.

    Sequential: each insert sees the list grown by the previous ones.
    """
    indexed = F.transform(items, lambda x, i: F.struct(x.alias("v"), i.alias("i")))

    def step(acc, it):
        pos = F.floor(u(seed, task, key, F.concat(F.lit(draw), it["i"].cast("string")))
                      * (F.size(acc) + 1)).cast("int")
        return F.concat(F.slice(acc, 1, pos), F.array(it["v"]),
                        F.slice(acc, pos + 1, F.size(acc) + 1))

    return F.aggregate(indexed, arr, step)


def insert_before_last(arr: Column, item: Column, unit: Column) -> Column:
    """SMP4: insert at ``randint(0, len-1)`` so never last; an empty list gets the item alone."""
    pos = F.floor(unit * F.size(arr)).cast("int")
    inserted = F.concat(F.slice(arr, 1, pos), F.array(item), F.slice(arr, pos + 1, F.size(arr) + 1))
    return F.when(F.size(arr) < 1, F.array(item)).otherwise(inserted)


DRAW_BUCKETS = 1024


def draw_size(df: DataFrame, dist: DataFrame, unit: Column, name: str, value: str = "n",
              cumulative: str = "cumulative") -> DataFrame:
    """SMP5 with the distribution as a table: adds ``name``, the value whose range of cumulative probability holds
    ``unit``.  Ranges and draws meet in buckets of the unit interval (an equi join plus the range test), so the
    distribution may have any number of values.  It has a row per distinct value and bucket, whatever the number of
    rows, so it is sent to them; the rows, with their texts, stay where they are."""
    order = Window.orderBy(value)
    ranges = dist.select(F.col(value).alias(name), F.coalesce(F.lag(cumulative).over(order), F.lit(0.0)).alias("_lo"),
                         F.when(F.lead(cumulative).over(order).isNull(), F.lit(2.0)).otherwise(F.col(cumulative)).alias("_hi"))
    at = lambda x: F.least(F.floor(x * DRAW_BUCKETS), F.lit(DRAW_BUCKETS - 1)).cast("int")
    ranges = ranges.withColumn("_b", F.explode(F.sequence(at(F.col("_lo")), at(F.col("_hi")))))
    d = df.withColumn("_u", unit).withColumn("_b", at(F.col("_u")))
    return d.join(F.broadcast(ranges), "_b").filter((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).drop(
        "_u", "_b", "_lo", "_hi")
