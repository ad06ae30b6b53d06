"""Lookups of rows whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds at least one of so many rows; there are at most so many hot keys, whatever the data.
HOT_SHARE = 1000


def lookup_join(rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner",
                hot_share: int = HOT_SHARE) -> DataFrame:
    """``rows`` joined ("inner" or "left") with ``lookup``, which has one row per key.

    Keys that hold ``1 / hot_share`` of the rows or more are looked up by a broadcast of at most ``hot_share`` rows, the
    others by a shuffle, in which no key is hot then.  Null keys match nothing: "left" keeps their rows, unshuffled.
    ``rows`` is read three times and should be stored.
    """
    there = F.lit(True)
    for c in on:
        there = there & F.col(c).isNotNull()
    keyed = rows.where(there)
    counts = keyed.groupBy(*on).agg(F.count(F.lit(1)).alias("hot_rows"))
    total = counts.agg(F.sum("hot_rows")).scalar()
    hot = counts.where(F.col("hot_rows") * hot_share >= total).select(*on)
    hot_lookup = F.broadcast(lookup.join(hot, on, "left_semi"))
    cold = keyed.join(F.broadcast(hot), on, "left_anti")
    # A hot key that lookup lacks matches nothing; "left" keeps its rows.
    found = keyed.join(F.broadcast(hot), on, "left_semi").join(hot_lookup, on, how).unionByName(cold.join(lookup, on, how))
    if how == "left":
        more = [f for f in lookup.schema.fields if f.name not in on]
        rest = rows.where(~there).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in more])
        found = found.unionByName(rest)
    return found
