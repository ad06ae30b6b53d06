"""Mixing sources to target weights by cube-method balanced sampling.

Each document is taken floor(p) times and once more with probability p - floor(p), where p is its source's target over
its source's size.  The cube method moves the vector of those fractional probabilities through the null space of the
constraints (words and documents of the source) until every entry is 0 or 1.  A source is cut into blocks; a block
ends with at most two undecided documents, which meet those of other blocks on the next level; the last level, one
group per source, lands by dropping the constraints one after another.

Defined cases: null text has size 0; documents of size 0 are taken 0 times; a null source is a source of its own, last
in order; rows equal in doc_id, source and size are units of their own, told apart by a running number; an empty table gives an empty result; other
columns are ignored.  Draws are keyed by seed, source and block, so reruns agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, n_words, stored

#: Documents in one block of the flight at most, on average (a block is one task's group).
BLOCK_UNITS = 4096
WEIGHTS = (5, 2, 1)
UNIT = "doc_id string, source string, size long, copy long, whole long, chance double, open boolean"
WALKED = UNIT + ", blocks long, block long"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, units, target).  The table holds one row per source; its windows are over that table.

    Water filling: with sources ordered by cap over weight, those whose cap lies under the level that is left for them
    are capped, the others get their weight times the level of the first of them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("units"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
             ) / F.sum("weight").over(after)
    per = per.withColumn("level", level).withColumn("capped", F.col("weight") * F.col("level") >= F.col("most"))
    flat = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return per.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * flat)).select(
        "source", "source_size", "units", "target")


def flight(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator, landing: bool) -> np.ndarray:
    """The cube method's walk.  Three undecided units at a time have one direction that keeps both their words and
    their number; a step goes to one of its two ends, with the chances that keep every probability.  ``landing`` goes
    on with one constraint (words), then none, until nothing is undecided."""
    p = chance.tolist()
    x = size.tolist()
    draw = iter(rng.random(3 * len(p) + 8).tolist())
    hold: list[int] = []
    todo = iter(range(len(p)))
    while True:
        while len(hold) < 3:
            i = next(todo, None)
            if i is None:
                break
            if 1e-9 < p[i] < 1 - 1e-9:
                hold.append(i)
            else:
                p[i] = float(round(p[i]))
        if len(hold) == 3:
            i, j, k = hold
            u = (x[j] - x[k], x[k] - x[i], x[i] - x[j])
            if u == (0, 0, 0):
                u = (1, -1, 0)
        elif not landing or not hold:
            break
        elif len(hold) == 2:
            u = (x[hold[1]], -x[hold[0]])
        else:
            u = (1,)
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(hold, u) if d)
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(hold, u) if d)
        step = up if next(draw) * (up + down) < down else -down
        for i, d in zip(hold, u):
            p[i] += step * d
            if p[i] < 1e-9:
                p[i] = 0.0
            elif p[i] > 1 - 1e-9:
                p[i] = 1.0
        hold = [i for i in hold if 0.0 < p[i] < 1.0]
    return np.array(p)


def block_flight(seed: int, level: int):
    """The flight of one block; a source's only block also lands."""

    def one(key, pdf):
        order = mix64(mix64(pd.util.hash_array(pdf["doc_id"].fillna("").to_numpy(object)) + np.uint64(seed)) + pdf["copy"].to_numpy(
            np.int64).view(np.uint64))
        pdf = pdf.assign(o=order).sort_values(["o", "doc_id", "size", "copy"], ignore_index=True)
        named = f"{seed}|{level}|{key[0]!r}|{int(key[1])}".encode()
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(named).digest()[:8], "little"))
        last = int(pdf["blocks"].iloc[0]) == 1
        p = flight(pdf["chance"].to_numpy(float), pdf["size"].to_numpy(np.int64), rng, last)
        return pdf.assign(chance=p, open=(p > 0) & (p < 1))[[c.split()[0] for c in WALKED.split(", ")]]

    return one


def balanced_sample(units: DataFrame, seed: int = 17, block_units: int = BLOCK_UNITS) -> DataFrame:
    """Decide ``chance`` of every unit (0 or 1) within its source; ``units`` has the columns of UNIT less ``open``, and
    ``units`` per source as n_units."""
    hash_id = F.xxhash64("doc_id", "size", "copy", F.lit(seed))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_units") / block_units)).cast("long")
    left = units.withColumns({"blocks": blocks, "block": F.pmod(hash_id, blocks)})
    done: list[DataFrame] = []
    names = [c.split()[0] for c in UNIT.split(", ")]
    level = 0
    while True:
        walked = stored(left.groupBy("source", "block").applyInPandas(block_flight(seed, level), WALKED), f"flight-{level}")
        done.append(walked.where(~F.col("open")).select(*names))
        left = walked.where("open").drop("open")
        # At most two units of a block are left: as many blocks as hold half of block_units meet in one.
        fan = max(2, block_units // 2)
        left = left.withColumns({"block": F.floor(F.col("block") / fan).cast("long"),
                                 "blocks": F.ceil(F.col("blocks") / fan).cast("long")})
        level += 1
        if left.isEmpty():
            break
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def numbered_copies(sizes: DataFrame) -> DataFrame:
    """``sizes`` (doc_id, source, size) with a running number ``copy`` among equal rows.  Equal rows are counted, and the
    counts are dealt out in parts of ``BLOCK_UNITS`` before they become rows again."""
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("copies") - 1, F.lit(BLOCK_UNITS))))
    parts = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")).withColumn("part", part)
    first = F.col("part") * BLOCK_UNITS
    copy = F.explode(F.sequence(first, F.least(F.col("copies"), first + BLOCK_UNITS) - 1))
    return parts.repartition("doc_id", "source", "size", "part").withColumn("copy", copy).drop("copies", "part")


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document; ``doc_id`` may be of any type that a string
    gives back."""
    id_type = docs.schema["doc_id"].dataType
    sizes = stored(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source", n_words(F.col("text")).alias(
        "size")), "sizes")
    units = numbered_copies(sizes.where("size > 0"))
    targets = stored(source_targets(sizes, weights, share, cap), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = targets.withColumnsRenamed({"source": "t_source", "units": "n_units"})
    units = units.join(t, units["source"].eqNullSafe(t["t_source"])).withColumn("ratio", ratio).withColumn(
        "whole", F.floor("ratio").cast("long")).withColumn("chance", F.col("ratio") - F.col("whole"))
    decided = balanced_sample(units.select("doc_id", "source", "size", "copy", "whole", "chance", "n_units"), seed)
    rows = decided.select("doc_id", "source", "size", (F.col("size") * (F.col("whole") + F.col("chance").cast("long"))).alias(
        "taken")).unionByName(sizes.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    rows = rows.withColumn("doc_id", F.col("doc_id").cast(id_type))
    return rows.join(t.drop("n_units"), rows["source"].eqNullSafe(t["t_source"])).select(
        "doc_id", "source", "size", "source_size", "target", "taken")
