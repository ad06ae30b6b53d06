"""Dialogue operators (WIN1-WIN3, FLT3, FLT6, AGG10).

Input is a long table of turns ``(conv, turn, role, text)``.  Every step
windows or groups by the conversation only, so after the first shuffle on
``conv`` the later windows and aggregates reuse that partitioning: one
exchange for the whole chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import keyed_runs


def validate_domain(df: DataFrame, col: str, allowed: Sequence[str], what: str | None = None) -> DataFrame:
    """FLT6: fail the job on a value outside ``allowed`` (checked row by row, no extra pass)."""
    label = what or col
    bad = F.raise_error(F.concat(F.lit(f"unknown {label}: "), F.coalesce(F.col(col), F.lit("NULL"))))
    return df.withColumn(col, F.when(F.col(col).isin(*allowed), F.col(col)).otherwise(bad))


def require_first_role(turns: DataFrame, role: str, conv: str = "conv_id", order="turn",
                       role_col: str = "role", split_keys: bool = False) -> DataFrame:
    """FLT3: keep conversations whose first turn is spoken by ``role``.

    ``split_keys``: find first speakers with a partial aggregate (map-side
    combine) and a semi join instead of a per-conversation window, so a huge
    conversation does not land in one task.
    """
    if split_keys:
        cols = _order(order)
        firsts = (turns.groupBy(conv).agg(F.min_by(role_col, F.struct(*cols)).alias("_fr"))
                  .filter(F.col("_fr") == role).select(conv))
        return turns.join(firsts, conv, "left_semi")
    w = Window.partitionBy(conv).orderBy(*_order(order))
    return (turns.withColumn("_first_role", F.first(role_col).over(w))
            .filter(F.col("_first_role") == role).drop("_first_role"))


def _order(order) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def run_ids(turns: DataFrame, conv: str = "conv_id", order="turn", role_col: str = "role",
            name: str = "run", bucket: Column | None = None) -> DataFrame:
    """Number maximal runs of one speaker: 1, 2, ... within each conversation.

    With ``bucket`` (non-decreasing in the order, e.g. ``floor(turn / 1024)``) the
    scan is split into (conversation, bucket) pieces, so one huge conversation
    is spread over many tasks (see ``scan.py``); the numbering is the same.
    """
    if bucket is not None:
        return keyed_runs(turns, [conv], _order(order), bucket, role_col, name)
    w = Window.partitionBy(conv).orderBy(*_order(order))
    prev = F.lag(role_col).over(w)
    flag = F.when(prev.isNull() | (prev != F.col(role_col)), 1).otherwise(0)
    return (turns.withColumn("_flag", flag)
            .withColumn(name, F.sum("_flag").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .drop("_flag"))


def merge_turns(turns: DataFrame, conv: str = "conv_id", order="turn", role_col: str = "role",
                text: str = "text", sep: str = "\n", bucket: Column | None = None) -> DataFrame:
    """WIN1: one row per run of one speaker, texts joined by ``sep`` in turn order."""
    cols = _order(order)
    r = run_ids(turns, conv, cols, role_col, bucket=bucket)
    ordered = F.array_sort(F.collect_list(F.struct(*cols, F.col(text).alias("_t"))))
    return (r.groupBy(conv, "run")
            .agg(F.min_by(role_col, F.struct(*cols)).alias(role_col),
                 F.min_by(cols[-1], F.struct(*cols)).alias("first_" + cols[-1]),
                 F.count(F.lit(1)).alias("n_turns"),
                 F.array_join(F.transform(ordered, lambda s: s["_t"]), sep).alias(text)))


def pair_turns(runs: DataFrame, first: str, reply: str, conv: str = "conv_id",
               role_col: str = "role", text: str = "text") -> DataFrame:
    """WIN2: pair the i-th ``first`` block with the i-th ``reply`` block; unpaired tail dropped.

    Expects merged runs that alternate and start with ``first`` (after FLT3),
    so block i of either role is run ``2i+1`` / ``2i+2``.
    """
    i = F.floor((F.col("run") - 1) / 2).cast("int")
    return (runs.withColumn("i", i).groupBy(conv, "i")
            .agg(F.max(F.when(F.col(role_col) == first, F.col(text))).alias("prompt"),
                 F.max(F.when(F.col(role_col) == reply, F.col(text))).alias("reply"))
            .filter(F.col("prompt").isNotNull() & F.col("reply").isNotNull()))


HISTORY_BLOCK = 64


def history_rows(pairs: DataFrame, first_marker: str, reply_marker: str, conv: str = "conv_id") -> DataFrame:
    """WIN3: for every pair i, the dialogue so far (pairs < i, then prompt i) and reply i as target.

    Every prefix is an output row, but no task makes all of a long dialogue's: pairs are cut into blocks of
    ``HISTORY_BLOCK``; a window inside a block gives its part of the history, and what lies before the block is joined
    from a table with one row per block, in which a window runs over block texts only.
    """
    piece = F.concat(F.lit(first_marker), F.col("prompt"), F.lit(reply_marker), F.col("reply"))
    d = pairs.withColumns({"_blk": F.floor(F.col("i") / HISTORY_BLOCK).cast("long"), "_piece": piece})
    blocks = d.groupBy(conv, "_blk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "i", "_piece"))), lambda s: s["_piece"]), "").alias("_bt"))
    earlier = Window.partitionBy(conv).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(conv, "_blk", F.array_join(F.collect_list("_bt").over(earlier), "").alias("_before"))
    inside = Window.partitionBy(conv, "_blk").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_own", F.array_join(F.collect_list("_piece").over(inside), "")).join(before, [conv, "_blk"])
    text = F.concat("_before", "_own", F.lit(first_marker), F.col("prompt"))
    return d.withColumn("history", F.regexp_replace(text, "^\n+", "")).drop("_blk", "_piece", "_own", "_before")


def turn_histogram(turns: DataFrame, roles: Sequence[str], conv: str = "conv_id", order="turn",
                   role_col: str = "role", bucket: Column | None = None) -> DataFrame:
    """AGG10: how many conversations have n runs of each speaker (runs merged; zero counts kept)."""
    runs = run_ids(turns, conv, order, role_col, bucket=bucket)
    starts = runs.groupBy(conv, "run").agg(F.min(role_col).alias(role_col))
    per = starts.groupBy(conv).agg(*[F.count_if(F.col(role_col) == r).alias(f"_n{i}")
                                    for i, r in enumerate(roles)])
    pairs = ", ".join(f"'{r}', _n{i}" for i, r in enumerate(roles))
    long = per.select(F.expr(f"stack({len(roles)}, {pairs}) AS ({role_col}, n_runs)"))
    return long.groupBy(role_col, "n_runs").agg(F.count(F.lit(1)).alias("n_conversations"))
