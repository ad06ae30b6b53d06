"""Counting and reporting aggregates (AGG1, AGG2, AGG8, AGG11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_marker
from .templates import match_templates


def task_counts(df: DataFrame, col: str = "task_dataset") -> DataFrame:
    """AGG2: rows per task."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))


def pattern_counts(df: DataFrame, col: str, templates: Sequence[str]) -> DataFrame:
    """AGG1: rows matched by each template pattern (a row may count for several)."""
    m = match_templates(df, col, templates, "_m")
    return (m.select(F.explode("_m").alias("template_id")).groupBy("template_id")
            .agg(F.count(F.lit(1)).alias("n_rows")))


def template_violations(df: DataFrame, col: str, templates: Sequence[str]) -> DataFrame:
    """FLT5 check: rows that match no template or more than one."""
    return match_templates(df, col, templates, "matched").filter(F.size("matched") != 1)


def exemplar(df: DataFrame, group: str, order: Sequence[str], length: str, min_len: int = 50) -> DataFrame:
    """AGG8: per group the first row, replaced by any strictly shorter row longer than ``min_len``.

    Closed form of the sequential scan: when the first row is not longer than
    ``min_len`` it stays; otherwise the shortest row longer than ``min_len``
    wins, ties to the earliest.  One aggregate, no ordering of the groups.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    ordkey = F.struct(*[F.col(c) for c in order])
    long_key = F.when(F.col(length) > min_len, F.struct(F.col(length), *[F.col(c) for c in order]))
    g = df.groupBy(group).agg(F.min_by(row, ordkey).alias("_first"), F.min_by(row, long_key).alias("_best"))
    pick = F.when(F.col(f"_first.{length}") <= min_len, F.col("_first")).otherwise(
        F.coalesce(F.col("_best"), F.col("_first")))
    return g.select(pick.alias("_r")).select("_r.*")


def marker_histogram(df: DataFrame, col: str, markers: Sequence[str]) -> DataFrame:
    """AGG11: for each marker, how many rows contain it n times."""
    counts = [F.struct(F.lit(m).alias("marker"), count_marker(col, m).alias("n")) for m in markers]
    return (df.select(F.explode(F.array(*counts)).alias("_c")).select("_c.marker", "_c.n")
            .groupBy("marker", "n").agg(F.count(F.lit(1)).alias("n_rows")))
