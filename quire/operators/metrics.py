"""Evaluation metrics (AGG12-AGG14, UDF3) as native aggregates.

Token accuracy compares predictions and labels inside each row with
``zip_with`` (no per-token explode, no join), then sums two counters: one
partial aggregate for the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shifted_matches(preds, labels, ignore_id: int | None = None) -> tuple[Column, Column]:
    """Per row: (compared, correct) for preds[:-1] against labels[1:]."""
    p = preds if isinstance(preds, Column) else F.col(preds)
    lab = labels if isinstance(labels, Column) else F.col(labels)
    n = F.greatest(F.size(lab) - 1, F.lit(0))
    p, lab = F.slice(p, 1, n), F.slice(lab, 2, n)
    if ignore_id is not None:
        # 1 and 0 for compared positions, null for those left out
        right = F.filter(F.zip_with(p, lab, lambda a, b: F.when(b != ignore_id, F.coalesce((a == b).cast("int"), F.lit(0)))),
                         lambda x: x.isNotNull())
        return F.size(right), F.size(F.filter(right, lambda x: x == 1))
    right = F.zip_with(p, lab, lambda a, b: a == b)
    return F.size(right), F.size(F.filter(right, lambda x: x))


def shifted_accuracy(df: DataFrame, preds: str, labels: str, ignore_id: int | None = None) -> DataFrame:
    """AGG12: token accuracy with labels shifted by one (``-100`` kept unless ``ignore_id``)."""
    n, ok = shifted_matches(preds, labels, ignore_id)
    agg = df.select(n.alias("_n"), ok.alias("_ok")).agg(F.sum("_n").cast("long").alias("n_compared"),
                                                         F.sum("_ok").cast("long").alias("n_correct"))
    return agg.withColumn("accuracy", F.round(F.col("n_correct") / F.col("n_compared"), 6))


def perplexity(df: DataFrame, loss: str, by: list[str] | None = None) -> DataFrame:
    """AGG13: exp(mean loss); overflow gives +inf."""
    g = df.groupBy(*(by or [])).agg(F.round(F.avg(loss), 9).alias("mean_loss"))
    return g.withColumn("perplexity", F.exp("mean_loss"))


def capped_counts(df: DataFrame, cap: int | None, by: list[str] | None = None) -> DataFrame:
    """AGG14: samples reported as ``min(cap, n)``."""
    g = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_rows"))
    return g.withColumn("samples", F.col("n_rows") if cap is None else F.least(F.lit(cap).cast("long"), F.col("n_rows")))
