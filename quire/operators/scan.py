"""Ordered scans within a key that stay balanced when one key is huge.

A window ``PARTITION BY key ORDER BY ...`` puts a whole key in one task.
``keyed_runs`` cuts each key into order-preserving sub-buckets (``bucket``
is a non-decreasing function of the order, e.g. ``floor(turn / 1024)`` or
the hour of a timestamp), runs the window inside each (key, bucket), and
carries state across buckets through a small per-bucket table (one row per
bucket, windowed per key).  The result equals the single-window result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_runs(df: DataFrame, key: Sequence[str], order: Sequence[str], bucket: Column, col: str,
               name: str, pos: str | None = None, total: str | None = None) -> DataFrame:
    """Run / island numbering in one bucketed pass.

    A row starts a new run when ``col`` is not null and differs from the
    previous row's value (or is the first row).  ``name`` = 1-based running
    count of starts within ``key`` (nulls carry the current count);
    ``pos`` = 1-based row position; ``total`` = rows in the key.  One window
    per (key, bucket), one small per-bucket table, one join back.
    """
    key, order = list(key), list(order)
    w = Window.partitionBy(*key, "_kb").orderBy(*order)
    prev = F.lag(col).over(w)
    d = (df.withColumn("_kb", bucket)
         .withColumn("_kst", (F.col(col).isNotNull() & (prev.isNull() | (prev != F.col(col)))).cast("int")))
    d = (d.withColumn("_kcs", F.sum("_kst").over(w.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("_krn", F.row_number().over(w)))
    ordkey = F.struct(*[F.col(c) for c in order])
    bt = d.groupBy(*key, "_kb").agg(F.count(F.lit(1)).alias("_kn"), F.sum("_kst").alias("_kss"),
                                    F.max_by(col, ordkey).alias("_klast"), F.min_by(col, ordkey).alias("_kfv"))
    wb = Window.partitionBy(*key).orderBy("_kb")
    carry = F.lag("_klast").over(wb)
    first_local = F.col("_kfv").isNotNull().cast("int")
    first_true = (F.col("_kfv").isNotNull() & (carry.isNull() | (carry != F.col("_kfv")))).cast("int")
    bt = bt.withColumn("_kadj", first_true - first_local)
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    cols = [*key, "_kb", "_kadj",
            F.coalesce(F.sum(F.col("_kss") + F.col("_kadj")).over(before), F.lit(0)).alias("_koff"),
            F.coalesce(F.sum("_kn").over(before), F.lit(0)).alias("_kpoff")]
    if total:
        cols.append(F.sum("_kn").over(Window.partitionBy(*key)).alias(total))
    out = (d.join(bt.select(*cols), [*key, "_kb"])
           .withColumn(name, (F.col("_koff") + F.col("_kcs") + F.col("_kadj")).cast("long")))
    if pos:
        out = out.withColumn(pos, (F.col("_kpoff") + F.col("_krn")).cast("long"))
    return out.drop("_kb", "_kst", "_kcs", "_krn", "_kadj", "_koff", "_kpoff")
