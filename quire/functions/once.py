"""Columns that are computed once per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``df`` with further columns that later steps read instead of recomputing.

    The optimizer copies a column's expression into every filter that uses it, and through those into one another, which
    multiplies long ones (draws, renderings, pattern matches).  It does not look through a generator: the columns are the
    one row of an ``inline``, which stays inside the stage and its generated code.
    """
    taken = [c for c in df.columns if c not in columns]
    return df.select(*taken, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
