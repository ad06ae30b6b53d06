"""Keyed pseudo-random draws.

A draw is ``u(seed, task, key, draw)``: the first 13 hex digits of
``md5(seed|task|key...|draw)`` read as an integer and divided by 2**52, so it
lies in [0, 1).  It is a pure function of its inputs: the same row gets the
same draw on any partitioning, after a retry and in DuckDB, which makes
every sampled or randomised result reproducible and checkable.

Each helper comes in two forms: a Spark ``Column`` and a DuckDB SQL string
(used by the oracle queries).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = 4503599627370496.0


def _as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def draw_text(seed, task, key: Sequence, draw) -> Column:
    """``task`` is a literal name or a Column holding it (grouped draws)."""
    parts = [F.lit(str(seed)), task if isinstance(task, Column) else F.lit(task)]
    parts += [_as_col(k).cast("string") for k in key]
    parts.append(draw.cast("string") if isinstance(draw, Column) else F.lit(str(draw)))
    return F.concat_ws("|", *parts)


def draw_hash(seed, task, key: Sequence, draw) -> Column:
    """md5 hex of the draw text; its string order equals its numeric order."""
    return F.md5(draw_text(seed, task, key, draw))


def u_of(h: Column) -> Column:
    """The number in [0, 1) that a draw's hash stands for."""
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") / F.lit(TWO_52)


def u(seed, task, key: Sequence, draw) -> Column:
    return u_of(draw_hash(seed, task, key, draw))


def draw_int(lo, hi, unit: Column) -> Column:
    """Integer in [lo, hi] (both inclusive; either may be a Column)."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return (lo_c + F.floor(unit * (hi_c - lo_c + 1))).cast("int")


# ---------------------------------------------------------------- DuckDB SQL

def sql_draw_text(seed, task: str, key: Sequence[str], draw: str | None = None,
                  draw_sql: str | None = None) -> str:
    keys = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    d = draw_sql if draw_sql is not None else f"'{draw}'"
    return f"concat_ws('|', '{seed}', '{task}', {keys}, CAST({d} AS VARCHAR))"


def sql_hash(seed, task: str, key: Sequence[str], draw: str | None = None,
             draw_sql: str | None = None) -> str:
    return f"md5({sql_draw_text(seed, task, key, draw, draw_sql)})"


def sql_u(seed, task: str, key: Sequence[str], draw: str | None = None,
          draw_sql: str | None = None) -> str:
    h = sql_hash(seed, task, key, draw, draw_sql)
    return f"(('0x' || substr({h}, 1, 13))::BIGINT / 4503599627370496.0)"


def sql_draw_int(lo: str | int, hi: str | int, unit_sql: str) -> str:
    return f"CAST(({lo}) + floor(({unit_sql}) * (({hi}) - ({lo}) + 1)) AS INTEGER)"
