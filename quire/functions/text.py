"""Scalar string and list helpers (SCL1-SCL17) as Spark Columns.

All are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() treats as white space.
# ASCII white space, U+001C-U+001F, U+0085, U+00A0, U+1680, U+2000-U+200A,
# U+2028, U+2029, U+202F, U+205F, U+3000.
WS_CLASS = ("[\t\n\u000b\u000c\r \u001c-\u001f\u0085\u00a0\u1680"
            "\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
STRIP_RE = f"^{WS_CLASS}+|{WS_CLASS}+$"
#: The same characters one by one.
WS_CHARS = ("\t\n\u000b\u000c\r \u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
            "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def regex_quote(s: str) -> str:
    """Quote a literal for a Java regex (Spark split / regexp_*)."""
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def strip_ws(col) -> Column:
    """SCL3: strip leading/trailing Unicode white space, like ``str.strip()``."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def split_keep(col, sep: str) -> Column:
    """SCL1: split on a literal separator, keeping empty pieces."""
    return F.split(_c(col), regex_quote(sep), -1)


def strip_items(arr) -> Column:
    """Strip every item and drop those left empty (SCL3 + SCL9)."""
    return F.filter(F.transform(_c(arr), lambda x: strip_ws(x)), lambda x: F.length(x) > 0)


def lstrip_newlines(col) -> Column:
    """SCL4: strip leading newlines only."""
    return F.regexp_replace(_c(col), "^\n+", "")


def strip_quotes(col) -> Column:
    """SCL5: strip surrounding double quotes."""
    return F.regexp_replace(_c(col), '^"+|"+$', "")


def replace_first_n(col, old: str, new: str, n: int = 100) -> Column:
    """Replace the first ``n`` occurrences of ``old`` (``str.replace(old, new, n)``).

    The common case (at most ``n`` occurrences) is one ``replace``; the split
    path only runs for rows with more occurrences (``CASE`` is lazy).
    """
    c = _c(col)
    occurrences = (F.length(c) - F.length(F.replace(c, F.lit(old), F.lit("")))) / len(old)
    parts = split_keep(c, old)
    head = F.array_join(F.slice(parts, 1, n + 1), new)
    tail = F.array_join(F.slice(parts, n + 2, F.greatest(F.size(parts), F.lit(1))), old)
    many = F.concat(head, F.lit(old), tail)
    return F.when(occurrences <= n, F.replace(c, F.lit(old), F.lit(new))).otherwise(many)


FOLD_FROM, FOLD_TO = ":,;", "：，；"  # fixed values


def fold_punctuation(col, most: int = 100) -> Column:
    """SCL6: ASCII ``: , ;`` to their full-width forms, at most ``most`` of each.

    The marks don't interact, so a text with at most ``most`` of each is one ``translate``; only others take the
    counted replacement, in which a lambda holds each step's text once.
    """
    c = _c(col)
    few = F.lit(True)
    for mark in FOLD_FROM:
        few = few & (F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit(""))) <= most)

    def counted(mark, wide):
        return lambda x: replace_first_n(x, mark, wide, most)

    slow = F.array(c)
    for mark, wide in zip(FOLD_FROM, FOLD_TO):
        slow = F.transform(slow, counted(mark, wide))
    return F.when(few, F.translate(c, FOLD_FROM, FOLD_TO)).otherwise(F.element_at(slow, 1))


def tail_after(col, marker: str) -> Column:
    """SCL8: text after the last ``marker``; the whole string when absent."""
    return F.substring_index(_c(col), marker, -1)


def count_marker(col, marker: str) -> Column:
    """Non-overlapping occurrences of a literal marker (AGG11)."""
    c = _c(col)
    return ((F.length(c) - F.length(F.replace(c, F.lit(marker), F.lit("")))) / len(marker)).cast("int")


def default(col, value) -> Column:
    """SCL12: default for a missing field."""
    return F.coalesce(_c(col), F.lit(value))


def to_markdown_row(*cols) -> Column:
    """SNK4: one pipe-delimited markdown row with newlines escaped."""
    cells = [F.coalesce(_c(c).cast("string"), F.lit("None")) for c in cols]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return F.replace(line, F.lit("\n"), F.lit("\\n"))


# ---------------------------------------------------------------- DuckDB SQL

def sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL_STRIP_RE = sql_lit(STRIP_RE)


def sql_strip_ws(x: str) -> str:
    return f"regexp_replace({x}, {SQL_STRIP_RE}, '', 'g')"
