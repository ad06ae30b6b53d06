"""Prompt templates: render (PRJ1-PRJ3) and recognise (FLT5, AGG1).

A template is plain text with ``{slot}`` markers.  Rendering concatenates the
literal pieces with the slot columns in one ``CASE`` expression, so a slot
marker that happens to appear inside user text is never expanded again (no
chained ``replace``) and no join is needed: the template list is part of the
plan, like any literal.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw_int, sql_draw_int, sql_u, u
from ..functions.once import with_once
from ..functions.text import sql_lit

_SLOT = re.compile(r"\{(\w+)\}")


def pieces(template: str) -> list[tuple[str, str]]:
    """Split a template into ``('lit', text)`` and ``('slot', name)`` pieces."""
    out, pos = [], 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            out.append(("lit", template[pos:m.start()]))
        out.append(("slot", m.group(1)))
        pos = m.end()
    if pos < len(template):
        out.append(("lit", template[pos:]))
    return out


def render_one(template: str, slots: Mapping[str, Column]) -> Column:
    return F.concat(*[F.lit(v) if k == "lit" else slots[v] for k, v in pieces(template)])


def render(templates: Sequence[str], idx: Column, slots: Mapping[str, Column]) -> Column:
    """PRJ1: the ``idx``-th template (0-based) filled with ``slots``."""
    expr = None
    for i, t in enumerate(templates):
        e = render_one(t, slots)
        expr = F.when(idx == i, e) if expr is None else expr.when(idx == i, e)
    return expr


def pick_template(n: int, seed, task: str, key: Sequence[str]) -> Column:
    """PRJ2: uniform template index in [0, n)."""
    return draw_int(0, n - 1, u(seed, task, key, "template"))


def maybe_suffix(text: Column, suffix: str, p: float, seed, task: str, key: Sequence[str]) -> Column:
    """PRJ3: append ``suffix`` with probability ``p``."""
    return F.when(u(seed, task, key, "suffix") < p, F.concat(text, F.lit(suffix))).otherwise(text)


def pattern_of(template: str) -> str:
    """Regex that recognises a rendered template: literals quoted, slots ``[^\\n]+``.

    Written with the common subset of Java and RE2 syntax so the same text
    works in Spark ``rlike`` and DuckDB ``regexp_matches``.
    """
    ps = pieces(template)
    out = []
    for j, (k, v) in enumerate(ps):
        if k == "slot":
            # For an unanchored search a slot at either end only needs one
            # character: same matches, no quadratic backtracking on long lines.
            out.append("[^\n]" if j in (0, len(ps) - 1) else "[^\n]+")
        else:
            out.append("".join(c if c.isalnum() or c in " \n" or ord(c) > 127 else "\\" + c for c in v))
    return "".join(out)


#: With more templates than this, an index names the candidates of a row; with fewer, their patterns are tried inside
#: the JVM.  Both find the same.
TRIED_BY_ONE = 16


def match_templates(df: DataFrame, col: str, templates: Sequence[str], name: str = "matched",
                    tried_by_one: int = TRIED_BY_ONE) -> DataFrame:
    """FLT5: array of template indexes whose pattern is found in ``col`` (unanchored)."""
    if len(templates) > tried_by_one:
        return df.withColumn(name, template_index(templates)(F.col(col)))
    hits = [F.when(F.col(col).rlike(pattern_of(t)), F.lit(i)) for i, t in enumerate(templates)]
    return with_once(df, {name: F.filter(F.array(*hits), lambda x: x.isNotNull())})


def template_index(templates: Sequence[str]) -> Callable[[Column], Column]:
    """FLT5 for many templates: an Aho-Corasick automaton over each template's longest literal piece reads a text once,
    whatever their number; only the templates whose piece it meets are matched by their pattern.  Texts pass in Arrow
    batches, the automaton is built once per batch iterator.  A template of slots alone is always tried."""
    longest = [max((v for k, v in pieces(t) if k == "lit"), key=len, default="") for t in templates]
    patterns = [pattern_of(t) for t in templates]

    @F.pandas_udf("array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        compiled = [re.compile(p) for p in patterns]
        owners: dict[str, list[int]] = {}
        for i, piece in enumerate(longest):
            owners.setdefault(piece, []).append(i)
        always = owners.pop("", [])
        index = ahocorasick.Automaton()
        for piece, ids in owners.items():
            index.add_word(piece, ids)
        if owners:
            index.make_automaton()

        def matches(text):
            if text is None:
                return []
            candidates = set(always)
            for _, ids in index.iter(text) if owners else ():
                candidates.update(ids)
            return sorted(i for i in candidates if compiled[i].search(text))

        for texts in batches:
            yield pd.Series([matches(t) for t in texts.tolist()])

    return found


# ---------------------------------------------------------------- DuckDB SQL

def sql_render_one(template: str, slots: Mapping[str, str]) -> str:
    return "(" + " || ".join(sql_lit(v) if k == "lit" else f"({slots[v]})" for k, v in pieces(template)) + ")"


def sql_render(templates: Sequence[str], idx_sql: str, slots: Mapping[str, str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {sql_render_one(t, slots)}" for i, t in enumerate(templates))
    return f"(CASE {idx_sql} {whens} END)"


def sql_pick_template(n: int, seed, task: str, key: Sequence[str]) -> str:
    return sql_draw_int(0, n - 1, sql_u(seed, task, key, "template"))


def sql_maybe_suffix(text_sql: str, suffix: str, p: float, seed, task: str, key: Sequence[str]) -> str:
    return (f"(CASE WHEN {sql_u(seed, task, key, 'suffix')} < {p} "
            f"THEN ({text_sql}) || {sql_lit(suffix)} ELSE ({text_sql}) END)")
