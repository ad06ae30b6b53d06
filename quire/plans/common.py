"""Shared finishing steps for instruction builders: render, suffix, six columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import sql_lit
from ..operators.sampling import sample_k
from ..operators.templates import (maybe_suffix, pick_template, render, sql_maybe_suffix,
                                   sql_pick_template, sql_render)
from .tasks import ANSWER_SUFFIX, TaskSpec

OUTPUT_COLUMNS = ("input", "target", "answer_choices", "task_type", "task_dataset", "sample_id")
ARRAY_STR = T.ArrayType(T.StringType())


def sample_id(spec: TaskSpec, key: Sequence[str]) -> Column:
    return F.concat_ws("-", F.lit(spec.name), *[F.col(k).cast("string") for k in key])


def finish(df: DataFrame, spec: TaskSpec, key: Sequence[str], slots: Mapping[str, Column],
           target: Column, choices: Column | None, seed, keep_template: bool = False) -> DataFrame:
    """Render the chosen template, maybe add the answer suffix, emit the six output columns."""
    idx = pick_template(len(spec.templates), seed, spec.name, key)
    text = render(spec.templates, idx, slots)
    if spec.p_suffix > 0:
        text = maybe_suffix(text, ANSWER_SUFFIX, spec.p_suffix, seed, spec.name, key)
    cols = [text.alias("input"), target.alias("target"),
            (choices if choices is not None else F.lit(None)).cast(ARRAY_STR).alias("answer_choices"),
            F.lit(spec.task_type).alias("task_type"), F.lit(spec.name).alias("task_dataset"),
            sample_id(spec, key).alias("sample_id")]
    if keep_template:
        cols.append(idx.alias("template_id"))
    return df.select(*cols)


def sampled(df: DataFrame, spec: TaskSpec, key: Sequence[str], seed, k: int | None = None,
            fraction: float | None = None) -> DataFrame:
    """A builder's samples cut to ``k`` or ``fraction`` (SMP1) before anything is drawn or rendered for them: a sample's
    rank depends on its id alone, so the rows are those of sampling the finished table."""
    if k is None and fraction is None:
        return df
    d = df.withColumn("_sample_id", sample_id(spec, key))
    return sample_k(d, ["_sample_id"], seed, spec.name, k=k, fraction=fraction).drop("_sample_id")


def report(df: DataFrame, sep: str = " | ") -> DataFrame:
    """Scalar view of instruction rows (choices joined) for comparisons and reports."""
    return df.withColumn("answer_choices", F.array_join("answer_choices", sep))


# ---------------------------------------------------------------- DuckDB SQL

def sql_sample_id(spec: TaskSpec, key: Sequence[str]) -> str:
    return "concat_ws('-', " + sql_lit(spec.name) + ", " + ", ".join(f"CAST({k} AS VARCHAR)" for k in key) + ")"


def sql_finish(spec: TaskSpec, key: Sequence[str], slots: Mapping[str, str], target: str,
               choices: str | None, seed, sep: str | None = " | ") -> str:
    """Select list equal to ``report(finish(...))`` (``sep=None``: choices kept as a list)."""
    idx = sql_pick_template(len(spec.templates), seed, spec.name, key)
    text = sql_render(spec.templates, idx, slots)
    if spec.p_suffix > 0:
        text = sql_maybe_suffix(text, ANSWER_SUFFIX, spec.p_suffix, seed, spec.name, key)
    if choices is None:
        ch = "CAST(NULL AS VARCHAR)" if sep is not None else "CAST(NULL AS VARCHAR[])"
    else:
        ch = f"array_to_string({choices}, {sql_lit(sep)})" if sep is not None else choices
    return (f"{text} AS input, {target} AS target, {ch} AS answer_choices, "
            f"{sql_lit(spec.task_type)} AS task_type, {sql_lit(spec.name)} AS task_dataset, "
            f"{sql_sample_id(spec, key)} AS sample_id")
