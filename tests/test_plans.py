"""Plan shape checks over every registered query: no cartesian products or nested-loop joins, and one task gathers only
what an aggregate or a limit has made small."""

import re

import pytest

import __spark_entry__ as E
from conftest import SMALL

SKIP = {"stream_prepare", "stream_pack", "jsonl_roundtrip", "json_shapes", "tsv_pairs", "ext_sources", "split_by_task",
        "write_predictions", "merge_shards", "file_manifest", "submission_files", "submission_written", "submission_document"}
#: Operators whose output is small whatever the tables.
SMALL_OUTPUT = ("HashAggregate", "ObjectHashAggregate", "SortAggregate", "LocalLimit", "LocalTableScan", "Range", "Window")


def gathered(plan: str) -> list[str]:
    """Scans whose rows reach a single partition without an aggregate or a limit before it."""
    lines = [(len(m.group(0)), x[m.end():]) for x in plan.splitlines() if (m := re.match(r"^[\s:+\-*]*(\(\d+\) )?", x))]
    out = []
    for i, (depth, line) in enumerate(lines):
        if not line.startswith("Exchange SinglePartition"):
            continue
        covered = None
        for d, x in lines[i + 1:]:
            if d <= depth:
                break
            if covered is not None and d > covered:
                continue
            covered = d if x.startswith(SMALL_OUTPUT) else None
            if "Scan" in x.split(" ")[0] and covered is None:
                out.append(x[:80])
    return out


@pytest.mark.parametrize("name", sorted(set(E.queries()) - SKIP - set(E.LLM_QUERIES)))
def test_plan(spark, name):
    df = E.queries()[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert not gathered(plan), (name, gathered(plan))


def test_gathered_finds_what_it_should(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{SMALL}/orders.parquet").select("o_orderkey")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert gathered(plan(rows.withColumn("n", F.row_number().over(Window.orderBy("o_orderkey")))))
    assert gathered(plan(rows.repartition(1)))
    assert not gathered(plan(rows.agg(F.count(F.lit(1)))))
