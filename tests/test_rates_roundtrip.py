"""Statistical rates of the builders and build -> parse round trips (sf0.01)."""

import math

import pytest
from pyspark.sql import functions as F

from quire.operators import parse as P
from quire.plans import builders as B
from quire.plans.tasks import ANSWER_SUFFIX, ENTITIES, RELATIONS
from quire.session import table

MID = "/root/testdata/sf0.01"


def _within(share, p, n, k=4.0):
    return abs(share - p) <= k * math.sqrt(p * (1 - p) / n)


@pytest.fixture(scope="module")
def relations(spark):
    o = table(spark, MID, "orders")
    return B.build_relations(B.relation_samples(o), vocab=B.relation_vocab(o)).cache()


def test_relation_rates(relations):
    r = relations.agg(F.count(F.lit(1)).alias("n"),
                      F.avg(F.col("input").endswith(ANSWER_SUFFIX).cast("double")).alias("suffix"),
                      F.avg((F.col("target") == RELATIONS.words["none"]).cast("double")).alias("none")).first()
    assert _within(r.suffix, RELATIONS.p_suffix, r.n)
    # 'none' rows are the not-exist branch (rows without any absent predicate keep the exist wording)
    assert _within(r.none, 1 - RELATIONS.probs["exist"], r.n)


def test_entity_rates(spark):
    ev = table(spark, MID, "events")
    rows = B.build_entities(B.entity_samples(ev), vocab=B.entity_vocab(ev))
    r = rows.agg(F.count(F.lit(1)).alias("n"),
                 F.avg((F.col("target") == ENTITIES.words["none"]).cast("double")).alias("none")).first()
    assert _within(r.none, 1 - ENTITIES.probs["exist"], r.n)


def test_relation_round_trip(spark, relations):
    samples = B.relation_samples(table(spark, MID, "orders"))
    exists = relations.filter(F.col("target") != RELATIONS.words["none"])
    words = [RELATIONS.words[k] for k in ("line_a", "line_b", "head", "tail")]
    parsed = P.parse_triples(exists, *words).filter("subject is not null").select("sample_id", "predicate", "subject", "object")
    src = (samples.select(F.concat_ws("-", F.lit("relations"), F.col("o_custkey").cast("string"),
                                      F.col("o_year").cast("string")).alias("sample_id"), F.explode("triples").alias("t"))
           .select("sample_id", F.col("t.predicate").alias("predicate"), F.col("t.subject").alias("subject"),
                   F.col("t.object").alias("object"))
           .join(exists.select("sample_id"), "sample_id", "left_semi"))
    assert parsed.exceptAll(src).count() == 0 and src.exceptAll(parsed).count() == 0


def test_cjk_emoji_and_null_text(spark):
    from quire.functions.text import strip_ws
    from quire.operators.templates import render
    df = spark.createDataFrame([("　中文😀 ",), ("",), (None,)], "t string")
    out = df.select(strip_ws("t").alias("s"), F.length(strip_ws("t")).alias("n"),
                    render(["<{text}>"], F.lit(0), {"text": F.col("t")}).alias("r")).collect()
    assert [(r.s, r.n, r.r) for r in out] == [("中文😀", 3, "<　中文😀 >"), ("", 0, "<>"), (None, None, None)]
    preds = spark.createDataFrame([("i", None, ["Click"], "t", "entities", "s")],
                                  "input string, target string, answer_choices array<string>, task_type string, "
                                  "task_dataset string, sample_id string")
    assert P.parse_entities(preds, ENTITIES.words["line"]).first().entity is None
    assert P.parse_label(preds).first().label is None
