from pyspark.sql import functions as F

from quire.functions import text as TX
from quire.operators.templates import match_templates, pattern_of, render
from quire.plans.tasks import ALL_TASKS


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "s string").select(col.alias("o")).first().o


def test_strip_unicode_whitespace(spark):
    assert one(spark, TX.strip_ws("s"), "　 a b\t\n ") == "a b"
    assert one(spark, TX.strip_ws("s"), "　 ") == ""
    assert one(spark, TX.strip_ws("s"), "") == ""


def test_fold_punctuation_first_100(spark):
    s = ":" * 150 + "x,y;z"
    assert one(spark, TX.fold_punctuation("s"), s) == s.replace(":", "：", 100).replace(",", "，", 100).replace(";", "；", 100)
    assert one(spark, TX.fold_punctuation("s"), "a:b,c;d") == "a：b，c；d"


def test_split_keep_and_items(spark):
    assert one(spark, TX.split_keep("s", "，"), "，a，，b，") == ["", "a", "", "b", ""]
    assert one(spark, TX.split_keep("s", "，"), "") == [""]
    assert one(spark, TX.strip_items(TX.split_keep("s", "，")), " a，　，b ") == ["a", "b"]
    assert one(spark, TX.split_keep("s", ".*"), "a.*b") == ["a", "b"]


def test_tail_after_marker(spark):
    assert one(spark, TX.tail_after("s", "Response:\n"), "x Response:\n1 Response:\n2") == "2"
    assert one(spark, TX.tail_after("s", "Response:\n"), "no marker") == "no marker"


def test_count_marker_and_markdown(spark):
    assert one(spark, TX.count_marker("s", "User: "), "User: a User: b") == 2
    assert one(spark, TX.to_markdown_row(F.col("s")), "a\nb") == "| a\\nb |"


def test_render_does_not_expand_markers_in_user_text(spark):
    df = spark.createDataFrame([("{choices} inside",)], "t string")
    out = df.select(render(["Q: {text} / {choices}"], F.lit(0), {"text": F.col("t"), "choices": F.lit("A")}).alias("o"))
    assert out.first().o == "Q: {choices} inside / A"


def test_every_task_template_round_trips(spark):
    for spec in ALL_TASKS:
        rows = [(i, t) for i, t in enumerate(spec.templates)]
        df = spark.createDataFrame(rows, "i int, t string")
        slots = {k: F.lit("some text, no newline") for k in ("text", "choices", "a", "b")}
        rendered = df.select("i", render(spec.templates, F.col("i"), slots).alias("input"))
        for suffix in ("", "\nAnswer:"):
            m = match_templates(rendered.withColumn("input", F.concat("input", F.lit(suffix))), "input", spec.templates)
            for r in m.collect():
                assert r.matched == [r.i], (spec.name, r.i, r.matched)


def test_pattern_literals_are_quoted():
    assert pattern_of("a?b {x}") == "a\\?b [^\n]"


def test_template_index_finds_what_the_patterns_find(spark):
    import random

    rnd = random.Random(3)
    word = lambda: rnd.choice(["alpha", "beta.", "a?", "(x)", "\n", "é日", "{s}", " {t}\n", ": ", "gamma\\\\d", "aa", "a"])
    templates = ["".join(word() for _ in range(rnd.randint(1, 6))) for _ in range(120)] + ["{a}", "{a}{b}", "", "aa", "aa"]
    texts = ["".join(word().replace("{s}", "some text").replace("{t}", "q") for _ in range(rnd.randint(0, 12))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None, "\n"])], "i int, input string")
    one = {r["i"]: r["matched"] for r in match_templates(df, "input", templates, tried_by_one=1000).collect()}
    index = {r["i"]: r["matched"] for r in match_templates(df, "input", templates, tried_by_one=0).collect()}
    assert index == one and any(len(m) > 3 for m in one.values())
