"""What keeps queries in proportion to their input: plans and results of the steps that once were not."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from quire.functions.text import STRIP_RE, WS_CHARS, strip_ws
from quire.operators import metrics as MT
from quire.operators import parse as P
from quire.operators.choices import draw_positions, index_labels, with_absent
from quire.operators.sampling import draw_size
from quire.plans import builders as B


def plan(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lists_are_drawn_only_where_they_are_read(spark):
    vocab = index_labels(spark.createDataFrame([(x,) for x in "abcdef"], "label string"))
    d = spark.range(20).select(F.col("id").alias("k"), F.array(F.lit("a")).alias("own"))
    out = with_absent(d, ["k"], "own", {"x": 1, "y": 2}, vocab, 1, "t")
    assert "md5" in optimized(out) and "md5" not in optimized(out.groupBy().agg(F.count(F.lit(1))))
    assert "md5" not in optimized(out.select("k"))


def test_draws_of_a_row_with_null_keys(spark):
    d = spark.createDataFrame([(1, None, ["a"]), (None, "x", ["b"]), (2, "y", [])], "k long, s string, own array<string>")
    got = d.select(draw_positions(F.lit(2), F.col("own"), F.lit(9).cast("long"), 5, "t", ["k", "s"], "d").alias("p")).collect()
    import hashlib

    def positions(key, n):
        def digest(draw):
            return hashlib.md5("|".join(["5", "t", *[str(x) for x in key if x is not None], draw]).encode()).hexdigest()
        picked = []
        for j in range(9 - n, 9):
            t = int(int(digest(f"d:floyd:{j}")[:13], 16) / 2 ** 52 * (j + 1))
            picked.append(j if t in picked else t)
        return [i for _, i in sorted((digest(f"d:ord:{i}"), i) for i in picked)]

    assert [r["p"] for r in got] == [positions((1, None), 3), positions((None, "x"), 3), positions((2, "y"), 2)]


def test_lines_are_cut_once_a_text(spark):
    d = spark.createDataFrame([("a", "1", "x values：p，q\ny values：r", ["x", "y"])],
                              "task_dataset string, sample_id string, target string, answer_choices array<string>")
    text = optimized(P.entity_answers(B.noisy(d), " values"))
    # The lines are a generator's column; in the lambdas there is no text to cut again.
    assert "_lines#" in text.split("Generate")[0]


def test_strip_takes_what_the_pattern_takes(spark):
    texts = [None, "", " ", "a", *[f"{w}{v}a{w}b{v}{w}" for w in WS_CHARS for v in "\n \u2028"], "\u200bx\u200b", WS_CHARS,
             f"{WS_CHARS}é日{WS_CHARS}", "\x00a\x00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", strip_ws("t").alias("a"), F.regexp_replace("t", STRIP_RE, "").alias("b")).collect():
        assert r["a"] == r["b"] == (None if r["t"] is None else r["t"].strip())


def test_event_pieces(spark):
    lines = "head\nCore：a；Status：b；Core：c\nCore：Status：x；Parts：p， q，；；Parts：\n；Types：t，u"
    d = spark.createDataFrame([("e", "1", lines, None), ("e", "2", "", None), ("e", "3", None, None)],
                              "task_dataset string, sample_id string, target string, answer_choices array<string>")
    got = {r["sample_id"]: r["answers"] for r in P.event_answers(d, ["Core", "Status", "Types", "Parts"], ["Types", "Parts"]).collect()}
    assert [tuple(e) for e in got["1"]] == [
        (0, "c", "b", [], []), (1, "Status：x", "x", [], []), (2, "", "", ["t", "u"], [])]
    assert got["2"] == [] and got["3"] is None


@pytest.mark.parametrize("ignore", [None, -100])
def test_shifted_matches_with_nulls(spark, ignore):
    rows = [([1, 2, 3], [0, 1, 2]), ([1, None, 3], [0, 1, None]), ([], []), ([5], [5]), ([1], [0, 1, 7]),
            ([-100, 2], [9, -100, 2]), (None, [1, 2]), ([1, 2], None)]
    df = spark.createDataFrame(rows, "p array<int>, l array<int>")
    n, ok = MT.shifted_matches("p", "l", ignore)
    got = [tuple(r) for r in df.select(n, ok).collect()]
    want = []
    for p, lab in rows:
        if p is None or lab is None:
            want.append((None, None))
            continue
        k = max(len(lab) - 1, 0)
        a, b = p[:k], lab[1:1 + k]
        a = a + [None] * (len(b) - len(a))
        pairs = [(x, y) for x, y in zip(a, b) if ignore is None or (y is not None and y != ignore)]
        want.append((len(pairs), sum(x is not None and x == y for x, y in pairs)))
    assert [g if g[0] is not None and g[0] >= 0 else (None, None) for g in got] == want


def test_neighbours_are_joined_with_one_shuffle_of_texts(spark):
    ids = [0, 1, 2, 63, 64, 65, 65, 66, 66, 127, 128, 200, -1, -65, -64, None]
    docs = spark.createDataFrame([(i, None if n == 2 else f"t{n}", None if n == 3 else "ab"[n % 2])
                                  for n, i in enumerate(ids)], "doc_id long, text string, lang string")
    got = sorted(B.adjacent_pairs(docs).collect(), key=str)
    a = docs.select("doc_id", F.col("text").alias("text1"), F.col("lang").alias("lang1"))
    b = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("text2"), F.col("lang").alias("lang2"))
    want = a.join(b, "doc_id").select("doc_id", "text1", "text2", F.when(F.col("lang1") == F.col("lang2"), "1").otherwise("0").alias("label"))
    assert got == sorted(want.collect(), key=str) and len(got) > 8
    assert plan(B.adjacent_pairs(docs)).count("Exchange hashpartitioning") <= 2  # once in the tree, once in its details
    keys = optimized(B.adjacent_pairs(docs).select("doc_id"))
    assert "text" not in keys.split("Project", 1)[0] and "collect_list" not in keys


def test_sizes_are_drawn_where_the_rows_are(spark):
    dist = spark.createDataFrame([(2, 0.25), (5, 1.0)], "n int, cumulative double")
    d = spark.range(100).withColumn("v", F.col("id") / 100)
    out = draw_size(d, dist, F.col("v"), "m")
    assert "BroadcastHashJoin" in plan(out) and "SortMergeJoin" not in plan(out)
    assert {r["id"]: r["m"] for r in out.collect()} == {i: 2 if i < 25 else 5 for i in range(100)}


def test_submissions_are_planned_by_maker(spark):
    from quire.plans import catalog as C
    parsed = C._submission(spark, "/root/testdata/sf0.001")
    assert list(parsed) == list(C.ROUTES)
    # A route is planned over the predictions of its own maker.
    for task in ("relations", "normalization", "events", "findings", "report"):
        assert "Union" not in parsed[task]._jdf.queryExecution().analyzed().toString(), task
