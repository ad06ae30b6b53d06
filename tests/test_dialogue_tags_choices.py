import pytest
from pyspark.sql import functions as F

from quire.operators.choices import absent_by_join, absent_from_list, index_labels, with_absent
from quire.operators.dialogue import (history_rows, merge_turns, pair_turns, require_first_role,
                                      validate_domain)
from quire.operators.tags import decode_tags

TURNS = "conv_id long, turn long, role string, text string"


def test_dialogue_rules(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d"),
            (2, 0, "assistant", "x"), (2, 1, "user", "y")]
    t = require_first_role(spark.createDataFrame(rows, TURNS), "user")
    pairs = pair_turns(merge_turns(t), "user", "assistant")
    out = history_rows(pairs, "\n\nU: ", "\n\nA: ").collect()
    assert [(r.conv_id, r.i, r.prompt, r.reply, r.history) for r in out] == [(1, 0, "a\nb", "c", "U: a\nb")]


def test_history_blocks_equal_one_window(spark, monkeypatch):
    """One conversation holds a third of the rows; small blocks give the same prefixes."""
    from quire.operators import dialogue as D
    rows = [(1, i, f"p{i}", f"r{i}") for i in range(40)] + [(c, i, f"p{c}{i}", f"r{c}{i}") for c in range(2, 18) for i in range(5)]
    pairs = spark.createDataFrame(rows, "conv_id long, i int, prompt string, reply string")
    want = {}
    for c, i, p, r in rows:
        want[c, i] = "".join(f"U{b}A{x}" for k, j, b, x in rows if k == c and j < i) + f"U{p}"
    for size in (1, 7, 64):
        monkeypatch.setattr(D, "HISTORY_BLOCK", size)
        got = {(r.conv_id, r.i): r.history for r in D.history_rows(pairs, "U", "A").collect()}
        assert got == want


def test_unknown_role_raises(spark):
    df = spark.createDataFrame([(1, 0, "robot", "a")], TURNS)
    with pytest.raises(Exception):
        validate_domain(df, "role", ["user", "assistant"]).collect()


TAGS = {"B-s": "S", "I-s": "S", "B-d": "D", "I-d": "D"}


def _decode(spark, chars, tags, dedupe_tail=False):
    rows = [(1, i, c, t) for i, (c, t) in enumerate(zip(chars, tags))]
    df = spark.createDataFrame(rows, "k int, pos int, ch string, tag string")
    r = decode_tags(df, ["k"], ["pos"], TAGS, dedupe_tail=dedupe_tail).first()
    return r.sentence, [(e.type, e.entity) for e in r.ents]


def test_tag_decoding_rules(spark):
    # adjacent same-type entities merge; an O-closed repeat is deduplicated; the tail repeat is kept
    chars = "abXabYcdab"
    tags = ["B-s", "I-s", "O", "B-s", "I-s", "O", "B-d", "B-s", "B-s", "I-s"]
    sent, ents = _decode(spark, chars, tags)
    assert sent == chars
    assert ents == [("S", "ab"), ("D", "c"), ("S", "dab")]
    _, ents2 = _decode(spark, "abXab", ["B-s", "I-s", "O", "B-s", "I-s"])
    assert ents2 == [("S", "ab"), ("S", "ab")]
    _, ents3 = _decode(spark, "abXab", ["B-s", "I-s", "O", "B-s", "I-s"], dedupe_tail=True)
    assert ents3 == [("S", "ab")]


def test_unknown_tag_raises(spark):
    with pytest.raises(Exception):
        _decode(spark, "a", ["B-zz"])


VOCAB = [f"l{i:02d}" for i in range(30)]


def _check_absent(rows, own_of, n):
    for key, got in rows:
        own = own_of[key]
        avail = [v for v in VOCAB if v not in own]
        assert len(got) == min(n, len(avail))
        assert len(set(got)) == len(got)
        assert not set(got) & set(own)
        assert set(got) <= set(VOCAB)


@pytest.mark.parametrize("n", [0, 1, 3, 40])
def test_absent_choices_both_paths(spark, n):
    own_of = {0: [], 1: ["l01", "l05"], 2: VOCAB[:], 3: VOCAB[:-2]}
    df = spark.createDataFrame(list(own_of.items()), "k int, own array<string>")
    small = df.select("k", absent_from_list(F.col("own"), VOCAB, n, 1, "t", ["k"]).alias("a")).collect()
    _check_absent([(r.k, r.a) for r in small], own_of, n)
    vocab = spark.createDataFrame([(v,) for v in VOCAB], "label string")
    big = absent_by_join(df, ["k"], "own", n, vocab, 1, "t", "a", small=2, page=3).select("k", "a").collect()
    _check_absent([(r.k, r.a) for r in big], own_of, n)


def _random_turns(spark, n_conv=6, n_turn=40, seed=3):
    import random
    rnd = random.Random(seed)
    rows = [(c, t, rnd.choice(["user", "assistant"]), f"t{c}-{t}") for c in range(n_conv) for t in range(n_turn)]
    return spark.createDataFrame(rows, TURNS)


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_bucketed_runs_equal_plain(spark, width):
    from quire.operators.dialogue import run_ids
    df = _random_turns(spark)
    plain = sorted(tuple(r) for r in run_ids(df).collect())
    split = sorted(tuple(r) for r in run_ids(df, bucket=F.floor(F.col("turn") / width)).collect())
    assert plain == split


@pytest.mark.parametrize("width", [1, 4])
def test_bucketed_tags_equal_plain(spark, width):
    import random
    rnd = random.Random(7)
    tags = ["O", "B-s", "I-s", "B-d", "I-d"]
    rows = [(k, i, chr(97 + rnd.randrange(3)), rnd.choice(tags)) for k in range(5) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, pos int, ch string, tag string")
    a = sorted((r.k, r.sentence, str(r.ents)) for r in decode_tags(df, ["k"], ["pos"], TAGS).collect())
    b = sorted((r.k, r.sentence, str(r.ents)) for r in
               decode_tags(df, ["k"], ["pos"], TAGS, bucket=F.floor(F.col("pos") / width)).collect())
    assert a == b


def test_list_and_join_forms_agree(spark):
    """One definition: the literal look-up and the join give the same labels, whatever the sizes."""
    own_of = {i: VOCAB[i % 7:i % 11 + i % 5] for i in range(40)}
    df = spark.createDataFrame([(k, v, k % 6) for k, v in own_of.items()], "k int, own array<string>, n int")
    vocab = spark.createDataFrame([(v,) for v in VOCAB + VOCAB[:9]], "label string")
    a = df.select("k", absent_from_list(F.col("own"), VOCAB, F.col("n"), 1, "t", ["k"]).alias("a")).collect()
    for small, page in ((100, 1), (2, 3), (0, 1000), (len(VOCAB) - 1, 1)):
        b = absent_by_join(df, ["k"], "own", F.col("n"), vocab, 1, "t", "a", small=small, page=page).select("k", "a").collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_pages_hold_the_sorted_vocabulary(spark):
    labels = [f"{'x' * (i % 9)}{i * 7919 % 503}é" for i in range(700)] + ["", "\U0001f600", "日本"]
    df = spark.createDataFrame([(v,) for v in labels + labels[:50] + [None]], "label string")
    v = index_labels(df, small=10, page=16)
    pages = [r["_labels"] for r in v.pages.orderBy("_page").collect()]
    want = sorted(set(labels), key=str.encode)
    assert [x for p in pages for x in p] == want and v.size == len(want)
    assert {len(p) for p in pages[:-1]} == {16}


@pytest.mark.parametrize("small", [0, 1000])
def test_lists_are_drawn_together(spark, small):
    """Several lists at once are those drawn one by one; keys of two columns may be null."""
    rows = [(i if i % 3 else None, str(i), VOCAB[i % 5:i % 9]) for i in range(30)] + [(1, None, None)]
    df = spark.createDataFrame(rows, "a int, b string, own array<string>")
    vocab = spark.createDataFrame([(v,) for v in VOCAB], "label string")
    lists = {"one": 1, "more": F.size(F.coalesce("own", F.array().cast("array<string>"))) + 2, "none": 0}
    both = with_absent(df, ["a", "b"], "own", lists, index_labels(vocab, small=small, page=7), 5, "t")
    assert both.count() == len(rows)
    for name, n in lists.items():
        one = absent_by_join(df, ["a", "b"], "own", n, vocab, 5, "t", name, draw=name)
        cols = ["a", "b", name]
        assert sorted(map(str, both.select(*cols).collect())) == sorted(map(str, one.select(*cols).collect()))


def test_normalization_choices_are_valid(spark):
    from conftest import SMALL
    from quire.plans import builders as B
    from quire.plans.tasks import NORMALIZATION
    from quire.session import table
    part = table(spark, SMALL, "part")
    names = {r.p_name for r in part.select("p_name").distinct().collect()}
    samples = {(r.p_brand, r.p_size): r.names for r in B.normalization_samples(part).collect()}
    rows = B.build_normalization(B.normalization_samples(part), vocab=B.part_name_vocab(part)).collect()
    assert len(rows) == len(samples)
    for r in rows:
        brand, size = r.sample_id.split("-", 1)[1].rsplit("-", 1)
        own = samples[(brand, int(size))]
        ch = r.answer_choices
        assert len(set(ch)) == len(ch) and set(ch) <= names
        if r.target == NORMALIZATION.words["none"]:
            assert not set(ch) & set(own) and 2 <= len(ch) or len(names) - len(own) < 2
        else:
            assert r.target == "，".join(own)
            assert [c for c in ch if c in own] == own and 1 <= len(ch) - len(own) <= 3
