"""Encoding by chunk dictionaries: the same ids whatever the chunks, and no exchange of token occurrences."""

import datetime

import pytest
import regex
from pyspark.sql import functions as F

from quire.operators import tokens as TK
from quire.operators.chunks import token_counts
from quire.operators.ordering import prefix_bits, with_global_index

TEXTS = ["a a b </s> c_1", "", None, "été 12½ <s>x", "日本語 テ！", "a " * 400 + "z", "q", "b\n\ta\r\x0bc\fd", "\U0001f600 é"]


def by_hand(text, ids, bos):
    return ([TK.BOS_ID] if bos else []) + [ids.get(t, TK.UNK_ID) for t in regex.findall(TK.TOKEN_RE, text or "")]


@pytest.mark.parametrize("chunk_tokens", [1, 30, 1 << 20])
def test_encode_by_chunks(spark, chunk_tokens, monkeypatch):
    from quire.operators import chunks

    rows = [(i, None if i == 3 else datetime.date(2020, 1, i + 1), t, TEXTS[-1 - i]) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "k long, day date, t string, s string").repartition(3)
    vocab = TK.build_vocab(df, "t", 8)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    coded = chunks.code_tokens(df, ["k", "day"], {"x": "t", "y": "s"}, TK.TOKEN_RE, chunk_tokens)
    got = {r["k"]: r for r in TK.encode_texts(coded, vocab, ["x"]).collect()}
    assert len(got) == len(rows)
    for k, day, t, s in rows:
        assert got[k]["day"] == day
        assert got[k]["x"] == by_hand(t, ids, True) and got[k]["y"] == by_hand(s, ids, False)
    sizes = {r["k"]: r["_n"] for r in TK.coded_sizes(coded, ["k"], "x", bos=True).collect()}
    assert sizes == {k: len(got[k]["x"]) for k in got}
    both = [t for r in rows for x in r[2:] for t in regex.findall(TK.TOKEN_RE, x or "")]
    assert {r["token"]: r["count"] for r in token_counts(coded).collect()} == {t: both.count(t) for t in set(both)}


def test_no_texts_to_encode(spark):
    df = spark.createDataFrame([], "k long, t string")
    assert TK.encode(df, ["k"], {"ids": ("t", True)}, TK.build_vocab(df, "t")).count() == 0


def test_vocab_order(spark):
    counts = {"b": 3, "a": 3, "common": 500, "comment": 500, "rare": 1, "rarer": 1, "Ω": 1, "": 2, "often": 200, "of": 127, "to": 128}
    df = spark.createDataFrame(list(counts.items()), "token string, count long")
    got = [r["token"] for r in TK.vocab_of_counts(df).orderBy("id").collect()]
    assert got == list(TK.SPECIALS) + sorted(counts, key=lambda t: (-counts[t], t.encode()))


def test_prefix_order(spark):
    words = ["", "a", "aa", "ab", "a\x00", "abcdefgh", "abcdefgi", "abcdefg", "é", "日本", "\U0001f600", "Z", "~"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for n in (1, 3, 7):
        bits = [r[0] for r in df.orderBy("w").select(prefix_bits("w", n)).collect()]
        assert bits == sorted(bits)
    for levels in (1, 2, 3, 4):
        got = {r["w"]: (r["row_idx"], r["n"]) for r in with_global_index(
            df, ["w"], bucket=prefix_bits("w", 7), total="n", levels=levels).collect()}
        assert got == {w: (i, len(words)) for i, w in enumerate(sorted(words, key=str.encode))}


def test_occurrences_are_not_shuffled(spark):
    """Only the vocabulary explodes tokens; of the texts, a row per chunk and distinct token is joined to it."""
    df = spark.createDataFrame([(i, "a b " * 50) for i in range(20)], "k long, t string")
    vocab = spark.createDataFrame([("a", 3), ("b", 4)], "token string, id int")
    out = TK.encode(df, ["k"], {"ids": ("t", False)}, vocab)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "MapInArrow" not in plan
    assert out.where(F.size("ids") == 100).count() == 20
    coded = TK.code_texts(df, ["k"], {"ids": "t"})
    assert coded.tokens.count() <= 2 * df.rdd.getNumPartitions()
