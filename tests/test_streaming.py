"""The append-mode map: several triggers, a restart, and the same ids as the batch."""

import glob
import pickle
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import functions as F

from quire.operators import tokens as TK
from quire.plans import catalog as C
from quire.streaming.prepare import stream_map, stream_transform


def test_map_restarts_and_equals_the_batch(spark, tmp_path):
    rows = [(i, f"a b{i % 5} {'c ' * (i % 7)}é") for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(rows, "k long, t string")
    vocab = TK.build_vocab(df, "t", 6)
    encode = TK.row_encoder(vocab)
    source, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for part in range(3):
        df.filter(F.col("k") % 3 == part).repartition(2).write.mode("append").parquet(source)
        for _ in range(2):  # the second run finds nothing new
            stream_map(spark, source, df.schema, lambda s: s.select("k", encode(F.col("t")).alias("ids")), out, ckpt,
                       max_files_per_trigger=1)
    got = {r["k"]: r["ids"] for r in spark.read.parquet(out).collect()}
    want = {r["k"]: r["ids"] for r in TK.encode(df, ["k"], {"ids": ("t", False)}, vocab).collect()}
    assert got == want and spark.read.parquet(out).count() == len(rows)


def test_tokens_that_share_a_hash():
    words = [f"w{i}" for i in range(50)] + ["é", "日本", "</s>", ""]
    asked = [*words, "none", "w50", "日"]
    want = {w: i + 3 for i, w in enumerate(words)} | {"none": 0, "w50": 0, "日": 0}
    for mod in (1, 7, 1 << 60, None):
        hashes = TK.token_hashes() if mod is None else lambda tokens: np.array(
            [zlib.crc32(t.encode()) % mod for t in tokens.to_pylist()], np.uint64)
        arrays = TK.token_arrays(pa.chunked_array([words], pa.string()), pa.chunked_array([range(3, 57)], pa.int32()), hashes)
        assert TK.token_finder(hashes)(arrays, asked, 0) == want
        none = TK.token_arrays(pa.chunked_array([[]], pa.string()), pa.chunked_array([[]], pa.int32()), hashes)
        assert TK.token_finder(hashes)(none, ["a"], 0) == {"a": 0}


def test_a_shipped_vocabulary_is_small():
    words, hashes = [f"token{i}" for i in range(100_000)], TK.token_hashes()
    arrays = TK.token_arrays(pa.chunked_array([words]), pa.chunked_array([range(100_000)], pa.int32()), hashes)
    h, tokens, ids, shared = back = pickle.loads(pickle.dumps(arrays))
    assert h.nbytes + ids.nbytes + tokens.nbytes < 32 * len(words) and not shared
    assert TK.token_finder(hashes)(back, ["token99999", "token7", "x"], 0) == {"token99999": 99999, "token7": 7, "x": 0}
    # What goes to the workers is found in no module of this package.
    assert b"quire" not in CloudPickleSerializer().dumps(arrays)
    assert all("<locals>" in f.__qualname__ for f in (hashes, TK.token_finder(hashes)))


def test_a_part_of_a_stream_is_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "stream_transform", lambda *a, **kw: (counted.append([len(glob.glob(
        f"{a[1]}/part={p}/*.parquet")) for p in kw["arrivals"]]), stream_transform(*a, **kw | {"arrivals": (None,)}))[1])
    counted = []
    docs = spark.createDataFrame([(i, f"a b c{i % 7} " * 30) for i in range(90)], "doc_id long, text string")
    docs.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = C.q_stream_pack(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert counted and min(counted[0]) > 1 and {r["n_ids"] for r in got} == {128}


def test_large_vocabularies_are_no_map(spark):
    vocab = spark.createDataFrame([("abc", 3), ("d", 4)], "token string, id int")
    with pytest.raises(ValueError, match="20 characters"):
        TK.row_encoder(vocab, max_chars=19)
    TK.row_encoder(vocab, max_chars=20)
