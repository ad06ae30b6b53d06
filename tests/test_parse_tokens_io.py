import json
import os

import pytest
from pyspark.sql import functions as F

from quire.operators import parse as P
from quire.operators import tokens as TK
from quire.sources import readers as R
from quire.sinks import writers as W

PRED = "input string, target string, answer_choices array<string>, task_type string, task_dataset string, sample_id string"


def preds(spark, rows):
    return spark.createDataFrame(rows, PRED)


def test_entity_round_trip(spark):
    from conftest import SMALL
    from quire.plans import builders as B
    from quire.plans.tasks import ENTITIES
    from quire.session import table
    samples = B.entity_samples(table(spark, SMALL, "events"))
    built = B.build_entities(samples)
    parsed = P.parse_entities(built, ENTITIES.words["line"])
    assert parsed.select("sample_id").distinct().count() == built.count()  # samples without a mention stay
    parsed = parsed.filter("entity is not null").select("sample_id", "type", "entity").distinct()
    exists = built.filter(F.col("target") != ENTITIES.words["none"])
    src = (samples.select(F.concat_ws("-", F.lit("entities"), F.col("user_id").cast("string"),
                                      F.col("day").cast("string")).alias("sample_id"), F.explode("ents").alias("e"))
           .select("sample_id", F.col("e.type").alias("type"), F.col("e.entity").alias("entity"))
           .join(exists.select("sample_id"), "sample_id", "left_semi").distinct())
    assert parsed.exceptAll(src).count() == 0 and src.exceptAll(parsed).count() == 0


KEYS = ("One：", "Two：")


def test_findings_report_events_and_unknown_task(spark):
    rows = [("i", "head\n a：positive \nb：odd\nc：d：e", ["positive"], "t", "findings", None),
            ("i", "nothing", ["positive"], "t", "findings", "s2")]
    f = P.parse_findings(preds(spark, rows), {"findings": "unclear"}).collect()
    assert [(r.sample_id, r.entity, r.attr) for r in f] == [
        ("xxxx", "a", "positive"), ("xxxx", "b", "unclear"), ("s2", None, None)]
    rep = preds(spark, [("i", "R\nOne：old\nTwo：x Two：rest\nOne：new ", None, "t", "report", "s")])
    got = {r.section: r.text for r in P.parse_report(rep, KEYS).collect()}
    assert got == {"One": "new", "Two": "rest"}
    ev = preds(spark, [("i", "head\nCore:x;Kinds:a, b,\n", None, "t", "events", "s")])
    got = [tuple(r)[1:] for r in P.parse_events(ev, ("Core", "Kinds"), ("Kinds",)).collect()]
    assert got == [("s", 0, "x", ["a", "b"]), ("s", 1, "", [])]
    with pytest.raises(Exception):
        bad = preds(spark, [("i", "x", None, "t", "nope", "s")])
        P.parse_answers(bad, {"label": P.label_answers})["label"].collect()


def test_folding_stops_after_a_hundred(spark):
    from quire.functions.text import fold_punctuation
    texts = ["a:b,c;d", ":" * 130 + ",;", "," * 101 + ":" * 100 + ";" * 99]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fold_punctuation("t")).collect()]
    assert got == [t.replace(":", "：", 100).replace(",", "，", 100).replace(";", "；", 100) for t in texts]


def test_labels_response_and_mask(spark):
    df = spark.createDataFrame([([1, 5, 6], [7, 2])], "p array<int>, r array<int>")
    ids, labels, mask = TK.labels_response("p", "r", 4)
    r = df.select(ids.alias("i"), labels.alias("l"), mask.alias("m")).first()
    assert (r.i, r.l, r.m) == ([1, 5, 6, 7], [-100, -100, -100, 7], [1, 1, 1, 1])


def _py_pack(seqs, b):
    flat = [x for s in seqs for x in s]
    n = len(flat) // b * b
    return [flat[i:i + b] for i in range(0, n, b)]


@pytest.mark.parametrize("batch_rows", [None, 2])
def test_pack_blocks_matches_reference_semantics(spark, batch_rows):
    seqs = [[1] * 5, [2] * 3, [3] * 7, [4], [5] * 2]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "k long, ids array<int>")
    got = TK.pack_blocks(df, "ids", 4, ["k"], batch_rows=batch_rows).orderBy("batch", "block").collect()
    if batch_rows:
        want = []
        for j in range(0, len(seqs), batch_rows):
            want += _py_pack(seqs[j:j + batch_rows], 4)
    else:
        want = _py_pack(seqs, 4)
    assert [r.input_ids for r in got] == want
    assert all(r.labels == r.input_ids for r in got)
    assert TK.pack_blocks(df.limit(1).filter("k = 3"), "ids", 4, ["k"]).count() == 0


def test_block_size_resolution():
    assert TK.resolve_block_size(None, 4096) == 2048
    assert TK.resolve_block_size(None, 512) == 512
    assert TK.resolve_block_size(8192, 4096) == 4096


def test_encode_unknown_and_bos(spark):
    df = spark.createDataFrame([(1, "a b zzz"), (2, "")], "k long, t string")
    vocab = TK.build_vocab(spark.createDataFrame([("a a b",)], "t string"), "t", 10)
    out = {r.k: r.ids for r in TK.encode(df, ["k"], {"ids": ("t", True)}, vocab).collect()}
    assert out == {1: [1, 3, 4, 0], 2: [1]}


def test_shape_columns(spark):
    df = spark.createDataFrame([("p", "c", "r")], "prompt string, chosen string, rejected string")
    assert TK.shape_columns(df, "preference").columns == ["input", "chosen", "rejected", "output"]
    with pytest.raises(NotImplementedError):
        TK.shape_preference(df, "other")


def test_json_sources(spark, tmpdir_fresh):
    arr = os.path.join(tmpdir_fresh, "a.json")
    with open(arr, "w") as f:
        json.dump([{"text": "甲", "label": "1"}, {"text": "乙　", "label": "0"}], f, ensure_ascii=False, indent=2)
    got = R.read_json_array(spark, arr, spark.createDataFrame([], "text string, label string").schema).collect()
    assert sorted((r.text, r.label) for r in got) == [("乙　", "0"), ("甲", "1")]
    keyed = os.path.join(tmpdir_fresh, "k.json")
    with open(keyed, "w") as f:
        json.dump({"7": {"dialogue": [{"sentence": "ab", "BIO_label": "B-s I-s"}]}}, f)
    from pyspark.sql import types as T
    vs = T.StructType([T.StructField("dialogue", T.ArrayType(T.StructType([
        T.StructField("sentence", T.StringType()), T.StructField("BIO_label", T.StringType())])))])
    k = R.read_keyed_json(spark, keyed, vs, "dialogue").first()
    assert (k.key, k.item.sentence, k.item.BIO_label.split(" ")) == ("7", "ab", ["B-s", "I-s"])
    convs = os.path.join(tmpdir_fresh, "c.json")
    with open(convs, "w") as f:
        json.dump([[{"id": "Patient", "Sentence": "hi"}, {"id": "Doctor", "Sentence": "yo"}], [{"id": "Doctor", "Sentence": "x"}]], f)
    c = R.read_conversations(spark, convs).orderBy("conv", "turn").collect()
    assert [(r.conv, r.turn, r.id) for r in c] == [(0, 0, "Patient"), (0, 1, "Doctor"), (1, 0, "Doctor")]


def test_tsv_bom_and_extensions(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "q.tsv")
    with open(p, "w") as f:
        f.write("1\tfirst query\n2\tsecond\n")
    got = R.read_tsv_pairs(spark, p, ["qid", "q"], ["bigint", "string"]).collect()
    assert [(r.qid, r.q) for r in got] == [(1, "first query"), (2, "second")]
    j = os.path.join(tmpdir_fresh, "b.jsonl")
    with open(j, "w") as f:
        f.write('{"text": "ok"}\n{"text": "bad﻿"}\n')
    rows = R.read_jsonl_text(spark, j, spark.createDataFrame([], "text string").schema).collect()
    assert [r.text for r in rows] == ["ok"]
    with pytest.raises(ValueError):
        R.read_by_extension(spark, train=os.path.join(tmpdir_fresh, "x.parquet"))
    with pytest.raises(ValueError):
        R.read_by_extension(spark)


def test_jsonl_keeps_nulls(spark, tmpdir_fresh):
    df = spark.createDataFrame([("i", "t", None, "x", "y", "s")], PRED)
    out = W.write_jsonl(df, os.path.join(tmpdir_fresh, "o"))
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".json"))
    assert '"answer_choices":null' in text
    back = R.read_jsonl(spark, out).first()
    assert back.answer_choices is None and back.sample_id == "s"


def test_metrics(spark):
    from quire.operators.metrics import capped_counts, perplexity, shifted_accuracy
    df = spark.createDataFrame([([5, 6, 7, 9], [0, 5, 6, 8])], "p array<int>, l array<int>")
    r = shifted_accuracy(df, "p", "l").first()
    assert (r.n_compared, r.n_correct) == (3, 2)
    big = perplexity(spark.createDataFrame([(800.0,)], "loss double"), "loss").first()
    assert big.perplexity == float("inf")
    assert capped_counts(spark.range(10), 4).first().samples == 4


def test_read_splits_and_submission(spark, tmpdir_fresh):
    for split in ("train", "validation"):
        with open(os.path.join(tmpdir_fresh, f"{split}.json"), "w") as f:
            f.write(json.dumps({"input": "q", "target": "a", "answer_choices": None, "task_type": "t",
                                "task_dataset": "d", "sample_id": split}) + "\n")
    df = R.read_splits(spark, tmpdir_fresh)
    assert sorted((r.split, r.sample_id) for r in df.collect()) == [("train", "train"), ("validation", "validation")]
    with pytest.raises(FileNotFoundError):
        R.read_splits(spark, os.path.join(tmpdir_fresh, "missing"))
    d = preds(spark, [("i", " yes ", None, "t", "pair_match", "s1"), ("i", "", None, "t", "terms", None)])
    routes = {"pair_match": lambda x: P.pair_label_answers(x, {}), "terms": lambda x: P.term_answers(x, "term"),
              "report": lambda x: P.report_answers(x, KEYS)}
    parsed = P.parse_answers(d, routes)
    got = sorted(tuple(r) for r in P.submission_counts(parsed).collect())
    assert got == [("pair_match", 1, 1), ("report", 0, 0), ("terms", 1, 0)]
    W.write_submission(parsed, os.path.join(tmpdir_fresh, "sub"))
    back = R.read_jsonl(spark, os.path.join(tmpdir_fresh, "sub"), W.SUBMISSION).collect()
    assert sorted((r.task_dataset, r.sample_id, r.answers) for r in back) == [
        ("pair_match", "s1", '[{"label":"yes"}]'), ("terms", "xxxx", "[]")]
    kept = W.attach_predictions(d, d.filter("sample_id = 's1'").select("sample_id", "target")).collect()
    assert len(kept) == 2


def test_replayed_batch_replaces_itself(spark, tmpdir_fresh):
    from quire.streaming.prepare import run_available_now, stream_file_source
    src, out = os.path.join(tmpdir_fresh, "src"), os.path.join(tmpdir_fresh, "out")
    spark.range(30).repartition(3).write.parquet(src)
    for k in range(2):  # a new checkpoint: every batch is replayed
        run_available_now(stream_file_source(spark, src, "id long", max_files_per_trigger=1), lambda b, e: b, out,
                          os.path.join(tmpdir_fresh, f"ckpt{k}"))
    back = spark.read.parquet(out)
    assert back.count() == 30 and back.select("batch").distinct().count() >= 3


def test_manifest_rows_and_names(spark, tmpdir_fresh):
    from quire.sinks.manifest import content_manifest, file_manifest
    df = spark.createDataFrame([(1, ["a, b"]), (2, ["a", "b"])], "k int, c array<string>")
    assert len({r.digest for r in content_manifest(df, ["k"], ["c"]).collect()}) == 2
    base = os.path.join(tmpdir_fresh, "sha256-folder")
    os.makedirs(base)
    for name in ("x.txt", "y.sha256"):
        with open(os.path.join(base, name), "w") as f:
            f.write("abc")
    assert [r.path.rsplit("/", 1)[1] for r in file_manifest(spark, base).collect()] == ["x.txt"]
