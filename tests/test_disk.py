"""What lies on the disk, and for how long."""

import gzip
import json
import os
import time
import uuid

from pyspark.sql import functions as F

from quire.llm import jaccard
from quire.llm.common import stored
from quire.scratch import _CLEANUP_CONF, dropped, released_shuffles
from quire.sinks import writers as W
from quire.sources.positions import read_lines


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for _, _, names in os.walk(d.getAbsolutePath()) for f in names if f.startswith("shuffle_")}


def left_over(spark, before, seconds=10):
    """Shuffle files that came since ``before`` and don't go within some seconds."""
    until = time.time() + seconds
    while (rest := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return rest


def folders(spark):
    top = f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/quire-io"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_shuffle_files_go_with_their_query(spark):
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before, set_before = shuffle_files(spark), spark.conf.get(_CLEANUP_CONF, None)
    table = stored(df, "t")
    assert not left_over(spark, before)
    assert spark.conf.get(_CLEANUP_CONF, None) == set_before
    assert sorted(r["count"] for r in table.collect()) == [142] + [143] * 6
    # What was given back is made anew where it is asked for again.
    with released_shuffles(spark), released_shuffles(spark):
        assert df.count() == df.count() == 7 and len(df.collect()) == len(df.collect()) == 7
    assert spark.conf.get(_CLEANUP_CONF, None) == set_before


def test_tables_are_dropped(spark):
    before = folders(spark)
    kept, gone = stored(spark.range(3), "kept"), stored(spark.range(3).withColumn("_scratch_path", F.lit(1)), "gone")
    dropped(gone, spark.range(3), spark.range(3).withColumnRenamed("id", "_scratch_path"))
    assert {f.rsplit("-", 1)[0] for f in folders(spark) - before} == {"kept"} and kept.count() == 3


def test_near_duplicates_keep_what_is_read(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:59], f"x{i}"])) for i in range(20)] + [(100 + i, f"a text apart {i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before, files = folders(spark), shuffle_files(spark)
    classes = jaccard.near_duplicates(docs)
    left = {f.rsplit("-", 1)[0] for f in folders(spark) - before}
    assert left <= {"shingle-sets", "distinct-sets", "roots-1", "roots-2", "small-star"}, left
    assert not left_over(spark, files)
    assert {r["component_id"] for r in classes.collect()} == {0, *range(100, 120)}
    assert classes.count() == 40


ANSWERS = "task_dataset string, sample_id string, answers array<struct<type:string,entity:string>>"


def submission(spark):
    rows = {"a": [("a", f"s{i:03d}", [("t", f"é{i}")] * (i % 3)) for i in range(100)], "b": [],
            "c": [("c", None, [("t", "x")])] * 5 + [("a", "s000", [])] * 2}
    return {t: spark.createDataFrame(r, ANSWERS).repartition(3) for t, r in rows.items()}


def check_document(text):
    doc = json.loads(text)
    assert list(doc) == ["a", "b", "c"] and [len(x) for x in doc.values()] == [102, 0, 5]
    assert [x["sample_id"] for x in doc["a"]] == ["s000"] * 3 + [f"s{i:03d}" for i in range(1, 100)]


def test_submission_document_lies_there_once(spark, tmp_path):
    frames, before, files = submission(spark), folders(spark), shuffle_files(spark)
    path = W.write_submission_document(frames, str(tmp_path / "all.json"))
    with open(path, encoding="utf-8") as f:
        check_document(f.read())
    # The lines and the parts are gone; the folder that the whole was made in is empty.
    assert {f.rsplit("-", 1)[0] for f in folders(spark) - before} <= {"joined-parts"}
    assert not left_over(spark, files)


def test_packed_parts_are_copied_to_their_places(spark, tmp_path):
    texts = ["one\ntwo\n", "", "é日\n" * 5000, "\nend\n"]
    for i, text in enumerate(texts):
        with gzip.open(tmp_path / f"part-{i:05d}.txt.gz", "wt", encoding="utf-8") as f:
            f.write(text)
    for size in (7, 1 << 20):
        path = W.join_parts(spark, str(tmp_path), str(tmp_path / f"whole-{size}"), copy_bytes=size)
        with open(path, encoding="utf-8", newline="") as f:
            assert f.read() == "".join(texts)


def test_submission_document_in_a_store(spark, tmp_path, monkeypatch):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.quire.link./top", f"file://{tmp_path}")
    monkeypatch.setattr(W, "scratch_path", lambda s, name: f"viewfs://quire/top/scratch/{name}-{uuid.uuid4().hex}")
    W.write_submission_document(submission(spark), "viewfs://quire/top/deep/all.json")
    check_document((tmp_path / "deep" / "all.json").read_text(encoding="utf-8"))


def test_lines_meet_their_splits_without_a_shuffle(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n\nz\n")
    d = read_lines(spark, str(tmp_path / "a.txt"))
    assert "BroadcastHashJoin" in d._jdf.queryExecution().executedPlan().toString()
    assert [(r["position"], r["value"]) for r in d.orderBy("position").collect()] == [(0, "x"), (1, "y"), (2, ""), (3, "z")]
