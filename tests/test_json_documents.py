"""JSON documents cut into many splits give the elements that a parser of the whole document gives."""

import json
import random

import pytest
from pyspark.sql import types as T

from quire.sources import json_documents as J
from quire.sources import readers as R


@pytest.fixture(params=[40, 1000, 1 << 27])
def split_bytes(spark, request):
    names = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "8"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def awkward_string(rnd):
    return "".join(rnd.choice(['"', "\\", ",", "[", "]", "{", "}", "a", " ", "\n", "é", "日", '\\"', "\\\\,"]) for _ in range(rnd.randint(0, 12)))


def value(rnd, depth=0):
    kind = rnd.randint(0, 5 if depth < 3 else 2)
    if kind == 0:
        return rnd.choice([None, True, 1.5, -3, 10 ** 12])
    if kind <= 2:
        return awkward_string(rnd)
    if kind == 3:
        return {awkward_string(rnd) + str(i): value(rnd, depth + 1) for i in range(rnd.randint(0, 4))}
    return [value(rnd, depth + 1) for _ in range(rnd.randint(0, 4))]


def elements(spark, path):
    return {(r["file"].rsplit("/", 1)[1], r["element"]): json.loads(r["text"]) for r in J.read_elements(spark, path).collect()}


def test_elements_of_random_arrays(spark, tmp_path, split_bytes):
    rnd = random.Random(split_bytes)
    docs = {f"d{i}.json": [value(rnd) for _ in range(rnd.randint(0, 40))] for i in range(8)} | {
        "empty.json": [], "one.json": ["x,y"], "long.json": ["," * 500 + '"[' * 50, [[[]]], {}]}
    for i, (name, doc) in enumerate(docs.items()):
        text = json.dumps(doc, ensure_ascii=i % 2 == 0, indent=[None, 2, 0][i % 3])
        (tmp_path / name).write_text(("\ufeff" if i % 4 == 1 else "") + text + "\n" * (i % 3), encoding="utf-8")
    got = elements(spark, str(tmp_path))
    assert got == {(name, i): x for name, doc in docs.items() for i, x in enumerate(doc)}
    if split_bytes == 40:
        assert spark.read.option("lineSep", ",").text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start"
                                                                            ).distinct().count() > 100


def test_three_shapes(spark, tmp_path, split_bytes):
    rnd = random.Random(1)
    rows = [{"text": awkward_string(rnd), "n": i} for i in range(60)]
    (tmp_path / "rows.json").write_text(json.dumps(rows))
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.LongType())])
    got = R.read_json_array(spark, str(tmp_path / "rows.json"), schema)
    assert sorted(tuple(r) for r in got.collect()) == sorted((r["text"], r["n"]) for r in rows)
    whole = spark.read.schema(schema).option("multiLine", True).json(str(tmp_path / "rows.json"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    keyed = {f"k{i}, {awkward_string(rnd)}": {"dialogue": [{"s": awkward_string(rnd)} for _ in range(i % 4)]} for i in range(40)}
    (tmp_path / "keyed.json").write_text(json.dumps(keyed, indent=1))
    item = T.StructType([T.StructField("dialogue", T.ArrayType(T.StructType([T.StructField("s", T.StringType())])))])
    got = R.read_keyed_json(spark, str(tmp_path / "keyed.json"), item, "dialogue").collect()
    assert sorted((r["key"], r["pos"], r["item"]["s"]) for r in got) == sorted(
        (k, i, d["s"]) for k, v in keyed.items() for i, d in enumerate(v["dialogue"]))
    convs = [[{"id": str(i), "Sentence": awkward_string(rnd)} for i in range(c % 5)] for c in range(30)]
    (tmp_path / "convs.json").write_text(json.dumps(convs, ensure_ascii=False))
    got = R.read_conversations(spark, str(tmp_path / "convs.json")).collect()
    assert sorted((r["conv"], r["turn"], r["id"], r["Sentence"]) for r in got) == sorted(
        (c, t, x["id"], x["Sentence"]) for c, turns in enumerate(convs) for t, x in enumerate(turns))
