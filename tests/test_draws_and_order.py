import pytest
from pyspark.sql import functions as F

from quire.functions.draws import draw_int, sql_u, u
from quire.operators import ordering as ORD
from quire.operators.sampling import insert_before_last, random_insert, sample_k


def test_draw_equals_duckdb(spark, duck):
    df = spark.range(50).select(F.col("id").alias("k"))
    got = {r.k: r.u for r in df.select("k", u(7, "t", ["k"], "d").alias("u")).collect()}
    want = dict(duck.execute(f"SELECT k, {sql_u(7, 't', ['k'], 'd')} FROM range(50) t(k)").fetchall())
    assert got == want
    assert all(0 <= x < 1 for x in got.values())


def test_draw_int_bounds(spark):
    r = spark.range(2000).select(draw_int(2, 9, u(1, "t", ["id"], "n")).alias("n")).agg(
        F.min("n"), F.max("n")).first()
    assert (r[0], r[1]) == (2, 9)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_global_index_dense_and_partition_free(spark, parts):
    df = spark.range(0, 3000, 3).repartition(parts)
    out = ORD.with_global_index(df, ["id"], "i", width=64, total="n").collect()
    pairs = sorted((r.id, r.i) for r in out)
    assert [i for _, i in pairs] == list(range(1000))
    assert all(r.n == 1000 for r in out)


def test_shards_blocks_and_empty_tail(spark):
    df = spark.range(10)
    out = {r.id: r.shard for r in ORD.assign_shard(df, 8, ["id"]).collect()}
    # ceil(10 / 8) = 2 rows per shard, shards 5-7 stay empty
    assert out == {i: i // 2 for i in range(10)}


def test_shard_count_above_rows(spark):
    out = ORD.assign_shard(spark.range(3), 8, ["id"]).collect()
    assert sorted(r.shard for r in out) == [0, 1, 2]


def test_batches_and_head_split(spark):
    b = ORD.assign_batch(spark.range(130), 64, ["id"]).groupBy("batch").count().collect()
    assert sorted((r.batch, r["count"]) for r in b) == [(0, 64), (1, 64), (2, 2)]
    s = ORD.head_split(spark.range(100), 5, ["id"]).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"validation": 5, "train": 95}


def test_cap_rows(spark):
    assert ORD.cap_rows(spark.range(20), 5, ["id"]).count() == 5
    assert ORD.cap_rows(spark.range(3), 5, ["id"]).count() == 3


@pytest.mark.parametrize("k", [0, 1, 37, 500])
def test_sample_k_exact(spark, k):
    df = spark.range(500)
    got = sample_k(df, ["id"], 5, "s", k=k)
    assert got.count() == k
    assert got.distinct().count() == k


def test_sample_k_matches_sort(spark):
    df = spark.range(300)
    ref = [r.id for r in df.orderBy(u(5, "s", ["id"], "sample"), "id").limit(40).collect()]
    got = sorted(r.id for r in sample_k(df, ["id"], 5, "s", k=40, n_buckets=8).collect())
    assert got == sorted(ref)


def test_sample_k_too_large_raises(spark):
    with pytest.raises(Exception):
        sample_k(spark.range(10), ["id"], 5, "s", k=11).collect()


def test_random_insert_sequential_semantics(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["x", "y"])], "k int, arr array<string>, items array<string>")
    row = df.select(random_insert(F.col("arr"), F.col("items"), 3, "t", ["k"]).alias("r"),
                    u(3, "t", ["k"], "ins0").alias("u0"), u(3, "t", ["k"], "ins1").alias("u1")).first()
    lst = ["a", "b", "c"]
    for item, uu in (("x", row.u0), ("y", row.u1)):
        lst.insert(int(uu * (len(lst) + 1)), item)
    assert row.r == lst


def test_insert_before_last_never_last(spark):
    df = spark.range(200).select(F.array(F.lit("a"), F.lit("b")).alias("arr"), u(1, "t", ["id"], "p").alias("u"))
    out = df.select(insert_before_last(F.col("arr"), F.lit("z"), F.col("u")).alias("r")).collect()
    assert all(r.r[-1] == "b" and len(r.r) == 3 for r in out)
    empty = spark.range(1).select(insert_before_last(F.array().cast("array<string>"), F.lit("z"), F.lit(0.5)).alias("r"))
    assert empty.first().r == ["z"]


def test_invariance_under_repartition(spark):
    from quire.plans import builders as B
    from conftest import SMALL
    from quire.session import table
    conv = table(spark, SMALL, "conversations")
    a = sorted(tuple(r) for r in B.build_dialogue(conv).collect())
    b = sorted(tuple(r) for r in B.build_dialogue(conv.repartition(7)).collect())
    assert a == b


@pytest.mark.parametrize("cap", [0, 1, 7, 40, 41, 99])
def test_cap_rows_cuts_in_any_bucket(spark, cap):
    df = spark.createDataFrame([(None if i == 0 else i * 3,) for i in range(41)], "id long")
    got = [r.id for r in ORD.cap_rows(df, cap, ["id"], width=10).collect()]
    assert sorted(got, key=lambda x: -1 if x is None else x) == ([None] + [i * 3 for i in range(1, 41)])[:cap]
