"""The content-addressed archive, collocations and tokenizer alignment against plain Python and by round trips."""

import gzip
import io

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SMALL
from quire.llm import alignment, collocations, warc
from quire.llm.common import scratch_path
from quire.llm.hotkeys import lookup_join


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


# ---------------------------------------------------------------- hot keys

@pytest.mark.parametrize("share", [1, 3, 1000])
def test_lookup_join(spark, share):
    left = [(1, i) for i in range(50)] + [(k, 100 + k) for k in range(2, 30)] + [(None, 7), (None, 8)]
    right = [(k, str(k)) for k in range(0, 20)]
    rows_df = spark.createDataFrame(left, "k long, v long")
    lookup = spark.createDataFrame(right, "k long, name string")
    names = dict(right)
    inner = lookup_join(rows_df, lookup, ["k"], hot_share=share)
    assert rows(inner, "k", "v", "name") == sorted(((k, v, names[k]) for k, v in left if k in names), key=str)
    outer = lookup_join(rows_df, lookup, ["k"], "left", share)
    assert rows(outer, "k", "v", "name") == sorted(((k, v, names.get(k)) for k, v in left), key=str)


# ---------------------------------------------------------------- archive

PAGES = "page_id long, url string, html string, record string, digest long"
AWKWARD_PAGES = [
    (1, "http://a", "x\r\n\r\ny"), (2, "http://b", "x\r\n\r\ny"), (2, "http://b", "x\r\n\r\ny"), (None, None, None),
    (5, "u r\nl\x7f", ""), (None, "z", None), (9, "é", "日本" * 200_000), (None, "q", "only null"), (None, "q", "only null"),
    (11, "http://c", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n\r\n"), (12, "", " "),
]


@pytest.fixture(scope="module")
def archive(spark):
    path = scratch_path(spark, "archive")
    warc.archive_pages(spark.createDataFrame([(*p, "x", 1) for p in AWKWARD_PAGES], PAGES).repartition(3), path)
    return path


def test_page_records(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html").collect()]
    got = E.queries()["op11_warc_archive"](spark, SMALL)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert rows(got) == brute.page_records(pages)


def test_awkward_pages(spark, archive):
    got = rows(warc.page_records(spark, archive))
    assert got == brute.page_records([(d, t) for d, _, t in AWKWARD_PAGES])
    payloads = warc.read_archive(spark, archive)[1]
    assert payloads.count() == len({t or "" for _, _, t in AWKWARD_PAGES})  # each once


def test_archive_round_trip(spark, archive, monkeypatch):
    first = {r["record"]: bytes(r["bytes"]) for r in warc.reconstruct(spark, archive).collect()}
    assert len(first) == len(AWKWARD_PAGES)
    files, again = scratch_path(spark, "warc"), scratch_path(spark, "archive")
    warc.write_warc(spark, archive, files)
    warc.archive_warc(spark, files, again)
    monkeypatch.setattr(warc, "PAYLOAD_USES", 1)
    assert {r["record"]: bytes(r["bytes"]) for r in warc.reconstruct(spark, again).collect()} == first
    for record in first.values():
        (head, payload), = warc.file_records(io.BytesIO(record))
        assert head + payload + b"\r\n\r\n" == record
        assert b"\r\n" not in head.split(b"\r\n\r\n")[0].split(b"WARC-Target-URI: ")[-1].split(b"\r\n")[0]


def test_foreign_warc_files(spark, tmp_path):
    """Records of any type, with binary payloads, bare line ends between them and one gzip member each."""
    records = [b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:1>\r\nContent-Length: 5\r\n\r\nab\xff\x00c\r\n\r\n",
               b"WARC/1.0\r\nwarc-record-id:<urn:2>\r\ncontent-type: application/http\r\ncontent-length: 25\r\n\r\n"
               b"HTTP/1.0 200 OK\r\n\r\n\xfe\r\n\r\n\x01\r\n\r\n",
               b"WARC/1.0\r\nWARC-Record-ID: <urn:3>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"]
    records[1] = records[1].replace(b"25", str(len(b"HTTP/1.0 200 OK\r\n\r\n\xfe\r\n\r\n\x01")).encode())
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "in" / "b.warc").write_bytes(b"".join(records[:2]).replace(b"<urn:", b"<urn:b"))
    path = scratch_path(spark, "archive")
    warc.archive_warc(spark, str(tmp_path / "in"), path)
    got = {r["record"]: bytes(r["bytes"]) for r in warc.reconstruct(spark, path).collect()}
    want = {f"<urn:{i + 1}>": r for i, r in enumerate(records)}
    assert got == want | {f"<urn:b{i + 1}>": r.replace(b"<urn:", b"<urn:b") for i, r in enumerate(records[:2])}


def test_damaged_payload_is_an_error(spark, archive):
    from pyspark.errors import PySparkException

    path = scratch_path(spark, "archive")
    heads, payloads = warc.read_archive(spark, archive)
    heads.write.parquet(f"{path}/heads")
    payloads.withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{path}/payloads")
    with pytest.raises(PySparkException, match="does not have its digest"):
        warc.page_records(spark, path).collect()


def test_empty_archive(spark):
    path = scratch_path(spark, "archive")
    warc.archive_pages(spark.createDataFrame([], PAGES), path)
    assert warc.page_records(spark, path).count() == 0 and warc.reconstruct(spark, path).count() == 0


# ---------------------------------------------------------------- collocations

TEXTS = "lang string, text string, phrase string, chunk long"


def test_collocations_of_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("lang", "text").collect()]
    got = rows(E.queries()["op12_fingerprint_phrases"](spark, SMALL))
    assert got and got == brute.collocations(docs)


@pytest.mark.parametrize("chunk_words, bucket_values, sent", [(40, 30, 6), (1 << 20, 500_000, 6), (200, 10, 1)])
def test_awkward_collocations(spark, chunk_words, bucket_values, sent):
    """Chunks that cut texts, many buckets, and fingerprints of so few bits that most phrases collide."""
    rng = np.random.default_rng(4)
    docs = [(lang, " ".join(rng.choice(["a", "B", "c,", "d\t", "e.", "é", "f\x0b", "\x1cg", "ÀA"], 60)))
            for lang in ("en", None, "und", "", " x") for _ in range(4)]
    docs += [(None, None), ("en", ""), ("fr", ".,;"), ("fr", " \t\n"), ("de", "one"), ("en", "x y z " * 3000),
             ("en", "no end"), ("en", "x y z " * 20)]
    df = spark.createDataFrame([(*d, "p", 1) for d in docs], TEXTS).repartition(3)
    got = rows(collocations.collocations(df, least=5, top=7, chunk_words=chunk_words, bucket_values=bucket_values,
                                        sent_bytes=sent))
    assert got == brute.collocations(docs, least=5, top=7)


def test_scores_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("en", "a", 1, 4_000_000_000_000), ("en", "b", 1, 3), ("en", "a b", 2, 3)],
                                    "lang string, phrase string, words int, a long")
    totals = spark.createDataFrame([("en", 9_000_000_000_000_000)], "lang string, n long")
    got = collocations.collocation_scores(phrases, totals).first()
    assert got["score"] == 1000 * 3 * 9_000_000_000_000_000 // (4_000_000_000_000 * 3)


def test_first_rows_by_buckets(spark):
    data = [("en" if i % 3 else "fr", f"p{i:04d}", i % 50, i % 7) for i in range(2000)]
    df = spark.createDataFrame(data, "lang string, phrase string, score long, a long")
    got = [(r["lang"], r["rank"], r["phrase"]) for r in collocations.first_rows(df, 10, per_bucket=1).collect()]
    want = []
    for lang in ("en", "fr"):
        best = sorted((-s, -a, p) for x, p, s, a in data if x == lang)[:10]
        want += [(lang, i + 1, p) for i, (_, _, p) in enumerate(best)]
    assert sorted(got) == want


def test_no_collocations(spark):
    assert collocations.collocations(spark.createDataFrame([], TEXTS)).count() == 0


# ---------------------------------------------------------------- alignment

AWKWARD_TEXTS = [
    (None, None), (None, ""), (-1, " "), (-2, "  a  b   "), (-3, "a▁ b"), (-4, "<|endoftext|> <s> x </s><0x41>"), (12, "x y"),
    (-5, "你好 世界\n\n\tﬁ é  \x00\U0001f600"), (-6, "x" * 5000), (-7, " " * 4001 + "b"), (-7, " " * 4001 + "b"),
    (-8, "Mr. O'Neil 1234,567"), (-9, "á" * 300 + " \r\n 가나다 ​  end"), (-10, "word " * 40_000),
]
DOC_COLUMNS = "doc_id long, text string, chunk long, pairs string"


def test_alignment_of_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = E.queries()["op13_incidence_alignment"](spark, SMALL)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows(got) == brute.alignments(docs)


@pytest.mark.parametrize("chunk_chars", [10, 10_000_000])
def test_awkward_alignment(spark, chunk_chars):
    df = spark.createDataFrame([(*d, 3, "x") for d in AWKWARD_TEXTS], DOC_COLUMNS).repartition(2)
    assert rows(alignment.align_documents(df, chunk_chars=chunk_chars)) == brute.alignments(AWKWARD_TEXTS)


def test_no_documents_to_align(spark):
    assert alignment.align_documents(spark.createDataFrame([], DOC_COLUMNS)).count() == 0


def dense(m):
    out = np.zeros((m.rows, m.columns), dtype=np.int64)
    for i in range(m.rows):
        for j in range(m.indptr[i], m.indptr[i + 1]):
            out[i, m.indices[j]] += m.values[j]
    return out


@pytest.mark.parametrize("limit", [1, 5, 1 << 20])
def test_gustavson_equals_dense_products(limit):
    rng = np.random.default_rng(limit)
    for _ in range(20):
        shape = rng.integers(1, 9, 3)
        a, b = (rng.integers(-2, 3, s) * (rng.random(s) < 0.4) for s in (shape[:2], shape[1:]))
        sparse = []
        for m in (a, b):
            where = m != 0
            sparse.append(alignment.Csr(np.concatenate([[0], np.cumsum(where.sum(axis=1))]), np.nonzero(where)[1],
                                        m[where], m.shape[1]))
        assert (dense(alignment.gustavson(*sparse, limit)) == a @ b).all()
        assert (dense(sparse[0].transposed()) == a.T).all()


def test_links_and_groups_of_lengths():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        cuts = [np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n)), n)) for _ in "ab"]
        a, b = (np.diff(np.concatenate([[0], c])) for c in cuts)
        spans = [list(zip(np.cumsum(x) - x, np.cumsum(x))) for x in (a, b)]
        shared = [[max(0, min(e, f) - max(s, t)) for t, f in spans[1]] for s, e in spans[0]]
        assert (dense(alignment.overlap_links(a, b)) == np.array(shared)).all()
        ends = sorted(set(cuts[0]) & set(cuts[1]))
        group = lambda s: sum(e <= s for e in ends)
        together = [[int(group(s) == group(t)) for t, _ in spans[1]] for s, _ in spans[0]]
        assert (dense(alignment.group_links(a, b)) == np.array(together)).all()
        assert (dense(alignment.interval_matrix(b).transposed()) == dense(alignment.interval_transposed(b))).all()
