r"""Content-addressed archive of WARC records.

An archive is a folder of two tables.  ``payloads`` holds each distinct payload once, under its SHA-256; while it is
written, records that share that digest must also share SHA-1 and length, and when it is read, both are computed anew
from the stored bytes.  ``heads`` holds of every record the exact bytes before its payload: the WARC header and, for
HTTP records, the HTTP header, with the digest of the payload that follows.  A join of the two gives back the original
records byte by byte (``reconstruct``).

``archive_pages`` writes a record per page: of pages with equal payloads the one with the largest id is a response, the
others are revisits without a payload of their own, which refer to it.  ``archive_warc`` takes the records of WARC
files instead, whatever their types, and ``write_warc`` writes an archive's records as WARC files.

Only digests, ids and URLs are shuffled to find the response of a payload; payloads are shuffled once, after copies
within a task became one.  A payload that very many records share is one row of a table of digests, which is looked up
with ``lookup_join``.

Defined cases: null html is an empty payload; empty payloads are payloads like others; a null page_id counts as the
least and is written as ``null``; of repeated rows with the largest id one is the response, the others refer to it;
a null url is left out of the header, control characters and spaces in it are percent-encoded; very long payloads stay
whole (up to 2 GB, Spark's limit of a cell); an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .hotkeys import lookup_join

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages carry no time of capture.
DATE = "1970-01-01T00:00:00Z"
HEADS = "record string, head binary, digest binary"
_EMPTY = hashlib.sha256(b"").digest()


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are eight times 20, each four digits of base 32."""
    digest = F.sha1(payload)
    part = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*part), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def escaped_uri(url: Column) -> Column:
    """``url`` fit for a header line."""
    for code in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def page_heads(refs: DataFrame) -> DataFrame:
    """HEADS of (row, page_id, url, digest, sha1, n_bytes, best), best being the (page_id, row) of the response."""
    crlf = F.lit("\r\n")
    name = lambda page, row: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")),
                                      F.lit(":"), row.cast("string"), F.lit(">"))
    revisit = F.col("best.row") != F.col("row")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    record = name(F.col("page_id"), F.col("row"))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), record),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), escaped_uri(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("best.page_id"), F.col("best.row")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col(
            "n_bytes"))).cast("string")),
    ]
    head = F.encode(F.concat(F.concat_ws("\r\n", *lines), crlf, crlf, http), "UTF-8")
    return refs.select(record.alias("record"), head.alias("head"),
                       F.when(revisit, F.lit(_EMPTY)).otherwise(F.col("digest")).alias("digest"))


def store_payloads(payloads: DataFrame, path: str) -> None:
    """Write each of ``payloads`` (payload) once under its digest, and the empty one, which revisits have."""
    payloads = payloads.unionByName(payloads.sparkSession.createDataFrame([(bytearray(),)], "payload binary"))
    keyed = payloads.select(F.unhex(F.sha2("payload", 256)).alias("digest"), F.sha1("payload").alias("sha1"),
                            F.octet_length("payload").alias("n"), "payload")
    once = keyed.groupBy("digest").agg(F.first("payload").alias("payload"), *[
        f(F.struct("sha1", "n")).alias(k) for k, f in (("least", F.min), ("most", F.max))])
    sound = F.when(F.col("least") == F.col("most"), F.col("digest")).otherwise(
        F.raise_error(F.lit("two payloads share a digest")))
    once.select(sound.alias("digest"), "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def archive_pages(pages: DataFrame, path: str) -> None:
    """Write the records of ``pages`` (page_id, url, html) as an archive."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"))
    store_payloads(full.select("payload"), path)
    refs = stored(full.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", F.unhex(F.sha2(
        "payload", 256)).alias("digest"), base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast(
        "long").alias("n_bytes")), "page-digests")
    best = refs.groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("best"))
    page_heads(lookup_join(refs, best, ["digest"])).write.option("compression", "zstd").parquet(f"{path}/heads")


def read_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(heads, payloads) of an archive; reading a payload whose bytes do not have its digest is an error."""
    heads = spark.read.schema(HEADS).parquet(f"{path}/heads")
    payloads = spark.read.schema("digest binary, payload binary").parquet(f"{path}/payloads")
    sound = F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.lit("a stored payload does not have its digest")))
    return heads, payloads.select("digest", sound.alias("payload"))


#: Records of one payload that meet in a task, on average.
PAYLOAD_USES = 10_000


def whole_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, bytes) without the line ends that close a record.  A payload that many records share is copied once for
    every ``PAYLOAD_USES`` of them, and those are dealt to the copies."""
    heads, payloads = read_archive(spark, path)
    bare = F.col("digest") == F.lit(_EMPTY)
    copies = stored(heads.where(~bare).groupBy("digest").agg(F.ceil(F.count(F.lit(1)) / PAYLOAD_USES).cast("int").alias(
        "copies")), "payload-copies")
    dealt = lookup_join(heads.where(~bare), copies, ["digest"]).withColumn("copy", F.pmod(F.xxhash64("record", "head"), F.col(
        "copies")).cast("int")).drop("copies")
    held = payloads.join(copies, "digest").select("digest", "payload", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias(
        "copy"))
    payload = F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(F.raise_error(F.lit("a payload is missing")))
    return dealt.join(held, ["digest", "copy"], "left").select("record", F.concat("head", payload).alias(
        "bytes")).unionByName(heads.where(bare).select("record", F.col("head").alias("bytes")))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(record, bytes): the original records, with the two line ends that close them."""
    return whole_records(spark, path).withColumn("bytes", F.concat("bytes", F.lit(b"\r\n\r\n")))


def header_field(name: str, head: Column | str = "head") -> Column:
    """A field of the WARC header, null where it is not there."""
    value = F.regexp_extract(F.decode(head, "UTF-8"), rf"^(?i:[^\r]*\r\n(?:[^\r]+\r\n)*?{name}:)[ \t]*([^\r]*)\r\n", 1)
    return F.nullif(value, F.lit(""))


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of an archive of pages, read back: the fields
    from the headers, size and digest from the stored payload that the header's digest names."""
    heads, payloads = read_archive(spark, path)
    sums = payloads.select(base32_sha1(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast(
        "long").alias("payload_bytes"))
    id_of = lambda field: F.regexp_extract(field, "^<urn:page:([^:]*):", 1).try_cast("long")
    records = stored(heads.select(
        id_of(header_field("WARC-Record-ID")).alias("page_id"),
        F.regexp_extract(header_field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("payload_digest"),
        header_field("WARC-Type").alias("record_type"), id_of(header_field("WARC-Refers-To")).alias("refers_to")), "records")
    found = lookup_join(records, stored(sums, "payload-sums"), ["payload_digest"], "left")
    size = F.when(F.col("payload_bytes").isNotNull(), F.col("payload_bytes")).otherwise(
        F.raise_error(F.lit("a payload is missing")).cast("long"))
    return found.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


# ------------------------------------------------------------------ WARC files

_FIELD = re.compile(rb"\r\n([^:\r\n]+):[ \t]*([^\r\n]*)")


def file_records(stream) -> Iterator[tuple[bytes, bytes]]:
    """(head, payload) of the records of one uncompressed WARC stream, one at a time."""
    while True:
        lines, line = [], stream.readline()
        while line.strip() == b"" and line:
            line = stream.readline()
        if not line:
            return
        while line not in (b"\r\n", b""):
            lines.append(line)
            line = stream.readline()
        head = b"".join(lines) + line
        fields = {k.lower(): v for k, v in _FIELD.findall(b"\r\n" + head)}
        n = int(fields[b"content-length"])
        block = stream.read(n)
        if len(block) < n:
            raise ValueError("a WARC record is cut off")
        cut = block.find(b"\r\n\r\n") + 4 if fields.get(b"content-type", b"").startswith(b"application/http") else 0
        cut = cut if cut >= 4 else 0
        yield head + block[:cut], block[cut:]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record, head, payload) of all records of the WARC files under ``path`` (plain or gzip, one member or many).  A
    file is one task's work and is decompressed as a stream, so a worker holds the file's bytes and one record."""

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                raw = io.BytesIO(content)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
                rows, held = [], 0
                for head, payload in file_records(stream):
                    name = next((v for k, v in _FIELD.findall(b"\r\n" + head) if k.lower() == b"warc-record-id"), b"")
                    rows.append((name.decode(), head, payload))
                    held += len(head) + len(payload)
                    if held > 8_000_000:
                        yield pd.DataFrame(rows, columns=["record", "head", "payload"])
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=["record", "head", "payload"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "record string, head binary, payload binary")


def archive_warc(spark: SparkSession, warc_path: str, path: str) -> None:
    """Write the records of WARC files as an archive."""
    records = stored(read_warc(spark, warc_path), "warc-records")
    store_payloads(records.select("payload"), path)
    records.select("record", "head", F.unhex(F.sha2("payload", 256)).alias("digest")).write.option(
        "compression", "zstd").parquet(f"{path}/heads")


def write_warc(spark: SparkSession, path: str, warc_path: str) -> None:
    """Write an archive's records as gzip WARC files, one per task.  The two line ends that close a record are the text
    sink's line separator."""
    records = whole_records(spark, path).select(F.col("bytes").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc_path)
