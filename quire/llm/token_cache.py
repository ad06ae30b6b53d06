"""Token counts with a digest cache.

``count_tokens`` joins the digests of normalised content and of the tokenizer to stored counts, encodes each distinct
content that has none, and appends those counts to the cache (a Parquet folder).  Normalisation changes nothing that
the tokenizer sees: ASCII letters are lowered and runs of ASCII white space become one space, both of which the
tokenizer does itself; texts holding ``<|`` (special strings are matched before that) are digested as they are.

Defined cases: null text counts as empty (0 tokens); repeated rows and repeated texts get equal counts from one
encoding; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_slices, text_bytes
from .tokenize import PieceCounter, encoder, tokenizer_digest, tokenizer_path

CACHE = "content_digest string, tokenizer_digest string, n_tokens long"


def content_digest(text: Column, lowers: bool = True) -> Column:
    plain = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    if lowers:
        plain = F.translate(plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.sha2(F.when(F.contains(text, F.lit("<|")), F.concat(F.lit("\x00"), text)).otherwise(plain), 256)


def read_cache(spark, path: str) -> DataFrame:
    """The stored counts; empty where nothing was stored yet.  A count appended twice counts once."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    df = spark.read.schema(CACHE).parquet(path) if there else spark.createDataFrame([], CACHE)
    return df


def encode_counts(misses: DataFrame, tokenizer: str) -> DataFrame:
    """(content_digest, tokenizer_digest, n_tokens) of (content_digest, text) rows."""
    version = tokenizer_digest(tokenizer_path(tokenizer))

    def run(batches):
        enc = encoder(PieceCounter, tokenizer)
        for pdf in batches:
            texts = pdf["text"].tolist()
            counts = []
            for a, b in row_slices(text_bytes(texts)):
                counts += enc.values(texts[a:b])
            yield pdf[["content_digest"]].assign(tokenizer_digest=version, n_tokens=counts)

    return misses.select("content_digest", "text").mapInPandas(run, CACHE)


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str = "word_bpe_49k.json",
                 text: str = "text") -> DataFrame:
    """``docs`` keyed by digest with n_bytes and n_tokens; new counts are appended to ``cache_path``.

    Returns the columns of ``docs`` except ``text``, then content_digest, n_bytes, n_tokens.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path(tokenizer))
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumns({"content_digest": content_digest(body), "n_bytes": F.octet_length(body).cast("long")})
    stored = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version)
    # One text per digest; partial aggregation leaves one row per digest and input split, however many copies there are.
    contents = keyed.select("content_digest", body.alias("text")).groupBy("content_digest").agg(
        F.first("text").alias("text"))
    misses = contents.join(stored, "content_digest", "left_anti")
    encode_counts(misses, tokenizer).write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(
        F.min("n_tokens").alias("n_tokens"))
    return keyed.drop(text).join(counts, "content_digest")
