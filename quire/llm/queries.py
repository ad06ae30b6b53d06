"""Registered queries opN_<name> of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, collocations, cws, jaccard, langid, mixing, oracles, packing, secrets, spans, surrogates, token_cache, topk, warc
from .common import n_words, scratch_path, stored, table  # noqa: F401


def count_where(array: str, field: str, value) -> Column:
    return F.size(F.filter(array, lambda x: x[field] == F.lit(value))).cast("long")


#: Key of the surrogates' hash; a deployment passes its own secret.
SURROGATE_KEY = "surrogate-key-of-these-queries"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogates.replace_entities(table(spark, sf_dir, "documents"), SURROGATE_KEY)
    counts = [count_where("entities", "kind", k).alias(f"n_{k}") for k, _ in surrogates.TYPES]
    return out.select("doc_id", "text", *counts)


def op2_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "taken")


def op3_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("key"), F.col("source").alias("owner"),
        F.col("doc_id").alias("repository"), "text")
    found = secrets.scan_secrets(docs)
    base = F.filter("spans", lambda s: s["ord"] < len(secrets.BASE))
    counts = [count_where("spans", "ord", k).alias(f"n_{kind[0]}") for k, kind in enumerate(secrets.BASE)]
    return found.select(
        "key.doc_id", *counts, F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_owner_specific"))


def op5_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_cache.count_tokens(docs, scratch_path(spark, "token-cache")).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op6_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.fit(docs.where(~F.col("held_out")).select("doc_id", "lang", "text"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select(
        "doc_id", "held_out", F.col("language.lang").alias("lang_pred"), "language.score",
        F.col("language.bits").alias("bits_per_char"))


def op7_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op10_columnar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("id % 20 = 0"))


def op11_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc-archive")
    warc.archive_pages(table(spark, sf_dir, "pages"), path)
    return warc.page_records(spark, path)


def op12_fingerprint_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_incidence_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii_surrogates, op2_cube_mixing, op3_certified_packing, op4_secret_ownership,
                            op5_token_cache, op6_cross_parsing, op7_suffix_automata, op8_parity_join,
                            op9_weighted_sampling, op10_columnar_topk, op11_warc_archive,
                            op12_fingerprint_phrases, op13_incidence_alignment)
}
ORACLES: dict[str, Callable[[], str]] = {f.__name__: f for f in (
    oracles.op4_secret_ownership, oracles.op7_suffix_automata, oracles.op8_parity_join, oracles.op10_columnar_topk,
    oracles.op11_warc_archive, oracles.op12_fingerprint_phrases)}
