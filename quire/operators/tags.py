"""Sequence-tag decoding (WIN4, FLT4, FLT7).

Tags are a long table ``(key..., order..., ch, tag)``: one character and one
tag per position.  Contiguous positions of one entity type form an island
(``lag`` + running ``sum``); each island is one entity.  Rules kept from the
source behaviour:

* a ``B-`` tag right after the same type does not start a new entity
  (adjacent entities of one type merge);
* entities closed by ``O`` or by a type change are kept only the first time
  their text is seen for that type; the entity closed by the end of the
  sequence is always kept (``dedupe_tail=True`` dedupes it as well).

By default the windows partition by the sample key (one shuffle for the chain);
with ``bucket`` the ordered scans are split so a huge sample spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .choices import map_label
from .scan import keyed_runs


def tag_types(tags: DataFrame, key: Sequence[str], order: Sequence[str], mapping: Mapping[str, str],
              outside: str = "O", bucket: Column | None = None) -> DataFrame:
    """Position, entity type (null outside) and island id per tag row; unknown tags fail the job.

    With ``bucket`` the scans are split per (sample, bucket) (see ``scan.py``).
    """
    w = Window.partitionBy(*key).orderBy(*order)
    bad = F.raise_error(F.concat(F.lit("unknown tag: "), F.coalesce(F.col("tag"), F.lit("NULL"))))
    typ = F.when(F.col("tag") == outside, F.lit(None).cast("string")).otherwise(
        F.coalesce(map_label(F.col("tag"), mapping), bad))
    if bucket is not None:
        key, order = list(key), list(order)
        t = keyed_runs(tags.withColumn("_type", typ), key, order, bucket, "_type", "_island",
                       pos="_pos", total="_last")
        return t.withColumn("_pos", F.col("_pos").cast("int")).withColumn("_last", F.col("_last").cast("long"))
    t = (tags.withColumn("_pos", F.row_number().over(w)).withColumn("_type", typ)
         .withColumn("_last", F.count(F.lit(1)).over(Window.partitionBy(*key))))
    prev = F.lag("_type").over(w)
    start = F.col("_type").isNotNull() & (prev.isNull() | (prev != F.col("_type")))
    return t.withColumn("_island", F.sum(start.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def decode_tags(tags: DataFrame, key: Sequence[str], order: Sequence[str], mapping: Mapping[str, str],
                outside: str = "O", dedupe_tail: bool = False, bucket: Column | None = None) -> DataFrame:
    """One row per sample: ``sentence``, ``n_tags`` and ``ents`` = array<struct<pos, type, entity>>."""
    key = list(key)
    t = tag_types(tags, key, order, mapping, outside, bucket)
    chars = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", c))),
                                               lambda s: s[c]), "")
    sentences = t.groupBy(*key).agg(chars("ch").alias("sentence"), F.count(F.lit(1)).alias("n_tags"))
    isl = (t.filter(F.col("_type").isNotNull()).groupBy(*key, "_island")
           .agg(F.min("_pos").alias("pos"), F.max("_pos").alias("_end"), F.max("_last").alias("_last"),
                F.min("_type").alias("type"), chars("ch").alias("entity")))
    tail = F.col("_end") == F.col("_last")
    seen = F.row_number().over(Window.partitionBy(*key, "type", "entity", tail).orderBy("pos"))
    keep = (seen == 1) | (tail & F.lit(not dedupe_tail))
    if dedupe_tail:
        keep = F.row_number().over(Window.partitionBy(*key, "type", "entity").orderBy("pos")) == 1
    ents = (isl.withColumn("_keep", keep).filter("_keep")
            .groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "type", "entity"))).alias("ents")))
    return (sentences.join(ents, key, "left")
            .withColumn("ents", F.coalesce("ents", F.array().cast("array<struct<pos:int,type:string,entity:string>>"))))


def length_mismatches(df: DataFrame, text: str, n: str) -> DataFrame:
    """FLT7: rows whose text length (code points) differs from the parallel sequence length."""
    return df.filter(F.length(text) != F.col(n))
