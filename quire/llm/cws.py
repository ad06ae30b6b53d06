"""Document fingerprints by consistent weighted sampling; DataFrame functions only.

A text is a vector of terms (lower-cased words) with their counts as weights.  For sample k a term draws, from a hash of
term and k alone, r and c from Gamma(2, 1) and b from [0, 1).  With t = floor(ln w / r + b) its sample value is
ln c - r * (t - b + 1), and the smallest value over the terms is the text's sample k.  Two texts have the same sample
with a probability equal to the generalised Jaccard similarity of their vectors, so the share of equal samples
estimates it.

r and ln c are read from quantile tables of 4096 entries, computed from the distribution function; b uses the hash's
remaining bits.

Defined cases: null text is empty; a text without a word has the fingerprint of infinities, like another empty text's
only; rows that repeat a doc_id are fingerprinted each, the next document being the next larger id and, there, the
text first in order; a null id counts as the least long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, stored

SAMPLES = 32
#: Samples that one row of the expanded term table computes side by side.
PER_ROW = 4
TABLE_BITS = 12


@lru_cache
def gamma_quantiles(n: int = 1 << TABLE_BITS) -> tuple[float, ...]:
    """Mid-point quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), by Newton's method."""
    out, x = [], 0.01
    for i in range(n):
        p = (i + 0.5) / n
        for _ in range(60):
            step = (1 - (1 + x) * math.exp(-x) - p) / (x * math.exp(-x))
            x = max(x - step, x / 8)
            if abs(step) < 1e-13 * x:
                break
        out.append(x)
    return tuple(out)


def sample_value(h: Column, log_weight: Column, r: Column, beta: Column, log_c: Column) -> Column:
    return log_c - r * (F.floor(log_weight / r + beta) - beta + F.lit(1.0))


def words(text: Column) -> Column:
    return F.split(F.lower(text), r"[\x20\x09-\x0D]+")


def fingerprints(terms: DataFrame, keys: list[str], weights: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and, for each weight column w, the array f_w of ``samples`` doubles.

    ``terms`` has one row per key and term: keys, term (long), and each weight (0: the term is not in that vector).
    Rows are expanded to samples / PER_ROW rows; everything groups by the keys and keeps a partitioning by them.
    """
    size = 1 << TABLE_BITS
    table = gamma_quantiles()
    r_table, c_table = (F.expr(f"array({', '.join(f'{x!r}D' for x in xs)})") for xs in (table, map(math.log, table)))
    logs = {w: F.when(F.col(w) > 0, F.ln(F.col(w).cast("double"))).alias(f"ln_{w}") for w in weights}
    wide = terms.select(*keys, "term", *logs.values()).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(samples // PER_ROW - 1))))
    draws = [F.xxhash64("term", F.col("part") * PER_ROW + i).alias(f"h{i}") for i in range(PER_ROW)]
    wide = wide.select(*keys, "part", *[f"ln_{w}" for w in weights], *draws)
    cols = []
    for i in range(PER_ROW):
        h = F.col(f"h{i}")
        cols += [F.get(r_table, h.bitwiseAND(size - 1).cast("int")).alias(f"r{i}"),
                 F.get(c_table, F.shiftright(h, TABLE_BITS).bitwiseAND(size - 1).cast("int")).alias(f"c{i}"),
                 (F.shiftrightunsigned(h, 2 * TABLE_BITS).cast("double") / F.lit(float(1 << (64 - 2 * TABLE_BITS)))
                  ).alias(f"b{i}")]
    wide = wide.select(*keys, "part", *[f"ln_{w}" for w in weights], *cols)
    mins = [F.min(sample_value(F.lit(0), F.col(f"ln_{w}"), F.col(f"r{i}"), F.col(f"b{i}"), F.col(f"c{i}"))).alias(
        f"{w}_{i}") for w in weights for i in range(PER_ROW)]
    slots = wide.groupBy(*keys, "part").agg(*mins)
    packed = slots.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", *[F.array(*[
        F.coalesce(F.col(f"{w}_{i}"), F.lit(float("inf"))) for i in range(PER_ROW)]).alias(w) for w in weights]))
    ).alias("slots"))
    return packed.select(*keys, *[F.flatten(F.col(f"slots.{w}")).alias(f"f_{w}") for w in weights])


def likeness(a: str, b: str) -> Column:
    same = F.zip_with(a, b, lambda x, y: x == y)
    return F.size(F.filter(same, lambda x: x)).cast("double") / F.size(a)


def printed(f: str) -> Column:
    """Eight hex digits for each sample."""
    return F.array_join(F.transform(f, lambda x: F.lower(F.lpad(F.hex(F.xxhash64(x)), 16, "0")).substr(1, 8)), "")


def neighbours(ids: DataFrame) -> DataFrame:
    """(id, next_id, prev_id) of distinct ids in ascending order, the last followed by the first.

    Ids are cut into ranges; a window in each range and a table with one row per range give the neighbours.
    """
    parts = shuffle_width(ids.sparkSession)
    ranged = stored(ids.distinct().repartitionByRange(parts, F.col("id")).withColumn("part", F.spark_partition_id()),
                    "ranges")
    edges = ranged.groupBy("part").agg(F.min(F.struct("id")).alias("low"), F.max(F.struct("id")).alias("high"))
    order, every = Window.orderBy("part"), Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select("part", F.coalesce(F.lead("low").over(order), F.first("low").over(every)).alias("after"),
                         F.coalesce(F.lag("high").over(order), F.last("high").over(every)).alias("before"))
    inside = Window.partitionBy("part").orderBy("id")
    own = F.struct("id")
    return ranged.select("id", "part", F.lead(own).over(inside).alias("n"), F.lag(own).over(inside).alias("p")).join(
        edges, "part").select("id", F.coalesce("n", "after")["id"].alias("next_id"),
                              F.coalesce("p", "before")["id"].alias("prev_id"))


def fingerprint_with_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Each row's fingerprint, that of its edited text (the last quarter replaced by the next document's beginning),
    and how alike it is to that and to the next document's fingerprint.

    The text is shuffled once, by id; what the edit takes from the next document is sent by that document.
    """
    null_id = F.lit(-(1 << 63)).cast("long")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), null_id).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    lengths = docs.select("id", F.char_length("text").alias("n"))
    near = stored(neighbours(docs.select("id")), "neighbours")
    # A document's edit takes floor(n / 4) characters; of rows with one id, the longest says how many are sent.
    take = lengths.groupBy("id").agg(F.max(F.floor(F.col("n") / 4)).cast("int").alias("take"))
    asks = near.join(take, "id").select(F.col("next_id").alias("from_id"), F.col("id").alias("to_id"), "take")
    # Of rows with one id the least beginning goes; both uses of the documents share one exchange.
    sent = docs.join(asks, F.col("id") == F.col("from_id")).select(
        "to_id", F.substr("text", F.lit(1), F.col("take")).alias("insert")).groupBy("to_id").agg(
        F.min("insert").alias("insert"))
    row = F.row_number().over(Window.partitionBy("id").orderBy("text"))
    both = docs.withColumn("row", row).join(sent, F.col("id") == F.col("to_id")).select("id", "row", "text", "insert")
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    both = both.withColumns({"n_chars": n.cast("long"), "head": F.substr("text", F.lit(1), n - cut),
                             "insert": F.substr("insert", F.lit(1), cut)})
    both = both.withColumn("edited", F.concat("head", "insert"))
    # Whole words of the head are in both texts; its last word goes with what follows.
    kept = F.regexp_extract("head", r"(?s)^(.*[\x20\x09-\x0D])", 1)
    both = both.withColumn("kept", kept)
    rest = F.char_length("kept") + 1
    parts = F.array(F.struct(F.col("kept").alias("t"), F.lit(1).alias("own"), F.lit(1).alias("edit")),
                    F.struct(F.substr("text", rest).alias("t"), F.lit(1).alias("own"), F.lit(0).alias("edit")),
                    F.struct(F.substr("edited", rest).alias("t"), F.lit(0).alias("own"), F.lit(1).alias("edit")))
    terms = both.select("id", "row", F.explode(parts).alias("s")).select(
        "id", "row", "s.own", "s.edit", F.explode(words(F.col("s.t"))).alias("w")).where("w != ''")
    terms = terms.select("id", "row", "own", "edit", F.xxhash64("w").alias("term")).groupBy("id", "row", "term").agg(
        F.sum("own").alias("own"), F.sum("edit").alias("edit"))
    prints = fingerprints(terms, ["id", "row"], ["own", "edit"], samples)
    none = F.array_repeat(F.lit(float("inf")), samples)
    shas = both.select("id", "row", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    full = shas.join(prints, ["id", "row"], "left").select(
        "id", "row", "n_chars", "edited_sha256", F.coalesce("f_own", none).alias("f_own"),
        F.coalesce("f_edit", none).alias("f_edit"))
    full = stored(full, "fingerprints")
    followed = full.where("row = 1").select(F.col("id").alias("from_id"), F.col("f_own").alias("f_next")).join(
        near.select("next_id", F.col("id").alias("to_id")), F.col("from_id") == F.col("next_id")).select(
        "to_id", "f_next")
    return full.join(followed, F.col("id") == F.col("to_id")).select(
        F.nullif("id", null_id).alias("doc_id"), "n_chars", "edited_sha256", printed("f_own").alias("fingerprint"),
        printed("f_edit").alias("edited_fingerprint"), likeness("f_own", "f_edit").alias("near_edited"),
        likeness("f_own", "f_next").alias("near_next"))
