"""Label vocabularies and choice lists (AGG3, AGG4, AGG9, JOI4, JOI5, SET2, SET3, PRJ9-PRJ11).

Absent choices ("n labels the row does not have") have one definition at every vocabulary size.  The sorted vocabulary
has dense positions; each row draws ``n + |own|`` distinct positions (Floyd's algorithm in an ``aggregate``), orders
them by a keyed hash, drops its own labels and keeps the first ``n``.  ``index_labels`` reads a vocabulary once;
``with_absent`` draws any number of lists from it, looking positions up in a literal array where the vocabulary is small
and in pages of labels otherwise.  Both give the same rows, and rows x vocabulary is never formed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw_text, u_of
from ..scratch import stored
from .ordering import bucket_offsets


def vocabulary(df: DataFrame, values: Column, name: str = "label") -> DataFrame:
    """AGG3: distinct labels of an array column (exploded); ``with_global_index`` gives their code-point order."""
    return (df.select(F.explode(values).alias(name)).filter(F.col(name).isNotNull())
            .distinct())


def vocabulary_first_seen(df: DataFrame, col: str, order: str, name: str = "label") -> DataFrame:
    """AGG4: distinct labels with their first appearance (``first_seen`` = min order key)."""
    return df.groupBy(F.col(col).alias(name)).agg(F.min(order).alias("first_seen"))


def draw_positions(n: Column, own: Column, m: Column, seed, task: str, key: Sequence[str], draw: str) -> Column:
    """``n + |own|`` distinct positions below ``m`` (all, if fewer), in draw order: one for each label that may turn
    out to be the row's own, and n more."""
    want = F.least(n + F.size(own), m).cast("long")
    seq = F.when(want > 0, F.sequence(m - want, m - 1)).otherwise(F.array().cast("array<long>"))

    def drawn(text):
        # What a row's draws have in common is written once; the lambdas add what tells them apart.
        def floyd(acc, j):
            t = F.floor(u_of(F.md5(F.concat(text, F.lit(draw + ":floyd:"), j.cast("string")))) * (j + 1))
            return F.concat(acc, F.array(F.when(F.array_contains(acc, t), j).otherwise(t)))

        picked = F.aggregate(seq, F.array().cast("array<long>"), floyd)
        return F.transform(F.array_sort(F.transform(picked, lambda x: F.struct(
            F.md5(F.concat(text, F.lit(draw + ":ord:"), x.cast("string"))).alias("h"),
            x.alias("i")))), lambda s: s["i"])

    return F.element_at(F.transform(F.array(draw_text(seed, task, key, "")), drawn), 1)


def literal_array(labels: Sequence[str]) -> Column:
    """A constant array: one string that is split when the plan is made, where no label holds the separator."""
    sep = next((s for s in "\x1f\x1e\x1d" if not any(s in v for v in labels)), None)
    if not labels or sep is None:
        return F.array(*[F.lit(v) for v in labels]).cast("array<string>")
    return F.split(F.lit(sep.join(labels)), sep)


def absent_from_list(own: Column, vocab: Sequence[str], n: Column | int, seed, task: str,
                     key: Sequence[str], draw: str = "absent") -> Column:
    """JOI4, labels known with the task: up to ``n`` labels of ``vocab`` not in ``own``, in draw order."""
    n_c = n if isinstance(n, Column) else F.lit(n)
    labels = sorted(set(vocab))
    lit_vocab = literal_array(labels)
    mine = F.coalesce(own, F.array().cast("array<string>"))
    positions = draw_positions(n_c, mine, F.lit(len(labels)).cast("long"), seed, task, key, draw)
    drawn = F.transform(positions, lambda i: F.element_at(lit_vocab, (i + 1).cast("int")))
    return F.slice(F.filter(drawn, lambda v: ~F.array_contains(mine, v)), 1, n_c)


@dataclass
class IndexedLabels:
    """A sorted label vocabulary with dense positions: its size, and either the labels themselves (``SMALL`` at most) or
    a table of pages, (_page, _labels), of ``page`` consecutive labels each."""

    size: int
    labels: list[str] | None
    pages: DataFrame | None = None
    page: int = 0


#: A vocabulary of at most so many labels is part of the plan.
SMALL = 1024
PAGE = 4096


def index_labels(vocab: DataFrame, vocab_col: str = "label", small: int = SMALL, page: int = PAGE) -> IndexedLabels:
    """Read a vocabulary once.  At most ``small + 1`` labels reach the driver; if there are more, they are sorted by
    sampled ranges, so that no prefix or letter makes one task, and stored as pages."""
    labels = vocab.select(F.col(vocab_col).alias("_vl")).filter(F.col("_vl").isNotNull()).distinct()
    # One job: a collected limit would try the partitions in several rounds.
    head = labels.limit(small + 1).agg(F.collect_list("_vl")).first()[0]
    if len(head) <= small:
        return IndexedLabels(len(head), sorted(head, key=lambda x: x.encode("utf-8", "surrogatepass")))
    # A row's number within its range, then the ranges' offsets; ranges are few (one per partition).
    ranged = stored(labels.repartitionByRange("_vl").sortWithinPartitions("_vl").select(
        F.monotonically_increasing_id().alias("_row"), "_vl"), "label-ranges").withColumn("_range", F.shiftright("_row", 33))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = bucket_offsets(sizes, "_range", "_n", "_first", total="_total")
    at = F.col("_first") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    placed = ranged.join(offsets, "_range").select("_vl", at.alias("_vi"), "_total")
    pages = stored(placed.groupBy(F.floor(F.col("_vi") / page).cast("long").alias("_page")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_vi", "_vl"))), lambda s: s["_vl"]).alias("_labels"),
        F.max("_total").alias("_total")), "label-pages")
    size = pages.agg(F.max("_total")).first()[0]
    return IndexedLabels(size, None, pages.select("_page", "_labels"), page)


def with_absent(df: DataFrame, key: Sequence[str], own: str, lists: Mapping[str, Column | int], vocab: IndexedLabels,
                seed, task: str) -> DataFrame:
    """JOI4: for each of ``lists`` (name -> how many) a column with up to that many labels not in ``own``, in draw order;
    the name is also the draw's.  ``key`` must be unique.

    With the labels in the plan they are looked up inside the row.  With pages, the positions that a row draws for all
    its lists are one table, joined to the pages and regrouped once.
    """
    mine = F.coalesce(F.col(own), F.array().cast("array<string>"))
    counts = {name: n if isinstance(n, Column) else F.lit(n) for name, n in lists.items()}
    if vocab.labels is not None:
        # Plain columns: a list that a row's branch does not take is not drawn, and none is where only rows are counted.
        return df.withColumns({name: absent_from_list(mine, vocab.labels, n, seed, task, key, name)
                               for name, n in counts.items()})
    size = F.lit(vocab.size).cast("long")
    drawn = {name: draw_positions(n, mine, size, seed, task, key, name) for name, n in counts.items()}

    def named(k, positions):
        return F.transform(positions, lambda x, i: F.struct(F.lit(k).alias("list"), i.alias("nth"), x.alias("at")))

    every = F.concat(*[named(k, positions) for k, positions in enumerate(drawn.values())])
    asked = df.select(*key, F.explode(every).alias("_q")).select(
        *key, "_q.list", "_q.nth", F.floor(F.col("_q.at") / vocab.page).cast("long").alias("_page"),
        (F.col("_q.at") % vocab.page).cast("int").alias("_place"))
    found = asked.join(vocab.pages, "_page").select(*key, F.struct(
        "list", "nth", F.get("_labels", F.col("_place")).alias("label")).alias("_hit"))
    hits = found.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)]).agg(
        F.array_sort(F.collect_list("_hit")).alias("_hits"))
    same = F.lit(True)
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = df.join(hits, same, "left")
    none = F.array().cast("array<struct<list:int,nth:int,label:string>>")

    def picked(k):
        labels = F.transform(F.filter(F.coalesce("_hits", none), lambda h: h["list"] == k), lambda h: h["label"])
        return F.filter(labels, lambda v: ~F.array_contains(mine, v))

    return out.withColumns({name: F.slice(picked(k), 1, n) for k, (name, n) in enumerate(counts.items())}).drop(
        "_hits", *[f"_k{i}" for i in range(len(key))])


def absent_by_join(df: DataFrame, key: Sequence[str], own: str, n: Column | int, vocab: DataFrame,
                   seed, task: str, name: str = "absent", vocab_col: str = "label", draw: str = "absent",
                   **kw) -> DataFrame:
    """JOI4 for any vocabulary and one list."""
    return with_absent(df, key, own, {draw: n}, index_labels(vocab, vocab_col, **kw), seed, task).withColumnRenamed(draw, name)


def keep_in_choices(values: Column, choices: Column) -> Column:
    """JOI5: keep predicted values that are among the choices (order kept, duplicates dropped)."""
    return F.array_distinct(F.filter(values, lambda x: F.array_contains(choices, x)))


def sorted_difference(a: Column, b: Column) -> Column:
    """SET2: sorted set difference a - b."""
    return F.array_sort(F.array_except(a, b))


def distinct_in_order(a: Column) -> Column:
    """SET3: distinct keeping the first occurrence."""
    return F.array_distinct(a)


def map_label(col: Column, mapping: Mapping[str, str], strict: bool = False) -> Column:
    """PRJ9: code -> display label through a literal map.  A code without a label gives null, or with ``strict`` fails
    the job (``unmapped_codes`` lists them beforehand)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    label = F.try_element_at(m, col)
    if not strict:
        return label
    missing = F.raise_error(F.concat(F.lit("no label for code "), F.coalesce(col, F.lit("null")))).cast("string")
    return F.when(label.isNull(), missing).otherwise(label)


def unmapped_codes(df: DataFrame, col: str, mapping: Mapping[str, str]) -> DataFrame:
    """(code, n_rows): codes without a display label (the error report of PRJ9)."""
    return df.filter(~F.col(col).isin(*mapping.keys()) | F.col(col).isNull()).groupBy(F.col(col).alias("code")).agg(
        F.count(F.lit(1)).alias("n_rows"))


def ordinal_label(choices: Column, label: Column) -> Column:
    """PRJ10: digit label -> choice text (0-based digit)."""
    return F.try_element_at(choices, label.cast("int") + 1)


def size_distribution(df: DataFrame, arr: str, name: str = "n") -> DataFrame:
    """AGG9: (size, count, probability, cumulative probability) of an array column's sizes."""
    w = Window.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    counts = df.groupBy(F.size(arr).alias(name)).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return (counts.withColumn("probability", F.col("count") / total)
            .withColumn("cumulative", F.sum("count").over(w) / total))
