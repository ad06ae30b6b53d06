"""Instruction builders (BLD1-BLD9) composed from the operators.

Each builder takes source DataFrames and returns instruction rows
``(input, target, answer_choices, task_type, task_dataset, sample_id)``.
Random choices are keyed draws on the sample key, so a builder's output is
a pure function of its inputs and seed.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dialogue import (history_rows, merge_turns, pair_turns, require_first_role,
                                  validate_domain)
from ..scratch import stored
from .common import finish, sampled
from .tasks import DIALOGUE, SEED


SYSTEM_MARK = "[system] "
TURN_BUCKET = 1024  # turns per scan bucket inside one conversation


def dialogue_pairs(conversations: DataFrame) -> DataFrame:
    """Turns -> (conv_id, i, prompt, reply): user-first only, runs merged; a system turn's text is marked and goes to
    the prompt as the user's.

    Run detection is a bucketed scan, so a very long conversation is split over tasks.
    """
    system = F.col("role") == "system"
    t = conversations.select("conv_id", "turn", F.when(system, F.lit("user")).otherwise(F.col("role")).alias("role"),
                             F.when(system, F.concat(F.lit(SYSTEM_MARK), "text")).otherwise(F.col("text")).alias("text"))
    t = validate_domain(t, "role", ["user", "assistant"], "role")
    t = require_first_role(t, "user", split_keys=True)
    bucket = F.floor(F.col("turn") / TURN_BUCKET)
    return pair_turns(merge_turns(t, bucket=bucket), "user", "assistant")


def build_dialogue(conversations: DataFrame, seed=SEED, spec=DIALOGUE, k: int | None = None, fraction: float | None = None, **kw) -> DataFrame:
    """BLD8: every prefix of every dialogue; last user block in the input, the reply as target."""
    hist = history_rows(dialogue_pairs(conversations), spec.words["user"], spec.words["assistant"])
    hist = sampled(hist, spec, ["conv_id", "i"], seed, k, fraction)
    return finish(hist, spec, ["conv_id", "i"], {"text": F.col("history")}, F.col("reply"), None, seed, **kw)


# ---------------------------------------------------------------- shared draws

from collections.abc import Sequence  # noqa: E402

from pyspark.sql import Column, Window  # noqa: E402

from ..functions.draws import draw_int, u  # noqa: E402
from ..operators.choices import (absent_from_list, index_labels, map_label, ordinal_label,  # noqa: E402
                                 size_distribution, vocabulary, with_absent)
from ..operators.sampling import draw_size, insert_before_last, random_insert  # noqa: E402
from ..operators.tags import decode_tags  # noqa: E402
from ..operators.tokens import wrap_prompt  # noqa: E402
from ..operators.ordering import with_global_index  # noqa: E402
from .tasks import (CLASSIFICATION, CLASSIFICATION_SIZED, ENTITIES, EVENTS,  # noqa: E402
                    NORMALIZATION, ORDINAL, PAIR_MATCH, RELATIONS, RELEVANCE, TAGGED)

SEP = "，"   # list separator inside prompts and answers (fixed value)
COLON = "："


def _ordered_values(arr: str, field: str) -> Column:
    """Values of ``field`` from an array of structs sorted by its first field (position)."""
    return F.transform(F.array_sort(F.col(arr)), lambda s: s[field])


# ---------------------------------------------------------------- BLD1 relations

def relation_samples(orders: DataFrame) -> DataFrame:
    """Stand-in: orders by (customer, year); triple = (priority, order, status) in date order."""
    o = orders.select("o_custkey", F.year("o_orderdate").alias("o_year"), "o_orderdate", "o_orderkey",
                      "o_orderpriority", "o_orderstatus")
    # What follows from other fields is added after the grouping, so it is not shuffled.
    g = o.groupBy("o_custkey", "o_year").agg(F.array_sort(F.collect_list(F.struct(
        F.col("o_orderdate").alias("pos"), F.col("o_orderkey").alias("pos2"),
        F.col("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("object")))).alias("triples"))
    g = g.withColumn("triples", F.transform("triples", lambda t: F.struct(
        t["pos"].alias("pos"), t["pos2"].alias("pos2"), t["predicate"].alias("predicate"),
        F.concat(F.lit("order "), t["pos2"].cast("string")).alias("subject"), t["object"].alias("object"))))
    text = F.concat(F.lit("customer "), F.col("o_custkey").cast("string"), F.lit(" in "),
                    F.col("o_year").cast("string"), F.lit(": "),
                    F.array_join(F.transform("triples", lambda t: F.concat(
                        t["subject"], F.lit(" is "), t["object"], F.lit(" with "), t["predicate"])), "; "))
    return g.withColumn("text", text)


def build_relations(samples: DataFrame, key: Sequence[str] = ("o_custkey", "o_year"), seed=SEED,
                    spec=RELATIONS, vocab: DataFrame | None = None, k: int | None = None, fraction: float | None = None, **kw) -> DataFrame:
    """BLD1: relation triples -> instruction rows with absent-predicate negatives.

    ``vocab`` (column ``label``) defaults to the predicates found in ``samples`` (AGG3).
    """
    key = list(key)
    p, w = spec.probs, spec.words
    if vocab is None:
        vocab = vocabulary(samples, F.transform("triples", lambda t: t["predicate"]))
    d = sampled(samples, spec, key, seed, k, fraction).withColumn(
        "own", F.array_distinct(_ordered_values("triples", "predicate")))
    d = with_absent(d, key, "own", {"absent1": 1, "absent_n": draw_int(1, 3, u(seed, spec.name, key, "n_absent"))},
                    index_labels(vocab), seed, spec.name)
    exists = u(seed, spec.name, key, "exist") < p["exist"]
    add = u(seed, spec.name, key, "add_absent") < p["add_absent"]
    choices = (F.when(exists & add, F.concat("own", "absent1")).when(exists, F.col("own"))
               .otherwise(F.col("absent_n")))
    d = d.withColumn("choices", choices)

    def line(pred):
        pairs = F.transform(F.filter("triples", lambda t: t["predicate"] == pred), lambda t: F.concat(
            F.lit(w["head"]), t["subject"], F.lit(SEP + w["tail"]), t["object"], F.lit("。")))
        return F.concat(F.lit(w["line_a"]), pred, F.lit(w["line_b"] + COLON), F.array_join(pairs, ""))

    target = F.when(exists, F.array_join(F.transform("choices", line), "\n")).otherwise(F.lit(w["none"]))
    return finish(d, spec, key, {"text": F.col("text"), "choices": F.array_join("choices", SEP)},
                  target, F.col("choices"), seed, **kw)


# ---------------------------------------------------------------- BLD2 entities

EVENT_LABELS = {  # fixed values: event code -> display label
    "click": "Click",
    "purchase": "Purchase",
    "error": "Error report",
    "signup": "Sign-up",
    "view": "Page view",
}


def entity_samples(events: DataFrame) -> DataFrame:
    """Stand-in: events by (user, day); entity type = mapped event type, entity = props.k."""
    e = events.select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "event_type",
                      F.get_json_object("props", "$.k").alias("k"))
    g = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct(
        F.col("ts").alias("pos"), F.col("event_id").alias("pos2"),
        map_label(F.col("event_type"), EVENT_LABELS, strict=True).alias("type"),
        F.col("k").alias("entity"), F.col("event_type").alias("code")))).alias("ents"))
    text = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" on "),
                    F.col("day").cast("string"), F.lit(": "),
                    F.array_join(F.transform("ents", lambda x: F.concat(x["code"], F.lit(" "), x["entity"])), " "))
    return g.withColumn("text", text)


def _entity_lines(choices: Column, ents: str, head: str, line: str) -> Column:
    def one(t):
        vals = F.array_sort(F.array_distinct(F.transform(F.filter(ents, lambda x: x["type"] == t),
                                                         lambda x: x["entity"])))
        return F.concat(t, F.lit(line + COLON), F.array_join(vals, SEP))
    return F.concat(F.lit(head), F.array_join(F.transform(choices, one), "\n"))


def build_entities(samples: DataFrame, key: Sequence[str] = ("user_id", "day"), seed=SEED,
                   spec=ENTITIES, vocab: DataFrame | None = None, k: int | None = None, fraction: float | None = None, **kw) -> DataFrame:
    """BLD2: typed entities -> rows; one absent type inserted before the last, or a 'none' row."""
    key = list(key)
    p, w = spec.probs, spec.words
    if vocab is None:
        vocab = vocabulary(samples, F.transform("ents", lambda x: x["type"]))
    d = sampled(samples, spec, key, seed, k, fraction).withColumn(
        "own", F.array_distinct(F.transform("ents", lambda x: x["type"])))
    d = with_absent(d, key, "own", {"absent1": 1}, index_labels(vocab), seed, spec.name)
    exists = u(seed, spec.name, key, "exist") < p["exist"]
    add = (u(seed, spec.name, key, "add_absent") < p["add_absent"]) & (F.size("absent1") > 0)
    with_one = insert_before_last(F.col("own"), F.try_element_at("absent1", F.lit(1)), u(seed, spec.name, key, "insert"))
    choices = F.when(exists & add, with_one).when(exists, F.col("own")).otherwise(F.col("absent1"))
    d = d.withColumn("choices", choices)
    target = F.when(exists, _entity_lines(F.col("choices"), "ents", w["head"], w["line"])).otherwise(
        F.lit(w["none"]))
    return finish(d, spec, key, {"text": F.col("text"), "choices": F.array_join("choices", SEP)},
                  target, F.col("choices"), seed, **kw)


# ---------------------------------------------------------------- BLD2b tagged entities

TAG_TYPES = ("Click", "Purchase", "Error report")  # fixed type order of the tagged task
TAG_LABELS = {  # fixed values: tag -> entity type; O = outside
    "B-click": "Click", "I-click": "Click",
    "B-purchase": "Purchase", "I-purchase": "Purchase",
    "B-error": "Error report", "I-error": "Error report",
}


def relation_vocab(orders: DataFrame) -> DataFrame:
    """Predicate vocabulary straight from the source column (no sample aggregation needed)."""
    return orders.select(F.col("o_orderpriority").alias("label")).filter(F.col("label").isNotNull())


def entity_vocab(events: DataFrame) -> DataFrame:
    return events.select(map_label(F.col("event_type"), EVENT_LABELS).alias("label")).filter(
        F.col("label").isNotNull())


def part_name_vocab(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_name").alias("label")).filter(F.col("label").isNotNull())


def tag_sequences(events: DataFrame) -> DataFrame:
    """Stand-in: one character per event (letter from props.k), tag from the event type."""
    k = F.get_json_object("props", "$.k").cast("int")
    tag = F.when(F.col("event_type").isin("signup", "view"), F.lit("O")).otherwise(
        F.concat(F.lit("B-"), F.col("event_type")))
    return events.select("user_id", F.to_date("ts").alias("day"), "ts", "event_id",
                         F.char(F.lit(97) + F.pmod(k, F.lit(26))).alias("ch"), tag.alias("tag"))


def build_tagged_entities(tags: DataFrame, key: Sequence[str] = ("user_id", "day"),
                          order: Sequence[str] = ("ts", "event_id"), seed=SEED, spec=TAGGED,
                          k: int | None = None, fraction: float | None = None, **kw) -> DataFrame:
    """BLD2b: tag sequences -> decoded entities -> rows; all-types-present rows never get 'none'."""
    key = list(key)
    p, w = spec.probs, spec.words
    ents = decode_tags(tags, key, list(order), TAG_LABELS, bucket=F.date_trunc("hour", order[0]))
    n_types = len(TAG_TYPES)
    types = F.array(*[F.lit(t) for t in TAG_TYPES])
    d = ents.withColumn("own", F.filter(types, lambda t: F.exists("ents", lambda x: x["type"] == t)))
    d = d.filter(F.size("own") > 0)  # FLT4
    if k is not None or fraction is not None:
        d = stored(d, "tagged-samples")  # the sample's keys and its rows both need the decoded sentences
    d = sampled(d, spec, key, seed, k, fraction)
    n_abs = draw_int(1, F.lit(n_types) - F.size("own"), u(seed, spec.name, key, "n_absent"))
    d = d.withColumn("absent", absent_from_list(F.col("own"), list(TAG_TYPES), n_abs, seed, spec.name,
                                                key, "absent"))
    full = F.size("own") == n_types
    exists = (u(seed, spec.name, key, "exist") < p["exist"]) | full
    add = (u(seed, spec.name, key, "add_absent") < p["add_absent"]) & ~full
    choices = (F.when(exists & add, F.concat("own", "absent")).when(exists, F.col("own"))
               .otherwise(F.col("absent")))
    d = d.withColumn("choices", choices)

    def one(t):
        vals = F.transform(F.array_sort(F.filter("ents", lambda x: x["type"] == t)), lambda x: x["entity"])
        return F.concat(t, F.lit(w["line"] + COLON), F.array_join(vals, SEP))

    target = F.when(exists, F.concat(F.lit(w["head"]), F.array_join(F.transform("choices", one), "\n"))
                    ).otherwise(F.lit(w["none"]))
    return finish(d, spec, key, {"text": F.col("sentence"), "choices": F.array_join("choices", SEP)},
                  target, F.col("choices"), seed, **kw)


# ---------------------------------------------------------------- BLD3 events

def event_samples(orders: DataFrame, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Stand-in: per customer, one event per order: core = order, status, part types and names."""
    li = lineitem.select("l_orderkey", "l_partkey").join(
        part.select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_name"), "l_partkey")
    per_order = li.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("p_type")).alias("descr"),
        F.array_sort(F.collect_set("p_name")).alias("parts"))
    o = orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus").join(
        per_order.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
    g = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(
        F.col("o_orderdate").alias("pos"), F.col("o_orderkey").alias("pos2"),
        F.col("o_orderstatus").alias("status"),
        F.coalesce("descr", F.array().cast("array<string>")).alias("descr"),
        F.coalesce("parts", F.array().cast("array<string>")).alias("parts")))).alias("events"))
    g = g.withColumn("events", F.transform("events", lambda e: F.struct(
        e["pos"].alias("pos"), e["pos2"].alias("pos2"), F.concat(F.lit("order "), e["pos2"].cast("string")).alias("core"),
        e["status"].alias("status"), e["descr"].alias("descr"), e["parts"].alias("parts"))))
    text = F.concat(F.lit("customer "), F.col("o_custkey").cast("string"), F.lit(" placed "),
                    F.array_join(F.transform("events", lambda e: e["core"]), ", "))
    return g.withColumn("text", text)


def build_events(samples: DataFrame, key: Sequence[str] = ("o_custkey",), seed=SEED, spec=EVENTS,
                 k: int | None = None, fraction: float | None = None, **kw) -> DataFrame:
    """BLD3: events -> one multi-line target per sample; no negatives, choices null."""
    key = list(key)
    w = spec.words

    def line(e):
        values = (e["core"], e["status"], F.array_join(e["descr"], SEP), F.array_join(e["parts"], SEP))
        return F.concat_ws("；", *[F.concat(F.lit(k + COLON), v) for k, v in zip(w["keys"], values)])

    target = F.concat(F.lit(w["head"]), F.array_join(F.transform("events", line), "\n"))
    return finish(sampled(samples, spec, key, seed, k, fraction), spec, key, {"text": F.col("text")}, target, None, seed, **kw)


# ---------------------------------------------------------------- BLD4 normalization

def normalization_samples(part: DataFrame) -> DataFrame:
    """Stand-in: part by (brand, size): the distinct part names in part-key order."""
    g = part.groupBy("p_brand", "p_size").agg(
        F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("_names"))
    return g.select("p_brand", "p_size",
                    F.array_distinct(F.transform("_names", lambda s: s["p_name"])).alias("names"),
                    F.concat(F.lit("parts of "), F.col("p_brand"), F.lit(" in size "),
                             F.col("p_size").cast("string")).alias("text"))


def build_normalization(samples: DataFrame, key: Sequence[str] = ("p_brand", "p_size"), seed=SEED,
                        spec=NORMALIZATION, vocab: DataFrame | None = None, k: int | None = None, fraction: float | None = None, **kw) -> DataFrame:
    """BLD4: terms; 1-3 absent terms inserted at random positions, or 2-10 absent and 'none'."""
    key = list(key)
    p, w = spec.probs, spec.words
    if vocab is None:
        vocab = vocabulary(samples, F.col("names"))
    d = sampled(samples, spec, key, seed, k, fraction)
    d = with_absent(d, key, "names", {"extra": draw_int(1, 3, u(seed, spec.name, key, "n_insert")),
                                      "absent": draw_int(2, 10, u(seed, spec.name, key, "n_absent"))},
                    index_labels(vocab), seed, spec.name)
    exists = u(seed, spec.name, key, "exist") < p["exist"]
    mixed = random_insert(F.col("names"), F.col("extra"), seed, spec.name, key)
    d = d.withColumn("choices", F.when(exists, mixed).otherwise(F.col("absent")))
    target = F.when(exists, F.array_join("names", SEP)).otherwise(F.lit(w["none"]))
    return finish(d, spec, key, {"text": F.col("text"), "choices": F.array_join("choices", SEP)},
                  target, F.col("choices"), seed, **kw)


# ---------------------------------------------------------------- BLD5 classification

def build_classification(docs: DataFrame, label_col: str = "source", key: Sequence[str] = ("doc_id",),
                         seed=SEED, spec=CLASSIFICATION, k: int | None = None, fraction: float | None = None, **kw) -> DataFrame:
    """BLD5: one label per text; 'other' class dropped; 10% 'none of these' rows."""
    key = list(key)
    p, w = spec.probs, spec.words
    d = docs.filter(F.col(label_col) != w["drop"])
    vocab = d.select(F.col(label_col).alias("label"))
    d = sampled(d, spec, key, seed, k, fraction).withColumn("own", F.array(F.col(label_col)))
    d = with_absent(d, key, "own", {"absent_none": draw_int(3, 9, u(seed, spec.name, key, "n_none")),
                                    "absent": draw_int(2, 9, u(seed, spec.name, key, "n_absent"))},
                    index_labels(vocab), seed, spec.name)
    not_exist = u(seed, spec.name, key, "not_exist") < p["not_exist"]
    choices = F.when(not_exist, F.col("absent_none")).otherwise(F.concat("absent", "own"))
    d = d.withColumn("choices", choices)
    target = F.when(not_exist, F.lit(w["none"])).otherwise(F.col(label_col))
    return finish(d, spec, key, {"text": F.col("text"), "choices": F.array_join("choices", SEP)},
                  target, F.col("choices"), seed, **kw)


NO_REGION = "ELSEWHERE"  # label of documents whose source has no nation's number


def region_labels(docs: DataFrame, nation: DataFrame) -> DataFrame:
    """Stand-in label for the sized task: the nation numbered like the document's source; every document has one."""
    src_no = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    n = nation.select(F.col("n_nationkey").alias("_nk"), F.col("n_name").alias("region"))
    return docs.withColumn("_nk", src_no).join(n, "_nk", "left").drop("_nk").withColumn(
        "region", F.coalesce("region", F.lit(NO_REGION)))


def build_classification_sized(docs: DataFrame, nation: DataFrame, sizes_from: DataFrame,
                               key: Sequence[str] = ("doc_id",), seed=SEED, spec=CLASSIFICATION_SIZED,
                               k: int | None = None, fraction: float | None = None, **kw) -> DataFrame:
    """BLD5b: choice-list size drawn from the empirical size distribution of ``sizes_from``."""
    key = list(key)
    p, w = spec.probs, spec.words
    dist = size_distribution(sizes_from.filter(F.col("answer_choices").isNotNull()), "answer_choices")
    d = sampled(region_labels(docs, nation), spec, key, seed, k, fraction)
    d = draw_size(d.withColumn("own", F.array("region")), dist, u(
        seed, spec.name, key, "size"), "_m").withColumn("_m", F.greatest(F.col("_m") - 1, F.lit(0)))
    vocab = nation.select(F.col("n_name").alias("label"))
    d = with_absent(d, key, "own", {"absent": F.col("_m"), "absent_none": F.col("_m") + 1}, index_labels(vocab), seed,
                    spec.name)
    exists = u(seed, spec.name, key, "exist") < p["exist"]
    mixed = random_insert(F.col("absent"), F.col("own"), seed, spec.name, key)
    d = d.withColumn("choices", F.when(exists, mixed).otherwise(F.col("absent_none")))
    target = F.when(exists, F.col("region")).otherwise(F.lit(w["none"]))
    return finish(d, spec, key, {"text": F.col("text"), "choices": F.array_join("choices", SEP)},
                  target, F.col("choices"), seed, **kw)


# ---------------------------------------------------------------- BLD6 pair match

def adjacent_pairs(docs: DataFrame) -> DataFrame:
    """Stand-in: document i with document i+1; label '1' when both share a language."""
    # A text is shuffled once, not once for each side of a join: groups of 64 neighbouring ids, in which the first
    # document of the next group is there too, and each row sees those of the next id.
    group = F.shiftright("doc_id", 6)
    first = F.col("doc_id").bitwiseAND(F.lit(63)) == 0
    d = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", "lang", F.explode(
        F.when(first, F.array(group, group - 1)).otherwise(F.array(group))).alias("_g"))
    following = Window.partitionBy("_g").orderBy("doc_id").rangeBetween(1, 1)
    d = d.select("doc_id", F.col("text").alias("text1"), F.col("lang").alias("lang1"), "_g",
                 F.count(F.lit(1)).over(following).cast("int").alias("_n"),
                 F.collect_list(F.struct("text")).over(following).alias("_texts"),
                 F.collect_list(F.struct("lang")).over(following).alias("_langs"))
    d = d.filter((F.col("_g") == group) & (F.col("_n") > 0)).select(
        "doc_id", "text1", "lang1", "_texts", "_langs", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i"))
    lang2 = F.element_at("_langs", F.col("_i"))["lang"]
    return d.select("doc_id", "text1", F.element_at("_texts", F.col("_i"))["text"].alias("text2"),
                    F.when(F.col("lang1") == lang2, "1").otherwise("0").alias("label"))


def build_pair_match(pairs: DataFrame, key: Sequence[str] = ("doc_id",), seed=SEED, spec=PAIR_MATCH,
                     k: int | None = None, fraction: float | None = None, **kw) -> DataFrame:
    """BLD6: the answer wording (same/different or yes/no) is the chosen template's (PRJ11)."""
    from ..operators.templates import pick_template
    key = list(key)
    wording = spec.words["wording"]
    if len(wording) != len(spec.templates):
        raise ValueError("a wording for each template")
    idx = pick_template(len(spec.templates), seed, spec.name, key)
    yes_w = F.element_at(F.array(*[F.lit(x[0]) for x in wording]), idx + 1)
    no_w = F.element_at(F.array(*[F.lit(x[1]) for x in wording]), idx + 1)
    target = F.when(F.col("label") == "1", yes_w).otherwise(no_w)
    return finish(sampled(pairs, spec, key, seed, k, fraction), spec, key, {"a": F.col("text1"), "b": F.col("text2")}, target,
                  F.array(yes_w, no_w), seed, **kw)


def build_ordinal_match(orders: DataFrame, key: Sequence[str] = ("o_orderkey",), seed=SEED, spec=ORDINAL,
                        k: int | None = None, fraction: float | None = None, **kw) -> DataFrame:
    """BLD6b: four-or-more ordered choices; the label digit picks the target."""
    key = list(key)
    choices = F.array(*[F.lit(c) for c in spec.words["choices"]])
    label = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    d = orders.select("o_orderkey", "o_custkey", "o_orderdate", label.alias("label"))
    d = sampled(d, spec, key, seed, k, fraction)
    a = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))
    b = F.concat(F.lit("customer "), F.col("o_custkey").cast("string"), F.lit(" on "),
                 F.date_format("o_orderdate", "yyyy-MM-dd"))
    return finish(d, spec, key, {"a": a, "b": b, "choices": F.array_join(choices, SEP)},
                  ordinal_label(choices, F.col("label")), choices, seed, **kw)


# ---------------------------------------------------------------- BLD7 relevance

def reply_links(conversations: DataFrame):
    """Stand-in: queries = user turns, documents = assistant turns, link = the next turn."""
    c = conversations.select("conv_id", "turn", "role", "text")
    queries = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    docs = c.filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("d_conv"), F.col("turn").alias("d_turn"), F.col("text").alias("doc"))
    links = queries.select("conv_id", "turn", F.col("turn").alias("line_no")).withColumn(
        "d_conv", F.col("conv_id")).withColumn("d_turn", F.col("turn") + 1)
    return queries, docs, links


def index_turns(turns: DataFrame) -> DataFrame:
    """(d_conv, d_turn, d_idx, n_docs): positions of turns; a bucket is ``TURN_BUCKET`` turns of one conversation, so a
    huge conversation is many tasks."""
    bucket = F.col("d_conv") * F.lit(1 << 20) + F.least(F.floor(F.col("d_turn") / TURN_BUCKET), F.lit((1 << 20) - 1))
    return with_global_index(turns, ["d_conv", "d_turn"], "d_idx", bucket=bucket, total="n_docs", levels=3)


def build_relevance(queries: DataFrame, docs: DataFrame, links: DataFrame, seed=SEED, spec=RELEVANCE,
                    k: int | None = None, fraction: float | None = None, **kw) -> DataFrame:
    """BLD7: positive document via the link table, else a random other document (never the positive)."""
    key = ["conv_id", "turn"]
    dkey = ["d_conv", "d_turn"]
    p, w = spec.probs, spec.words
    # JOI1: the last link per query wins.
    last = links.groupBy(*key).agg(F.max_by(F.struct(*dkey), "line_no").alias("_d")).select(
        *key, "_d.d_conv", "_d.d_turn")
    # The index is over keys; texts are fetched by key at the end.
    idx_docs = index_turns(docs.select(*dkey))
    pos = last.join(idx_docs, dkey).select(*key, F.col("d_idx").alias("pos_idx"), "n_docs")
    q = sampled(queries.join(pos, key), spec, key, seed, k, fraction)
    relevant = u(seed, spec.name, key, "relevant") < p["relevant"]
    i = F.floor(u(seed, spec.name, key, "negative") * (F.col("n_docs") - 1)).cast("long")
    neg = F.when(i >= F.col("pos_idx"), i + 1).otherwise(i)
    q = q.withColumn("relevant", relevant).withColumn("doc_idx", F.when(relevant, F.col("pos_idx")).otherwise(neg))
    d = q.join(idx_docs.select(F.col("d_idx").alias("doc_idx"), *dkey), "doc_idx").join(docs.select(*dkey, "doc"), dkey)
    target = F.when(F.col("relevant"), F.lit(w["yes"])).otherwise(F.lit(w["no"]))
    return finish(d, spec, key, {"a": F.col("query"), "b": F.col("doc")}, target,
                  F.array(F.lit(w["yes"]), F.lit(w["no"])), seed, **kw)


# ---------------------------------------------------------------- SNK9 / BLD9

def base_rows(conversations: DataFrame) -> DataFrame:
    """Stand-in for the base training file: plain user -> reply instruction rows."""
    p = dialogue_pairs(conversations)
    return p.select(F.col("prompt").alias("input"), F.col("reply").alias("target"),
                    F.lit(None).cast("array<string>").alias("answer_choices"),
                    F.lit("base").alias("task_type"), F.lit("base").alias("task_dataset"),
                    F.concat_ws("-", F.lit("base"), F.col("conv_id").cast("string"),
                                F.col("i").cast("string")).alias("sample_id"))


MIX_FRACTION = 0.8


def build_mixture(tables, fraction: float = MIX_FRACTION, seed=SEED) -> DataFrame:
    """BLD9 / SET1: every task builder, each sampled to ``fraction`` (SMP1), plus the base rows.

    ``tables`` maps a table name to a DataFrame.  Bag union, no dedupe.  Every builder samples its keys first and
    renders what it keeps in one plan: counting the rows reads no text.
    """
    t = tables
    docs = t["documents"]
    kw = {"seed": seed, "fraction": fraction}
    build = [
        lambda: build_relations(relation_samples(t["orders"]), vocab=relation_vocab(t["orders"]), **kw),
        lambda: build_entities(entity_samples(t["events"]), vocab=entity_vocab(t["events"]), **kw),
        lambda: build_tagged_entities(tag_sequences(t["events"]), **kw),
        lambda: build_events(event_samples(t["orders"], t["lineitem"], t["part"]), **kw),
        lambda: build_normalization(normalization_samples(t["part"]), vocab=part_name_vocab(t["part"]), **kw),
        lambda: build_classification(docs, **kw),
        lambda: build_classification_sized(docs, t["nation"], build_classification(docs, seed=seed), **kw),
        lambda: build_pair_match(adjacent_pairs(docs), **kw),
        lambda: build_ordinal_match(t["orders"], **kw),
        lambda: build_relevance(*reply_links(t["conversations"]), **kw),
        lambda: build_dialogue(t["conversations"], **kw),
    ]
    # Each builder stores its sample's keys and reads its vocabulary: jobs that do not wait for each other.
    with ThreadPoolExecutor(len(build)) as pool:
        parts = list(pool.map(lambda f: f(), [inheritable_thread_target(docs.sparkSession)(f) for f in build]))
    out = base_rows(t["conversations"])  # SNK9: base rows carried through unchanged
    for p in parts:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- prediction stand-ins for the parsers

FINDING_CHOICES = ("positive", "negative", "unclear")  # our own words
REPORT_KEYS = ("Opening：", "Body：", "Aside：", "Quote：", "Closing：")  # our own sections


def noisy(preds: DataFrame, seed=SEED) -> DataFrame:
    """Predictions as a model garbles them, by a keyed draw: empty, ASCII punctuation, stray lines around the answer,
    more than 100 separators, indented lines, no sample id; the others unchanged."""
    kind = F.floor(u(seed, "noise", ["sample_id"], "kind") * 8)
    t = F.col("target")
    garbled = (F.when(kind == 0, F.lit("")).when(kind == 1, F.translate(t, "：，；", ":,;"))
               .when(kind == 2, F.concat(F.lit("note\n"), t, F.lit("\n\n")))
               .when(kind == 3, F.concat(F.repeat(F.lit("x,"), 120), t, F.repeat(F.lit(", y"), 120)))
               .when(kind == 4, F.replace(t, F.lit("\n"), F.lit("\n  "))).otherwise(t))
    return preds.withColumns({"target": garbled, "sample_id": F.when(kind != 5, F.col("sample_id"))})


def findings_predictions(events: DataFrame) -> DataFrame:
    """Generated-style finding lines per (user, day); ASCII colons exercise punctuation folding."""
    attr = (F.when(F.col("value") < 20, "positive").when(F.col("value") < 60, "negative")
            .otherwise("mixed"))
    k = F.get_json_object("props", "$.k")
    line = F.when(F.col("event_type").isin("error", "purchase"),
                  F.concat(F.col("event_type"), F.lit(" "), F.col("props"), F.lit(":"), attr)).otherwise(
        F.concat(F.col("event_type"), F.lit(" "), k, F.lit(":"), attr))
    e = events.select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", line.alias("line"))
    g = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "line"))).alias("_l"))
    return g.select(
        F.lit("findings of the day").alias("input"),
        F.concat(F.lit("Findings:\n"), F.array_join(F.transform("_l", lambda s: s["line"]), "\n")).alias("target"),
        F.array(*[F.lit(c) for c in FINDING_CHOICES]).alias("answer_choices"),
        F.lit("findings").alias("task_type"), F.lit("findings").alias("task_dataset"),
        F.concat_ws("-", F.lit("findings"), F.col("user_id").cast("string"), F.col("day").cast("string")).alias("sample_id"))


def report_predictions(docs: DataFrame) -> DataFrame:
    """Generated-style sectioned reports: every document line in turn under one of the sections; the first section
    repeats at the end."""
    keys = F.array(*[F.lit(k) for k in REPORT_KEYS])
    lines = F.split("text", "\n", -1)
    body = F.array_join(F.transform(lines, lambda ln, i: F.concat(
        F.element_at(keys, i % len(REPORT_KEYS) + 1), ln)), "\n")
    target = F.concat(F.lit("Report "), F.col("doc_id").cast("string"), F.lit("\n"), body, F.lit("\n"),
                      F.lit(REPORT_KEYS[0]), F.element_at(lines, -1))
    return docs.select(
        F.lit("write the report").alias("input"), target.alias("target"),
        F.lit(None).cast("array<string>").alias("answer_choices"),
        F.lit("report").alias("task_type"), F.lit("report").alias("task_dataset"),
        F.concat_ws("-", F.lit("report"), F.col("doc_id").cast("string")).alias("sample_id"))


def raw_generations(conversations: DataFrame) -> DataFrame:
    """Stand-in raw model output: inference prompt (PRJ5) followed by the reply."""
    p = dialogue_pairs(conversations)
    return p.select(F.concat_ws("-", F.lit("dialogue"), F.col("conv_id").cast("string"),
                                F.col("i").cast("string")).alias("sample_id"),
                    F.concat(wrap_prompt("prompt"), F.col("reply")).alias("raw"))
