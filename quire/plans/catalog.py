"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..scratch import stored
from ..session import table
from . import builders as B
from . import oracles as O
from .common import report

Query = Callable[[SparkSession, str], DataFrame]


def q_dialogue_history(spark: SparkSession, sf: str) -> DataFrame:
    return report(B.build_dialogue(table(spark, sf, "conversations")))


def q_build_relations(spark, sf):
    o = table(spark, sf, "orders")
    return report(B.build_relations(B.relation_samples(o), vocab=B.relation_vocab(o)))


def q_build_entities(spark, sf):
    ev = table(spark, sf, "events")
    return report(B.build_entities(B.entity_samples(ev), vocab=B.entity_vocab(ev)))


def q_build_tagged_entities(spark, sf):
    return report(B.build_tagged_entities(B.tag_sequences(table(spark, sf, "events"))))


def q_decode_tags(spark, sf):
    from pyspark.sql import functions as F

    from ..operators.tags import decode_tags
    d = decode_tags(B.tag_sequences(table(spark, sf, "events")), ["user_id", "day"], ["ts", "event_id"],
                    B.TAG_LABELS, bucket=F.date_trunc("hour", "ts"))
    return d.select("user_id", F.col("day").cast("string").alias("day"), "sentence", "n_tags",
                    F.explode("ents").alias("e")).select(
        "user_id", "day", "sentence", "n_tags", F.col("e.pos").cast("long").alias("pos"),
        F.col("e.type").alias("type"), F.col("e.entity").alias("entity"))


def q_build_events(spark, sf):
    return report(B.build_events(B.event_samples(table(spark, sf, "orders"), table(spark, sf, "lineitem"),
                                                 table(spark, sf, "part"))))


def q_build_normalization(spark, sf):
    p = table(spark, sf, "part")
    return report(B.build_normalization(B.normalization_samples(p), vocab=B.part_name_vocab(p)))


def q_build_classification(spark, sf):
    return report(B.build_classification(table(spark, sf, "documents")))


def q_build_classification_sized(spark, sf):
    docs = table(spark, sf, "documents")
    return report(B.build_classification_sized(docs, table(spark, sf, "nation"), B.build_classification(docs)))


def q_build_pair_match(spark, sf):
    return report(B.build_pair_match(B.adjacent_pairs(table(spark, sf, "documents"))))


def q_build_ordinal_match(spark, sf):
    return report(B.build_ordinal_match(table(spark, sf, "orders")))


def q_build_relevance(spark, sf):
    return report(B.build_relevance(*B.reply_links(table(spark, sf, "conversations"))))


QUERIES: dict[str, Query] = {
    "dialogue_history": q_dialogue_history,
    "build_relations": q_build_relations,
    "build_entities": q_build_entities,
    "build_tagged_entities": q_build_tagged_entities,
    "decode_tags": q_decode_tags,
    "build_events": q_build_events,
    "build_normalization": q_build_normalization,
    "build_classification": q_build_classification,
    "build_classification_sized": q_build_classification_sized,
    "build_pair_match": q_build_pair_match,
    "build_ordinal_match": q_build_ordinal_match,
    "build_relevance": q_build_relevance,
}

ORACLES: dict[str, Callable[[], str]] = {
    "dialogue_history": O.dialogue_history,
    "build_relations": O.build_relations,
    "build_entities": O.build_entities,
    "build_tagged_entities": O.build_tagged_entities,
    "decode_tags": O.decode_tags,
    "build_events": O.build_events,
    "build_normalization": O.build_normalization,
    "build_classification": O.build_classification,
    "build_classification_sized": O.build_classification_sized,
    "build_pair_match": O.build_pair_match,
    "build_ordinal_match": O.build_ordinal_match,
    "build_relevance": O.build_relevance,
}


# ---------------------------------------------------------------- ordering, sampling, reports

from pyspark.sql import functions as F  # noqa: E402

from ..operators import ordering as ORD  # noqa: E402
from ..operators import reports as REP  # noqa: E402
from ..operators.choices import size_distribution, unmapped_codes, vocabulary, vocabulary_first_seen  # noqa: E402
from ..operators.dialogue import merge_turns, turn_histogram  # noqa: E402
from ..operators.sampling import sample_k  # noqa: E402
from ..functions.text import to_markdown_row  # noqa: E402
from ..sinks.manifest import content_manifest  # noqa: E402
from .tasks import ALL_TASKS, CLASSIFICATION, DIALOGUE, ENTITIES, EVENTS, ORDINAL, RELATIONS, SEED, TAGGED  # noqa: E402

ALL_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
              "pages benchmark labels conversations").split()


def tables(spark, sf):
    return {n: table(spark, sf, n) for n in ALL_TABLES}


def _docs(spark, sf):
    return table(spark, sf, "documents")


def q_sample_k(spark, sf):
    d = _docs(spark, sf).select("doc_id", "lang", "source", "n_chars")
    return sample_k(d, ["doc_id"], SEED, "documents", fraction=0.3)


def q_shuffle_rows(spark, sf):
    return ORD.shuffle_rows(_docs(spark, sf).select("doc_id"), ["doc_id"], SEED, "shuffle")


def q_head_split(spark, sf):
    return ORD.head_split(_docs(spark, sf).select("doc_id"), 5, ["doc_id"])


def q_cap_rows(spark, sf):
    return ORD.cap_rows(_docs(spark, sf).select("doc_id", "lang"), 700, ["doc_id"])


def q_assign_shard(spark, sf):
    return ORD.assign_shard(_docs(spark, sf).select("doc_id"), 8, ["doc_id"])


def q_assign_batch(spark, sf):
    return ORD.assign_batch(_docs(spark, sf).select("doc_id"), 64, ["doc_id"])


def q_merge_runs(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "props")
    runs = merge_turns(ev, "user_id", ["ts", "event_id"], "event_type", "props", bucket=F.date_trunc("hour", "ts"))
    return runs.select("user_id", F.col("run").cast("long").alias("run"), "event_type",
                       F.col("first_event_id").alias("first_event_id"), "n_turns",
                       F.col("props").alias("text"))


def q_turn_histogram(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return turn_histogram(c, ["user", "assistant", "system"], bucket=F.floor(F.col("turn") / B.TURN_BUCKET))


def q_marker_histogram(spark, sf):
    rows = B.build_dialogue(table(spark, sf, "conversations"))
    markers = [DIALOGUE.words["user"].strip("\n"), DIALOGUE.words["assistant"].strip("\n")]
    return REP.marker_histogram(rows, "input", markers)


def q_vocabulary(spark, sf):
    v = vocabulary(B.normalization_samples(table(spark, sf, "part")), F.col("names"))
    return ORD.with_global_index(v, ["label"], "position", bucket=ORD.prefix_bits("label", 7), levels=3)


def q_vocabulary_first_seen(spark, sf):
    v = vocabulary_first_seen(_docs(spark, sf), "source", "doc_id")
    return ORD.with_global_index(v, ["first_seen"], "position")


def q_size_distribution(spark, sf):
    d = size_distribution(B.build_classification(_docs(spark, sf)), "answer_choices")
    return d.select("n", "count", F.round("probability", 6).alias("probability"),
                    F.round("cumulative", 6).alias("cumulative"))


def _relation_rows(spark, sf):
    return B.build_relations(B.relation_samples(table(spark, sf, "orders")), keep_template=True)


def q_match_templates(spark, sf):
    from ..operators.templates import match_templates
    m = match_templates(_relation_rows(spark, sf), "input", RELATIONS.templates)
    return m.select("sample_id", F.col("template_id").cast("int").alias("template_id"),
                    F.array_join(F.transform("matched", lambda x: x.cast("string")), ",").alias("matched"),
                    F.size("matched").alias("n_matched"))


def q_pattern_counts(spark, sf):
    return REP.pattern_counts(_relation_rows(spark, sf), "input", RELATIONS.templates)


def q_exemplar_report(spark, sf):
    d = _docs(spark, sf).select("source", "doc_id", "text").withColumn("length", F.length("text"))
    e = REP.exemplar(d, "source", ["doc_id"], "length", 50)
    return e.select("source", "doc_id", "length",
                    to_markdown_row(F.col("source"), F.col("doc_id"), F.col("length"), F.col("text")).alias("markdown"))


def q_mixture(spark, sf):
    return report(B.build_mixture(tables(spark, sf)))


def q_task_counts(spark, sf):
    return REP.task_counts(B.build_mixture(tables(spark, sf)))


def q_content_manifest(spark, sf):
    return content_manifest(B.build_mixture(tables(spark, sf)), ["task_dataset"])


QUERIES.update({
    "sample_k": q_sample_k,
    "shuffle_rows": q_shuffle_rows,
    "head_split": q_head_split,
    "cap_rows": q_cap_rows,
    "assign_shard": q_assign_shard,
    "assign_batch": q_assign_batch,
    "merge_runs": q_merge_runs,
    "turn_histogram": q_turn_histogram,
    "marker_histogram": q_marker_histogram,
    "vocabulary": q_vocabulary,
    "vocabulary_first_seen": q_vocabulary_first_seen,
    "size_distribution": q_size_distribution,
    "match_templates": q_match_templates,
    "pattern_counts": q_pattern_counts,
    "exemplar_report": q_exemplar_report,
    "mixture": q_mixture,
    "task_counts": q_task_counts,
    "content_manifest": q_content_manifest,
})

ORACLES.update({name: getattr(O, name) for name in (
    "sample_k", "shuffle_rows", "head_split", "cap_rows", "assign_shard", "assign_batch", "merge_runs",
    "turn_histogram", "marker_histogram", "vocabulary", "vocabulary_first_seen", "size_distribution",
    "match_templates", "pattern_counts", "exemplar_report", "mixture", "task_counts", "content_manifest")})


# ---------------------------------------------------------------- parsers

from ..operators import parse as P  # noqa: E402


SYNONYMS = {"same": "yes", "different": "no"}
FALLBACK = "unclear"
#: PAR0: the parser of each task's answers, with the words they were written with.
ROUTES = {
    "entities": lambda d: P.entity_answers(d, ENTITIES.words["line"]),
    "tagged_entities": lambda d: P.entity_answers(d, TAGGED.words["line"]),
    "relations": lambda d: P.triple_answers(d, *[RELATIONS.words[k] for k in ("line_a", "line_b", "head", "tail")]),
    "normalization": lambda d: P.term_answers(d, "normalization"),
    "events": lambda d: P.event_answers(d, EVENTS.words["keys"], EVENTS.words["list_keys"]),
    "pair_match": lambda d: P.pair_label_answers(d, SYNONYMS),
    "classification": P.label_answers,
    "classification_sized": P.label_answers,
    "ordinal_match": P.label_answers,
    "relevance": P.label_answers,
    "dialogue": P.label_answers,
    "base": P.label_answers,
    "findings": lambda d: P.finding_answers(d, {"findings": FALLBACK}),
    "report": lambda d: P.report_answers(d, B.REPORT_KEYS),
}


def _routed(preds, *tasks):
    """Long table over the tasks' answers; all of one shape."""
    parsed = P.parse_answers(preds, {t: ROUTES[t] for t in tasks})
    out = None
    for d in parsed.values():
        out = P.listed(d) if out is None else out.unionByName(P.listed(d))
    return out


def _entity_predictions(spark, sf):
    ev = table(spark, sf, "events")
    # The labels of the events' codes: no sample has to be put together for them.
    labels = vocabulary(ev, F.array(B.map_label(F.col("event_type"), B.EVENT_LABELS, strict=True)))
    return B.noisy(B.build_entities(B.entity_samples(ev), vocab=labels).unionByName(B.build_tagged_entities(B.tag_sequences(ev))))


def q_parse_entities(spark, sf):
    return _routed(_entity_predictions(spark, sf), "entities", "tagged_entities")


def _relation_predictions(spark, sf):
    o = table(spark, sf, "orders")
    return B.noisy(B.build_relations(B.relation_samples(o), vocab=vocabulary(o, F.array("o_orderpriority"))))


def q_parse_triples(spark, sf):
    return _routed(_relation_predictions(spark, sf), "relations")


def _term_predictions(spark, sf):
    p = table(spark, sf, "part")
    return B.noisy(B.build_normalization(B.normalization_samples(p), vocab=vocabulary(p, F.array("p_name"))))


def q_parse_terms(spark, sf):
    return _routed(_term_predictions(spark, sf), "normalization")


def _event_predictions(spark, sf):
    s = B.event_samples(table(spark, sf, "orders"), table(spark, sf, "lineitem"), table(spark, sf, "part"))
    return B.noisy(B.build_events(s))


def q_parse_events(spark, sf):
    d = _routed(_event_predictions(spark, sf), "events")
    return d.withColumns({k.lower(): F.array_join(k.lower(), " + ") for k in EVENTS.words["list_keys"]})


LABEL_TASKS = ("pair_match", "classification", "ordinal_match", "relevance")


def _label_predictions(spark, sf):
    docs = _docs(spark, sf)
    return B.noisy(B.build_pair_match(B.adjacent_pairs(docs)).unionByName(B.build_classification(docs))
                   .unionByName(B.build_ordinal_match(table(spark, sf, "orders")))
                   .unionByName(B.build_relevance(*B.reply_links(table(spark, sf, "conversations")))))


def q_parse_labels(spark, sf):
    return _routed(_label_predictions(spark, sf), *LABEL_TASKS)


def q_parse_findings(spark, sf):
    return _routed(B.noisy(B.findings_predictions(table(spark, sf, "events"))), "findings")


def q_parse_report(spark, sf):
    return _routed(B.noisy(B.report_predictions(_docs(spark, sf))), "report")


def q_extract_response(spark, sf):
    return P.extract_response(B.raw_generations(table(spark, sf, "conversations"))).select("sample_id", "target")


def _submission(spark, sf):
    """PAR0 over all predictions, those of one maker at a time: a task's route is planned over the makers that may hold
    it, not over the union of all.  Every route is there, also those of tasks without predictions, and a prediction of a
    task that its maker does not make fails the job."""
    ev, docs = table(spark, sf, "events"), _docs(spark, sf)
    others = [t for t in ROUTES if t not in (
        "entities", "tagged_entities", "relations", "normalization", "events", "findings", "report")]
    made = ((_entity_predictions(spark, sf), ["entities", "tagged_entities"]),
            (_relation_predictions(spark, sf), ["relations"]), (_term_predictions(spark, sf), ["normalization"]),
            (_event_predictions(spark, sf), ["events"]), (_label_predictions(spark, sf), others),
            (B.noisy(B.findings_predictions(ev)), ["findings"]), (B.noisy(B.report_predictions(docs)), ["report"]))
    parsed = {}
    for preds, tasks in made:
        parsed |= P.parse_answers(preds, {t: ROUTES[t] for t in tasks})
    return {t: parsed[t] for t in ROUTES}


def q_submission_counts(spark, sf):
    return P.submission_counts(_submission(spark, sf))


def q_submission_files(spark, sf):
    """SNK3: the written submission read back: answers as JSON, one folder per task."""
    path = W.scratch_path(spark, "submission")
    W.write_submission(_submission(spark, sf), path)
    d = R.read_jsonl(spark, path, W.SUBMISSION)
    return d.groupBy("task_dataset").agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum(F.json_array_length("answers")).cast("long").alias("n_answers"))


def q_submission_written(spark, sf):
    """SNK3: what was written, counted while writing; every task is listed."""
    return W.write_submission(_submission(spark, sf), W.scratch_path(spark, "submission")).withColumnRenamed(
        "n_rows", "n_samples")


def q_submission_document(spark, sf):
    """SNK3: the one document of all tasks, read back by its lines.  The lines that open a list, one per task, tell which
    task a prediction's line belongs to."""
    path = W.write_submission_document(_submission(spark, sf), f"{W.scratch_path(spark, 'submission')}/all.json")
    lines = POS.read_lines(spark, path)
    opens = F.rlike("value", F.lit(r'^[{,]"[^"]*": \[$'))
    heads = lines.filter(opens).agg(F.array_sort(F.collect_list(F.struct(
        "position", F.regexp_extract("value", '"([^"]*)"', 1).alias("task"))))).scalar()
    item = F.from_json(F.regexp_replace("value", "^,", ""), "sample_id string, answers string")
    items = lines.withColumn("heads", heads).withColumn("task_dataset", F.element_at(
        F.filter("heads", lambda h: h["position"] <= F.col("position")), -1)["task"])
    return items.filter("value != '}'").groupBy("task_dataset").agg(
        F.count_if(~opens & (F.col("value") != "]")).alias("n_samples"),
        F.coalesce(F.sum(F.when(~opens, F.json_array_length(item["answers"]))), F.lit(0)).cast("long").alias("n_answers"))


QUERIES.update({
    "parse_entities": q_parse_entities,
    "parse_triples": q_parse_triples,
    "parse_terms": q_parse_terms,
    "parse_events": q_parse_events,
    "parse_labels": q_parse_labels,
    "parse_findings": q_parse_findings,
    "parse_report": q_parse_report,
    "extract_response": q_extract_response,
    "submission_counts": q_submission_counts,
    "submission_files": q_submission_files,
    "submission_written": q_submission_written,
    "submission_document": q_submission_document,
})
ORACLES.update({name: getattr(O, name) for name in (
    "parse_entities", "parse_triples", "parse_terms", "parse_events", "parse_labels", "parse_findings",
    "parse_report", "extract_response", "submission_counts", "submission_files", "submission_written", "submission_document")})


# ---------------------------------------------------------------- wraps, tokens, packing

from ..operators import tokens as TK  # noqa: E402
from ..operators.chunks import token_counts  # noqa: E402

MAX_LEN = 256


def _pairs(spark, sf):
    p = B.dialogue_pairs(table(spark, sf, "conversations"))
    return p.withColumn("sample_id", F.concat_ws("-", F.lit("dialogue"), F.col("conv_id").cast("string"),
                                                 F.col("i").cast("string")))


def _ids_text(c):
    col = F.col(c) if isinstance(c, str) else c
    return F.array_join(col.cast("array<string>"), " ")


def q_wrap_train(spark, sf):
    p = _pairs(spark, sf)
    return p.select("sample_id", TK.ensure_suffix("reply").alias("output"),
                    TK.wrap_train("prompt", "reply").alias("text"))


def q_wrap_prompt(spark, sf):
    return _pairs(spark, sf).select("sample_id", TK.wrap_prompt("prompt").alias("newinput"))


def q_ensure_eos(spark, sf):
    p = _pairs(spark, sf)
    return p.select("sample_id", TK.ensure_suffix("reply").alias("output"),
                    TK.ensure_suffix(TK.ensure_suffix("reply")).alias("output_twice"))


def preference_rows(spark, sf):
    """prompt = user turn, chosen = its reply, rejected = another reply drawn like JOI2."""
    from ..functions.draws import u
    queries, docs, links = B.reply_links(table(spark, sf, "conversations"))
    dkey = ["d_conv", "d_turn"]
    idx = B.index_turns(docs.select(*dkey))
    pos = links.join(idx, dkey).join(docs, dkey).select("conv_id", "turn", F.col("doc").alias("chosen"), "d_idx", "n_docs")
    q = queries.join(pos, ["conv_id", "turn"])
    i = F.floor(u(SEED, "preference", ["conv_id", "turn"], "rejected") * (F.col("n_docs") - 1)).cast("long")
    q = q.withColumn("r_idx", F.when(i >= F.col("d_idx"), i + 1).otherwise(i))
    r = idx.select(F.col("d_idx").alias("r_idx"), *dkey)
    return q.join(r, "r_idx").join(docs.select(*dkey, F.col("doc").alias("rejected")), dkey).select(
        F.concat_ws("-", F.lit("pref"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sample_id"),
        F.col("query").alias("prompt"), "chosen", "rejected")


def q_preference_pairs(spark, sf):
    return TK.preference_texts(preference_rows(spark, sf)).select("sample_id", "text_pos", "text_neg")


def q_build_vocab(spark, sf):
    return TK.build_vocab(_docs(spark, sf), "text")


def _conv_vocab(spark, sf):
    return TK.build_vocab(table(spark, sf, "conversations"), "text")


def q_encode_labels(spark, sf):
    p = _pairs(spark, sf).withColumn("output", TK.ensure_suffix("reply"))
    e = TK.encode(p, ["sample_id"], {"p_ids": ("prompt", True), "r_ids": ("output", False)},
                  _conv_vocab(spark, sf))
    ids, labels, mask = TK.labels_response("p_ids", "r_ids", MAX_LEN)
    e = e.select("sample_id", ids.alias("input_ids"), labels.alias("labels"), mask.alias("attention_mask"))
    return e.select("sample_id", F.size("input_ids").alias("n_ids"), _ids_text("input_ids").alias("input_ids"),
                    _ids_text("labels").alias("labels"), _ids_text("attention_mask").alias("attention_mask"))


def q_encode_all(spark, sf):
    p = _pairs(spark, sf).withColumn("TEXT", TK.wrap_train("prompt", "reply"))
    e = TK.encode(p, ["sample_id"], {"input_ids": ("TEXT", True)}, _conv_vocab(spark, sf))
    return e.select("sample_id", F.size("input_ids").alias("n_ids"), _ids_text("input_ids").alias("input_ids"),
                    _ids_text(TK.labels_all("input_ids")).alias("labels"),
                    _ids_text(TK.attention_mask("input_ids")).alias("attention_mask"))


def _coded_docs(spark, sf):
    return TK.code_texts(_docs(spark, sf), ["doc_id"], {"input_ids": "text"})


def _encoded(coded):
    """The vocabulary of the texts comes from the same pass as their codes."""
    return TK.encode_texts(coded, TK.vocab_of_counts(token_counts(coded)), ["input_ids"])


def _doc_ids(spark, sf, rows):
    return TK.encode(rows, ["doc_id"], {"input_ids": ("text", True)}, TK.build_vocab(_docs(spark, sf), "text"))


def q_truncate_filter(spark, sf):
    capped = _doc_ids(spark, sf, ORD.cap_rows(_docs(spark, sf).select("doc_id", "text"), 700, ["doc_id"]))
    kept = TK.filter_max_len(capped, "input_ids", 2048)
    return kept.select("doc_id", F.size("input_ids").alias("n_ids"),
                       _ids_text(TK.truncate_ids("input_ids", 128)).alias("prompt_ids"))


def q_encode_pairs(spark, sf):
    pr = TK.preference_texts(preference_rows(spark, sf))
    e = TK.encode(pr, ["sample_id"], {"ids_pos": ("text_pos", True), "ids_neg": ("text_neg", True)},
                  _conv_vocab(spark, sf))
    return e.select("sample_id", _ids_text("ids_pos").alias("input_ids_pos"),
                    _ids_text(TK.attention_mask("ids_pos")).alias("attention_mask_pos"),
                    _ids_text("ids_neg").alias("input_ids_neg"),
                    _ids_text(TK.attention_mask("ids_neg")).alias("attention_mask_neg"))


def q_pack_blocks(spark, sf):
    coded = _coded_docs(spark, sf)
    packed = TK.pack_blocks(_encoded(coded), "input_ids", TK.resolve_block_size(128, 4096), ["doc_id"], batch_rows=100,
                            sizes=TK.coded_sizes(coded, ["doc_id"], "input_ids", bos=True))
    packed = packed.withColumn("attention_mask", TK.attention_mask("input_ids"))
    return packed.select("batch", "block", F.size("input_ids").alias("n_ids"), _ids_text("input_ids").alias("input_ids"),
                         _ids_text("labels").alias("labels"),
                         F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"))


def q_map_tokenizer(spark, sf):
    """Tokens per document by the default splitter, inside the row; ``TK.map_tokenizer`` is where a user's own comes in."""
    return _docs(spark, sf).select("doc_id", F.size(TK.tokenize("text")).cast("long").alias("n_tokens"))


QUERIES.update({
    "wrap_train": q_wrap_train,
    "wrap_prompt": q_wrap_prompt,
    "ensure_eos": q_ensure_eos,
    "preference_pairs": q_preference_pairs,
    "build_vocab": q_build_vocab,
    "encode_labels": q_encode_labels,
    "encode_all": q_encode_all,
    "truncate_filter": q_truncate_filter,
    "encode_pairs": q_encode_pairs,
    "pack_blocks": q_pack_blocks,
    "map_tokenizer": q_map_tokenizer,
})
ORACLES.update({name: getattr(O, name) for name in (
    "wrap_train", "wrap_prompt", "ensure_eos", "preference_pairs", "build_vocab", "encode_labels",
    "encode_all", "truncate_filter", "encode_pairs", "pack_blocks", "map_tokenizer")})


# ---------------------------------------------------------------- metrics

from ..operators import metrics as MT  # noqa: E402

def q_shifted_accuracy(spark, sf):
    coded = _coded_docs(spark, sf)
    d = _encoded(coded)
    nxt = F.concat(F.slice("input_ids", 2, 1 << 30), F.array(F.lit(TK.EOS_ID)))
    # stand-in predictions: right for seven of ten positions
    preds = F.transform(nxt, lambda x, i: F.when((x * 7 + i) % 10 < 7, x).otherwise(F.lit(TK.UNK_ID)))
    return MT.shifted_accuracy(d.withColumn("preds", preds), "preds", "input_ids")


def q_perplexity(spark, sf):
    ev = table(spark, sf, "events")
    return MT.perplexity(ev, "value", ["event_type"])


def q_capped_counts(spark, sf):
    s = ORD.head_split(_docs(spark, sf).select("doc_id"), 5, ["doc_id"])
    return MT.capped_counts(s, 500, ["split"])


QUERIES.update({"shifted_accuracy": q_shifted_accuracy, "perplexity": q_perplexity, "capped_counts": q_capped_counts})
ORACLES.update({name: getattr(O, name) for name in ("shifted_accuracy", "perplexity", "capped_counts")})


# ---------------------------------------------------------------- files and streaming

from ..sinks import writers as W  # noqa: E402
from ..sources import positions as POS  # noqa: E402
from ..sources import readers as R  # noqa: E402
from ..streaming.prepare import stream_map, stream_transform  # noqa: E402


def q_jsonl_roundtrip(spark, sf):
    docs = _docs(spark, sf)
    s = B.event_samples(table(spark, sf, "orders"), table(spark, sf, "lineitem"), table(spark, sf, "part"))
    rows = B.build_events(s).unionByName(B.build_classification(docs))
    path = W.write_jsonl(rows, W.scratch_path(spark, "jsonl"))
    return report(R.read_jsonl(spark, path))


def _tsv_text(c):
    return F.regexp_replace(F.col(c), "[\t\r\n]", " ")


def q_tsv_pairs(spark, sf):
    c = table(spark, sf, "conversations")
    qid = (F.col("conv_id") * 1000 + F.col("turn")).cast("string")
    base = W.scratch_path(spark, "tsv")
    opts = {"sep": "\t", "quote": "", "escape": "", "header": False}
    c.filter(F.col("role") == "user").select(qid.alias("id"), _tsv_text("text").alias("t")).write.options(**opts).csv(f"{base}/queries")
    c.filter(F.col("role") == "assistant").select(qid.alias("id"), _tsv_text("text").alias("t")).write.options(**opts).csv(f"{base}/docs")
    c.filter(F.col("role") == "user").select(qid.alias("q"), (F.col("conv_id") * 1000 + F.col("turn") + 1).cast("string").alias("d")).write.options(**opts).csv(f"{base}/links")
    qs = R.read_tsv_pairs(spark, f"{base}/queries", ["query_id", "query"], ["bigint", "string"])
    ds = R.read_tsv_pairs(spark, f"{base}/docs", ["doc_id", "doc"], ["bigint", "string"])
    ls = R.read_tsv_pairs(spark, f"{base}/links", ["query_id", "doc_id"], ["bigint", "bigint"])
    return qs.join(ls, "query_id").join(ds, "doc_id").select("query_id", "doc_id", "query", "doc")


def q_ext_sources(spark, sf):
    """SRC6 / SRC7: csv, json and txt copies of the documents read back by file extension.

    Paths are Spark globs, so this works on any file system the cluster uses."""
    docs = _docs(spark, sf).select("doc_id", "lang", "source")
    base = W.scratch_path(spark, "ext")
    docs.write.option("header", True).csv(f"{base}/csv")
    docs.write.json(f"{base}/json")
    _docs(spark, sf).select("text").write.text(f"{base}/txt")
    schema = spark.createDataFrame([], "doc_id bigint, lang string, source string").schema
    out = []
    for fmt in ("csv", "json"):
        d = R.read_by_extension(spark, train=f"{base}/{fmt}/*.{fmt}", schema=schema)
        d = ORD.head_split(d.drop("split"), 5, ["doc_id"])
        out.append(d.select(F.lit(fmt).alias("fmt"), "split", F.col("doc_id").cast("string").alias("key"),
                            F.concat_ws(" ", "lang", "source").alias("value")))
    t = R.read_by_extension(spark, train=f"{base}/txt/*.txt", keep_linebreaks=True)
    out.append(t.groupBy("split", "text").agg(F.count(F.lit(1)).cast("string").alias("key")).select(
        F.lit("txt").alias("fmt"), "split", "key", F.sha2("text", 256).alias("value")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def q_split_by_task(spark, sf):
    docs = _docs(spark, sf)
    rows = B.build_ordinal_match(table(spark, sf, "orders")).unionByName(B.build_classification(docs))
    return W.split_by_task(rows, W.scratch_path(spark, "bytask"), [ORDINAL.name, CLASSIFICATION.name])


def q_write_predictions(spark, sf):
    conv = table(spark, sf, "conversations")
    from ..operators.parse import extract_response
    preds = extract_response(B.raw_generations(conv)).select("sample_id", "target")
    path = W.write_predictions(B.build_dialogue(conv), preds, W.scratch_path(spark, "preds"))
    return report(R.read_jsonl(spark, path))


def q_merge_shards(spark, sf):
    d = ORD.assign_shard(_docs(spark, sf).select("doc_id", "lang"), 8, ["doc_id"])
    base = W.scratch_path(spark, "shards")  # one folder per rank, written in one pass
    d.withColumn("rank", F.col("shard")).write.partitionBy("rank").json(base)
    merged = W.merge_shards(spark, base, "doc_id bigint, lang string, shard int, shard_row bigint, rank int")
    return merged.select("doc_id", "lang", "shard", "shard_row")


def q_file_manifest(spark, sf):
    """SNK7 over files of known content: one folder per nation and 1,000 customer keys, one row per file."""
    from ..sinks.manifest import file_manifest
    line = F.concat_ws("|", F.lpad(F.col("c_custkey").cast("string"), 12, "0"), "c_name")
    c = table(spark, sf, "customer").groupBy(F.concat_ws("-", F.col("c_nationkey").cast("string"), F.floor(
        F.col("c_custkey") / 1000).cast("string")).alias("part")).agg(
        F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("value"))
    path = f"{W.scratch_path(spark, 'manifest-sha256')}"
    c.write.partitionBy("part").text(path)
    return file_manifest(spark, path, "*.txt").select(
        F.regexp_extract("path", r"part=([^/]+)/", 1).alias("part"), "length", "sha256")


def _in_order(df, order, path, parts=4):
    """Text lines (column ``value``) in files whose names and lines follow ``order``."""
    df.repartitionByRange(parts, order).sortWithinPartitions(order).select("value").write.text(path)
    return path


def q_tsv_last_links(spark, sf):
    """SRC5 + JOI1: a link table as TSV files, several links per query in scattered order; the last line wins."""
    c = table(spark, sf, "conversations").filter(F.col("role") == "user").select(
        "conv_id", "turn", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
    line = F.concat_ws("\t", "conv_id", "turn", F.col("turn") + 1 + 2 * F.col("j"))
    order = F.md5(F.concat_ws("|", "conv_id", "turn", "j"))
    path = _in_order(c.select(line.alias("value"), order.alias("h")), "h", W.scratch_path(spark, "links-tsv"))
    links = POS.read_tsv_lines(spark, path, ["conv_id", "turn", "d_turn"], ["long", "long", "long"])
    return POS.last_of(links, ["conv_id", "turn"], ["d_turn", "position"])


def q_aligned_predictions(spark, sf):
    """JOI6 by position: predictions without ids, line i for row i; files of rows and predictions are cut differently."""
    rows = B.base_rows(table(spark, sf, "conversations"))
    src = rows.select("sample_id", F.to_json(F.struct("sample_id", "input")).alias("value"))
    preds = rows.select("sample_id", F.concat(F.lit("answer to "), F.char_length("input").cast("string"), F.lit(" of "),
                                              "sample_id").alias("value"))
    src = POS.read_lines(spark, _in_order(src, "sample_id", W.scratch_path(spark, "rows-jsonl")))
    preds = POS.read_lines(spark, _in_order(preds, "sample_id", W.scratch_path(spark, "predictions"), 7))
    src = src.select("position", F.from_json("value", "sample_id string, input string").alias("r")).select("position", "r.*")
    return POS.align_by_position(src, preds).select("position", "sample_id", "target")


def q_unmapped_codes(spark, sf):
    """PRJ9's report: event codes that the tagged task has no label for."""
    tagged = {tag.split("-")[1]: label for tag, label in B.TAG_LABELS.items()}
    return unmapped_codes(table(spark, sf, "events"), "event_type", tagged)


QUERIES["unmapped_codes"] = q_unmapped_codes
ORACLES["unmapped_codes"] = O.unmapped_codes


def q_stream_prepare(spark, sf):
    """STR1: instruction rows in several files, one file per micro-batch, mapped row by row into an append-mode sink; half
    of the files arrive after the stream has stopped, and the restarted one takes up where it was."""
    vocab = stored(_conv_vocab(spark, sf), "vocab")
    rows = _pairs(spark, sf).select("sample_id", "prompt", "reply")
    halves = stored(rows.withColumn("half", F.pmod(F.xxhash64("sample_id"), F.lit(2))), "stream-halves")
    source = W.scratch_path(spark, "stream-rows")
    encode = TK.row_encoder(vocab)

    def prepare(stream):
        p = stream.select("sample_id", F.concat(F.array(F.lit(TK.BOS_ID)), encode(F.col("prompt"))).alias("p_ids"),
                          encode(TK.ensure_suffix("reply")).alias("r_ids"))
        ids, labels, mask = TK.labels_response("p_ids", "r_ids", MAX_LEN)
        return p.select("sample_id", F.size(ids).alias("n_ids"), _ids_text(ids).alias("input_ids"),
                        _ids_text(labels).alias("labels"), _ids_text(mask).alias("attention_mask"))

    out, checkpoint = W.scratch_path(spark, "stream-prepare-out"), W.scratch_path(spark, "stream-prepare-ckpt")
    for half in (0, 1):
        halves.filter(F.col("half") == half).drop("half").repartition(3, "sample_id").write.mode("append").parquet(source)
        stream_map(spark, source, rows.schema, prepare, out, checkpoint, max_files_per_trigger=1)
    return spark.read.parquet(out)


def q_stream_pack(spark, sf):
    """STR2: packing per micro-batch, one per ``part``; a block's name is its batch and its number there.  A part
    arrives as many files, and the stream takes them up before the next part comes, so the order in which a file system
    lists files is of no account."""
    docs = _docs(spark, sf).select("doc_id", "text")
    vocab = stored(TK.build_vocab(docs, "text"), "vocab")
    source = W.scratch_path(spark, "stream-docs")
    parts = docs.withColumn("part", (F.col("doc_id") % 3).cast("int"))

    def per_batch(batch, epoch):
        coded = TK.code_texts(batch, ["doc_id"], {"input_ids": "text"})
        packed = TK.pack_blocks(TK.encode_texts(coded, vocab, ["input_ids"]), "input_ids", 128, ["doc_id"],
                                sizes=TK.coded_sizes(coded, ["doc_id"], "input_ids", bos=True))
        return packed.select("block", F.size("input_ids").alias("n_ids"), _ids_text("input_ids").alias("input_ids"),
                             batch.agg(F.max("part")).scalar().alias("part"))

    def arrivals():
        for p in sorted((r["part"] for r in parts.select("part").distinct().collect()), key=lambda x: (x is not None, x)):
            arrived = parts.filter(F.col("part").eqNullSafe(F.lit(p)))
            arrived.write.mode("append").partitionBy("part").parquet(source)
            yield p

    out = stream_transform(spark, source, parts.schema, per_batch, "stream-pack", arrivals=arrivals())
    n = out.agg(F.count_distinct("batch")).scalar()
    return out.select("part", "block", "n_ids", "input_ids", n.alias("n_batches"))


QUERIES.update({
    "jsonl_roundtrip": q_jsonl_roundtrip,
    "tsv_pairs": q_tsv_pairs,
    "tsv_last_links": q_tsv_last_links,
    "aligned_predictions": q_aligned_predictions,
    "ext_sources": q_ext_sources,
    "split_by_task": q_split_by_task,
    "write_predictions": q_write_predictions,
    "merge_shards": q_merge_shards,
    "file_manifest": q_file_manifest,
    "stream_prepare": q_stream_prepare,
    "stream_pack": q_stream_pack,
})
ORACLES.update({name: getattr(O, name) for name in (
    "jsonl_roundtrip", "tsv_pairs", "tsv_last_links", "aligned_predictions", "ext_sources", "split_by_task", "write_predictions", "merge_shards",
    "file_manifest", "stream_prepare", "stream_pack")})


def q_tag_length_check(spark, sf):
    """FLT7 with real mismatches: a keyed draw takes the last tag of some sequences away."""
    from ..functions.draws import u
    from ..operators.tags import decode_tags, length_mismatches
    d = decode_tags(B.tag_sequences(table(spark, sf, "events")), ["user_id", "day"], ["ts", "event_id"],
                    B.TAG_LABELS, bucket=F.date_trunc("hour", "ts"))
    lost = F.when(u(SEED, "tag_length", ["user_id", "day"], "lost") < 0.2, 1).otherwise(0)
    d = d.withColumn("n_tags", (F.col("n_tags") - lost).cast("int"))
    return length_mismatches(d, "sentence", "n_tags").select("user_id", F.col("day").cast("string").alias("day"),
                                                            "sentence", "n_tags")


def q_template_violations(spark, sf):
    """FLT5 over the tasks: prompts that fit no template or several; a keyed draw cuts some prompts' beginning off."""
    from ..functions.draws import u
    o, ev, docs = table(spark, sf, "orders"), table(spark, sf, "events"), _docs(spark, sf)
    made = ((RELATIONS, B.build_relations(B.relation_samples(o), vocab=B.relation_vocab(o))),
            (ENTITIES, B.build_entities(B.entity_samples(ev), vocab=B.entity_vocab(ev))),
            (ORDINAL, B.build_ordinal_match(o)), (CLASSIFICATION, B.build_classification(docs)),
            (DIALOGUE, B.build_dialogue(table(spark, sf, "conversations"))))
    out = None
    for spec, rows in made:
        cut = F.when(u(SEED, "violations", ["sample_id"], "cut") < 0.1, F.substring("input", 25, 1 << 30)).otherwise(F.col("input"))
        v = REP.template_violations(rows.withColumn("input", cut), "input", spec.templates).select(
            "task_dataset", "sample_id", F.size("matched").alias("n_matched"))
        out = v if out is None else out.unionByName(v)
    return out


def q_recognise_templates(spark, sf):
    """FLT5 + AGG1 with the templates of all tasks at once: which of them each prompt of four tasks fits."""
    from ..operators.templates import match_templates
    o, docs = table(spark, sf, "orders"), _docs(spark, sf)
    rows = B.build_ordinal_match(o).unionByName(B.build_pair_match(B.adjacent_pairs(docs))).unionByName(
        B.build_classification(docs)).unionByName(B.build_relations(B.relation_samples(o), vocab=B.relation_vocab(o)))
    every = [t for spec in ALL_TASKS for t in spec.templates]
    m = match_templates(rows, "input", every)
    return m.select("sample_id", F.array_join(F.transform("matched", lambda x: x.cast("string")), ",").alias("matched"))


def q_packed_lists(spark, sf):
    """SCL5, SET2, SET3: quoted ``##`` lists of part names per brand, unpacked, distinct in order, compared as sets."""
    from ..functions.text import split_keep, strip_quotes
    from ..operators.choices import distinct_in_order, sorted_difference
    p = table(spark, sf, "part")
    small = F.when(F.col("p_size") <= 25, F.struct("p_partkey", "p_name"))
    large = F.when(F.col("p_size") > 25, F.struct("p_partkey", "p_name"))
    packed = lambda c: F.concat(F.lit('"'), F.array_join(F.transform(
        F.array_sort(F.collect_list(c)), lambda s: s["p_name"]), "##"), F.lit('"'))
    g = p.groupBy("p_brand").agg(packed(small).alias("a"), packed(large).alias("b"))
    g = g.withColumns({c: distinct_in_order(split_keep(strip_quotes(c), "##")) for c in "ab"})
    return g.select("p_brand", F.array_join("a", "##").alias("names"), F.size("a").alias("n_names"),
                    F.array_join(sorted_difference(F.col("a"), F.col("b")), "##").alias("only_small"))


def q_shape_columns(spark, sf):
    """PRJ8: instruction rows and preference pairs shaped by their dataset kind."""
    ins = _pairs(spark, sf).select("sample_id", F.col("prompt").alias("input"), F.col("reply").alias("target"))
    pref = preference_rows(spark, sf)
    a = TK.shape_columns(ins, "instruction").select(F.lit("instruction").alias("kind"), "sample_id", "input", "output", F.col("TEXT").alias("text"))
    b = TK.shape_columns(pref, "preference").select(F.lit("preference").alias("kind"), "sample_id", "input", "output", F.col("rejected").alias("text"))
    c = TK.shape_preference(pref, "preference").select(F.lit("pairs").alias("kind"), "sample_id", F.col("prompt").alias("input"),
                                                       F.col("text_pos").alias("output"), F.col("text_neg").alias("text"))
    return a.unionByName(b).unionByName(c)


def q_text_lines(spark, sf):
    """SRC7: the documents' lines written as text and read back, newline kept and not."""
    path = W.scratch_path(spark, "lines")
    _docs(spark, sf).select(F.regexp_replace("text", "\r", " ").alias("text")).write.text(path)
    kept, bare = R.read_text(spark, path, True), R.read_text(spark, path, False)
    both = kept.withColumn("kept", F.lit(True)).unionByName(bare.withColumn("kept", F.lit(False)))
    return both.groupBy("kept", F.sha2("text", 256).alias("line_sha")).agg(F.count(F.lit(1)).alias("n"))


def q_bom_rows(spark, sf):
    """SRC9: JSON Lines in which every 17th row carries a byte-order mark; those rows are dropped."""
    path = W.scratch_path(spark, "bom")
    marked = F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit(R.BOM), "text")).otherwise(F.col("text"))
    _docs(spark, sf).select("doc_id", "lang", marked.alias("text")).write.json(path)
    schema = spark.createDataFrame([], "doc_id long, lang string, text string").schema
    return R.read_jsonl_text(spark, path, schema).select("doc_id", "lang", F.sha2("text", 256).alias("text_sha"))


def q_read_splits(spark, sf):
    """SRC8 and WIN7: split folders read from any file system; a validation split is cut only where none is there."""
    d = _docs(spark, sf).select("doc_id", "lang")
    out = None
    for name, parts in (("whole", {"train": d}), ("given", {"train": d.filter("doc_id % 5 != 0"), "validation": d.filter("doc_id % 5 = 0")})):
        base = W.scratch_path(spark, f"splits-{name}")
        for split, rows in parts.items():
            rows.write.json(f"{base}/{split}.json")
        back = R.read_splits(spark, base, d.schema)
        s = ORD.split_if_missing(back, 5, ["doc_id"]).withColumn("source", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out.select("source", "split", "doc_id", "lang")


def q_sample_exact(spark, sf):
    d = _docs(spark, sf).select("doc_id", "lang", "source")
    return sample_k(d, ["doc_id"], SEED, "exact", k=100)


for _name, _query in (("tag_length_check", q_tag_length_check), ("template_violations", q_template_violations),
                      ("recognise_templates", q_recognise_templates),
                      ("packed_lists", q_packed_lists), ("shape_columns", q_shape_columns), ("text_lines", q_text_lines),
                      ("bom_rows", q_bom_rows), ("read_splits", q_read_splits), ("sample_exact", q_sample_exact)):
    QUERIES[_name] = _query
    ORACLES[_name] = getattr(O, _name)


CONVS_PER_DOC = 16  # conversations per whole-document fixture file


def q_json_shapes(spark, sf):
    """SRC2-SRC4 over the real table: a JSON document per group of conversations, read back with each document reader
    (which also read one document in many splits, see the tests)."""
    from pyspark.sql import types as T
    c = table(spark, sf, "conversations").withColumn("g", F.floor(F.col("conv_id") / CONVS_PER_DOC))
    base = W.scratch_path(spark, "shapes")
    turn = F.struct(F.col("turn"), F.col("role").alias("id"), F.col("text").alias("Sentence"))
    per_conv = c.groupBy("g", "conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # SRC4: array of conversations, each an array of {id, Sentence}
    arr2 = per_conv.groupBy("g").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turns"))),
                                                           lambda s: F.transform(s["turns"], lambda t: F.struct(
                                                               t["id"].alias("id"), t["Sentence"].alias("Sentence"))))
                                               ).alias("value"))
    arr2.write.partitionBy("g").text(f"{base}/arrays")
    # SRC2: array of row objects
    arr = c.groupBy("g").agg(F.to_json(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "role", "text")))).alias("value"))
    arr.write.partitionBy("g").text(f"{base}/rows")
    # SRC3: object keyed by conversation id
    keyed = per_conv.groupBy("g").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(
        F.col("conv_id").cast("string"), F.struct(F.transform("turns", lambda t: F.struct(
            t["id"].alias("id"), t["Sentence"].alias("Sentence"))).alias("dialogue")))))).alias("value"))
    keyed.write.partitionBy("g").text(f"{base}/keyed")

    a = (R.read_conversations(spark, f"{base}/arrays/*/*.txt")
         .select(F.lit("arrays").alias("shape"), F.regexp_extract("file", r"g=(\d+)", 1).cast("long").alias("g"),
                 F.col("conv").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
                 F.col("id").alias("role"), F.col("Sentence").alias("text")))
    row_schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                               T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    b = (R.read_json_array(spark, f"{base}/rows/*/*.txt", row_schema)
         .select(F.lit("rows").alias("shape"), F.floor(F.col("conv_id") / CONVS_PER_DOC).alias("g"), F.col("conv_id").alias("conv"), "turn", "role", "text"))
    dialogue = T.StructType([T.StructField("dialogue", T.ArrayType(R.DIALOGUE_TURN))])
    k = (R.read_keyed_json(spark, f"{base}/keyed/*/*.txt", dialogue, "dialogue")
         .select(F.lit("keyed").alias("shape"), F.floor(F.col("key").cast("long") / CONVS_PER_DOC).alias("g"),
                 F.col("key").cast("long").alias("conv"), F.col("pos").cast("long").alias("turn"),
                 F.col("item.id").alias("role"), F.col("item.Sentence").alias("text")))
    return a.unionByName(b).unionByName(k)


QUERIES["json_shapes"] = q_json_shapes
ORACLES["json_shapes"] = O.json_shapes
