"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written directly against the pre-registered views (conversations, documents,
events, orders, ...).  Shared with the Spark side are only fixed constants:
template text, seeds, probabilities and the draw definition.
"""

from __future__ import annotations

from ..functions.text import sql_lit
from .common import sql_finish
from .tasks import DIALOGUE, SEED

NL = "chr(10)"


def dialogue_pairs_sql() -> str:
    return f"""
t AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'user' ELSE role END AS role,
             CASE role WHEN 'system' THEN '[system] ' || text ELSE text END AS text FROM conversations),
tv AS (SELECT conv_id, turn,
              CASE WHEN role IN ('user', 'assistant') THEN role ELSE error('unknown role') END AS role,
              text FROM t),
firsts AS (SELECT conv_id FROM tv GROUP BY conv_id HAVING arg_min(role, turn) = 'user'),
flagged AS (SELECT tv.*, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w <> role THEN 1 ELSE 0 END AS flag
            FROM tv SEMI JOIN firsts USING (conv_id)
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
numbered AS (SELECT *, sum(flag) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run
             FROM flagged),
runs AS (SELECT conv_id, run, min(role) AS role, string_agg(text, {NL} ORDER BY turn) AS text
         FROM numbered GROUP BY conv_id, run),
pairs AS (SELECT conv_id, CAST((run - 1) // 2 AS INTEGER) AS i,
                 max(CASE WHEN role = 'user' THEN text END) AS prompt,
                 max(CASE WHEN role = 'assistant' THEN text END) AS reply
          FROM runs GROUP BY 1, 2 HAVING prompt IS NOT NULL AND reply IS NOT NULL)"""


def dialogue_history(raw: bool = False) -> str:
    um, am = sql_lit(DIALOGUE.words["user"]), sql_lit(DIALOGUE.words["assistant"])
    hist = f"""hist AS (
  SELECT conv_id, i, reply,
         regexp_replace(coalesce(array_to_string(list({um} || prompt || {am} || reply) OVER (
             PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), '')
             || {um} || prompt, '^' || {NL} || '+', '') AS history
  FROM pairs)"""
    sel = sql_finish(DIALOGUE, ["conv_id", "i"], {"text": "history"}, "reply", None, SEED,
                     sep=None if raw else " | ")
    return f"WITH {dialogue_pairs_sql()},\n{hist}\nSELECT {sel} FROM hist"


# ---------------------------------------------------------------- builder helpers

from ..functions.draws import sql_draw_int, sql_hash, sql_u  # noqa: E402
from . import builders as _B  # noqa: E402
from .tasks import (CLASSIFICATION, CLASSIFICATION_SIZED, ENTITIES, EVENTS,  # noqa: E402
                    NORMALIZATION, ORDINAL, PAIR_MATCH, RELATIONS, RELEVANCE, TAGGED)

SEP = sql_lit(_B.SEP)
COLON = _B.COLON


def first_seen(list_sql: str) -> str:
    """Distinct keeping first occurrences (DuckDB's list_distinct does not keep order)."""
    return f"list_filter({list_sql}, lambda x, i: list_position({list_sql}, x) = i)"


def absent(own: str, vocab: str, n: str, task: str, key, draw: str) -> str:
    """Index draws into the sorted vocabulary: Floyd's distinct positions, keyed order, own labels dropped."""
    labels = f"(SELECT list(label ORDER BY label) FROM (SELECT DISTINCT label FROM {vocab} WHERE label IS NOT NULL))"
    m = f"(SELECT count(DISTINCT label) FROM {vocab})"
    t = f"CAST(floor({sql_u(SEED, task, key, draw_sql=f'{sql_lit(draw + ":floyd:")} || CAST(j AS VARCHAR)')} * (j + 1)) AS BIGINT)"
    seq = f"range(greatest({m} - ({n}) - len({own}), 0), {m})"
    picked = (f"list_reduce({seq}, lambda acc, j: acc || [CASE WHEN list_contains(acc, {t}) THEN j ELSE {t} END], "
              f"[]::BIGINT[])")
    h = sql_hash(SEED, task, key, draw_sql=f"{sql_lit(draw + ':ord:')} || CAST(x AS VARCHAR)")
    ordered = f"list_sort(list_transform({picked}, lambda x: {{'h': {h}, 'i': x}}))"
    drawn = f"list_select({labels}, list_transform({ordered}, lambda s: s.i + 1))"
    return f"list_slice(list_filter({drawn}, lambda v: NOT list_contains({own}, v)), 1, {n})"


def u_(task: str, key, draw: str) -> str:
    return sql_u(SEED, task, key, draw)


def dint(lo, hi, task, key, draw) -> str:
    return sql_draw_int(lo, hi, u_(task, key, draw))


def random_insert(arr: str, items: str, task: str, key, draw: str = "ins") -> str:
    pos = (f"CAST(floor({sql_u(SEED, task, key, draw_sql=f'{sql_lit(draw)} || CAST(it.i AS VARCHAR)')}"
           f" * (len(acc) + 1)) AS INTEGER)")
    step = (f"lambda acc, it: list_slice(acc, 1, {pos}) || [it.v] || "
            f"list_slice(acc, {pos} + 1, len(acc))")
    return (f"list_reduce(list_transform({items}, lambda x, i: {{'v': x, 'i': i - 1}}), "
            f"{step}, {arr})")


def map_case(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {sql_lit(k)} THEN {sql_lit(v)}" for k, v in mapping.items())
    return f"(CASE {col} {whens} END)"


def join_list(x: str) -> str:
    return f"array_to_string({x}, {SEP})"


# ---------------------------------------------------------------- BLD1

def build_relations(raw: bool = False) -> str:
    t, key, w, p = RELATIONS.name, ["o_custkey", "o_year"], RELATIONS.words, RELATIONS.probs
    line = (f"lambda pr: {sql_lit(w['line_a'])} || pr || {sql_lit(w['line_b'] + COLON)} || "
            f"array_to_string(list_transform(list_filter(triples, lambda x: x.predicate = pr), "
            f"lambda x: {sql_lit(w['head'])} || x.subject || {sql_lit(_B.SEP + w['tail'])} || x.object || '。'), '')")
    return f"""
WITH s AS (
  SELECT o_custkey, year(o_orderdate) AS o_year,
         list({{'predicate': o_orderpriority, 'subject': 'order ' || CAST(o_orderkey AS VARCHAR),
                'object': o_orderstatus}} ORDER BY o_orderdate, o_orderkey) AS triples
  FROM orders GROUP BY 1, 2),
vocab AS (SELECT DISTINCT o_orderpriority AS label FROM orders WHERE o_orderpriority IS NOT NULL),
s2 AS (SELECT *, 'customer ' || CAST(o_custkey AS VARCHAR) || ' in ' || CAST(o_year AS VARCHAR) || ': ' ||
              array_to_string(list_transform(triples, lambda x: x.subject || ' is ' || x.object || ' with ' || x.predicate), '; ') AS text,
              {first_seen("list_transform(triples, lambda x: x.predicate)")} AS own
       FROM s),
a AS (SELECT *, {absent('own', 'vocab', '1', t, key, 'absent1')} AS absent1,
             {absent('own', 'vocab', dint(1, 3, t, key, 'n_absent'), t, key, 'absent_n')} AS absent_n,
             {u_(t, key, 'exist')} < {p['exist']} AS ex, {u_(t, key, 'add_absent')} < {p['add_absent']} AS ad
      FROM s2),
c AS (SELECT *, CASE WHEN ex AND ad THEN own || absent1 WHEN ex THEN own ELSE absent_n END AS choices FROM a)
SELECT {sql_finish(RELATIONS, key, {"text": "text", "choices": join_list("choices")},
                   f"CASE WHEN ex THEN array_to_string(list_transform(choices, {line}), {NL}) ELSE {sql_lit(w['none'])} END",
                   "choices", SEED, sep=None if raw else " | ")}
FROM c"""


# ---------------------------------------------------------------- BLD2

def entity_samples_sql() -> str:
    return f"""
e AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, event_type,
             json_extract_string(props, '$.k') AS k FROM events),
s AS (SELECT user_id, day,
             list({{'type': {map_case('event_type', _B.EVENT_LABELS)}, 'entity': k, 'code': event_type}}
                  ORDER BY ts, event_id) AS ents
      FROM e GROUP BY 1, 2),
s2 AS (SELECT *, 'user ' || CAST(user_id AS VARCHAR) || ' on ' || CAST(day AS VARCHAR) || ': ' ||
              array_to_string(list_transform(ents, lambda x: x.code || ' ' || x.entity), ' ') AS text
       FROM s)"""


def build_entities(raw: bool = False) -> str:
    t, key, w, p = ENTITIES.name, ["user_id", "day"], ENTITIES.words, ENTITIES.probs
    line = (f"lambda ty: ty || {sql_lit(w['line'] + COLON)} || array_to_string(list_sort(list_distinct("
            f"list_transform(list_filter(ents, lambda x: x.type = ty), lambda x: x.entity))), {SEP})")
    ins = u_(t, key, "insert")
    return f"""
WITH {entity_samples_sql()},
vocab AS (SELECT DISTINCT unnest(list_transform(ents, lambda x: x.type)) AS label FROM s),
a AS (SELECT *, {first_seen("list_transform(ents, lambda x: x.type)")} AS own FROM s2),
b AS (SELECT *, {absent('own', 'vocab', '1', t, key, 'absent1')} AS absent1,
             {u_(t, key, 'exist')} < {p['exist']} AS ex,
             CAST(floor({ins} * len(own)) AS INTEGER) AS ipos
      FROM a),
c AS (SELECT *, CASE WHEN ex AND {u_(t, key, 'add_absent')} < {p['add_absent']} AND len(absent1) > 0 THEN
                  (CASE WHEN len(own) < 1 THEN [absent1[1]]
                        ELSE list_slice(own, 1, ipos) || [absent1[1]] || list_slice(own, ipos + 1, len(own)) END)
                WHEN ex THEN own ELSE absent1 END AS choices
      FROM b)
SELECT {sql_finish(ENTITIES, key, {"text": "text", "choices": join_list("choices")},
                   f"CASE WHEN ex THEN {sql_lit(w['head'])} || array_to_string(list_transform(choices, {line}), {NL}) "
                   f"ELSE {sql_lit(w['none'])} END", "choices", SEED, sep=None if raw else " | ")}
FROM c"""


# ---------------------------------------------------------------- WIN4 / BLD2b

def decode_tags_sql(dedupe_tail: bool = False) -> str:
    keep = ("row_number() OVER (PARTITION BY user_id, day, type, entity ORDER BY pos) = 1" if dedupe_tail else
            "row_number() OVER (PARTITION BY user_id, day, type, entity, (iend = ilast) ORDER BY pos) = 1")
    return f"""
tg AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id,
              chr(CAST(97 + ((CAST(json_extract_string(props, '$.k') AS INTEGER) % 26) + 26) % 26 AS INTEGER)) AS ch,
              CASE WHEN event_type IN ('signup', 'view') THEN 'O' ELSE 'B-' || event_type END AS tag
       FROM events),
ty AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY user_id, day) AS ilast,
              CASE WHEN tag = 'O' THEN NULL ELSE coalesce({map_case('tag', _B.TAG_LABELS)}, error('unknown tag')) END AS type
       FROM tg WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id)),
fl AS (SELECT *, CASE WHEN type IS NOT NULL AND (lag(type) OVER w IS NULL OR lag(type) OVER w <> type) THEN 1 ELSE 0 END AS st
       FROM ty WINDOW w AS (PARTITION BY user_id, day ORDER BY pos)),
isl AS (SELECT *, sum(st) OVER (PARTITION BY user_id, day ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM fl),
sent AS (SELECT user_id, day, string_agg(ch, '' ORDER BY pos) AS sentence, count(*) AS n_tags FROM isl GROUP BY 1, 2),
ents0 AS (SELECT user_id, day, island, min(pos) AS pos, max(pos) AS iend, max(ilast) AS ilast, min(type) AS type,
                 string_agg(ch, '' ORDER BY pos) AS entity
          FROM isl WHERE type IS NOT NULL GROUP BY 1, 2, 3),
ents1 AS (SELECT * FROM ents0 QUALIFY {keep}),
dec AS (SELECT s.user_id, s.day, s.sentence, s.n_tags,
               coalesce((SELECT list({{'pos': e.pos, 'type': e.type, 'entity': e.entity}} ORDER BY e.pos)
                         FROM ents1 e WHERE e.user_id = s.user_id AND e.day = s.day), []) AS ents
        FROM sent s)"""


def decode_tags() -> str:
    return f"""
WITH {decode_tags_sql()}
SELECT d.user_id, CAST(d.day AS VARCHAR) AS day, d.sentence, d.n_tags, e.pos, e.type, e.entity
FROM dec d, unnest(d.ents) AS u(e)"""


def build_tagged_entities(raw: bool = False) -> str:
    t, key, w, p = TAGGED.name, ["user_id", "day"], TAGGED.words, TAGGED.probs
    types = "[" + ", ".join(sql_lit(x) for x in _B.TAG_TYPES) + "]"
    n = len(_B.TAG_TYPES)
    line = (f"lambda tt: tt || {sql_lit(w['line'] + COLON)} || array_to_string(list_transform("
            f"list_filter(ents, lambda x: x.type = tt), lambda x: x.entity), {SEP})")
    return f"""
WITH {decode_tags_sql()},
tvocab AS (SELECT unnest({types}) AS label),
a AS (SELECT *, list_filter({types}, lambda tt: list_contains(list_transform(ents, lambda x: x.type), tt)) AS own
      FROM dec),
b AS (SELECT *, {absent('own', 'tvocab', dint(1, f'{n} - len(own)', t, key, 'n_absent'), t, key, 'absent')} AS absent,
             len(own) = {n} AS full_
      FROM a WHERE len(own) > 0),
c AS (SELECT *, ({u_(t, key, 'exist')} < {p['exist']}) OR full_ AS ex,
             ({u_(t, key, 'add_absent')} < {p['add_absent']}) AND NOT full_ AS ad FROM b),
d AS (SELECT *, CASE WHEN ex AND ad THEN own || absent WHEN ex THEN own ELSE absent END AS choices FROM c)
SELECT {sql_finish(TAGGED, key, {"text": "sentence", "choices": join_list("choices")},
                   f"CASE WHEN ex THEN {sql_lit(w['head'])} || array_to_string(list_transform(choices, {line}), {NL}) "
                   f"ELSE {sql_lit(w['none'])} END", "choices", SEED, sep=None if raw else " | ")}
FROM d"""


# ---------------------------------------------------------------- BLD3

def build_events(raw: bool = False) -> str:
    w = EVENTS.words
    values = ("e.core", "e.status", f"array_to_string(e.descr, {SEP})", f"array_to_string(e.parts, {SEP})")
    line = "lambda e: " + " || '；' || ".join(f"{sql_lit(k + COLON)} || {v}" for k, v in zip(w["keys"], values))
    return f"""
WITH li AS (SELECT l.l_orderkey, p.p_type, p.p_name FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
po AS (SELECT l_orderkey, list_sort(list(DISTINCT p_type)) AS descr, list_sort(list(DISTINCT p_name)) AS parts
       FROM li GROUP BY 1),
o AS (SELECT o.o_custkey, o.o_orderkey, o.o_orderdate, o.o_orderstatus,
             coalesce(po.descr, []::VARCHAR[]) AS descr, coalesce(po.parts, []::VARCHAR[]) AS parts
      FROM orders o LEFT JOIN po ON po.l_orderkey = o.o_orderkey),
s AS (SELECT o_custkey, list({{'core': 'order ' || CAST(o_orderkey AS VARCHAR), 'status': o_orderstatus,
                              'descr': descr, 'parts': parts}} ORDER BY o_orderdate, o_orderkey) AS events
      FROM o GROUP BY 1)
SELECT {sql_finish(EVENTS, ["o_custkey"],
                   {"text": "'customer ' || CAST(o_custkey AS VARCHAR) || ' placed ' || "
                            "array_to_string(list_transform(events, lambda e: e.core), ', ')"},
                   f"{sql_lit(w['head'])} || array_to_string(list_transform(events, {line}), {NL})", None, SEED,
                   sep=None if raw else " | ")}
FROM s"""


# ---------------------------------------------------------------- BLD4

def build_normalization(raw: bool = False) -> str:
    t, key, w, p = NORMALIZATION.name, ["p_brand", "p_size"], NORMALIZATION.words, NORMALIZATION.probs
    return f"""
WITH g AS (SELECT p_brand, p_size, list(p_name ORDER BY p_partkey) AS allnames FROM part GROUP BY 1, 2),
s AS (SELECT p_brand, p_size, {first_seen('allnames')} AS names,
             'parts of ' || p_brand || ' in size ' || CAST(p_size AS VARCHAR) AS text FROM g),
vocab AS (SELECT DISTINCT p_name AS label FROM part WHERE p_name IS NOT NULL),
a AS (SELECT *, {absent('names', 'vocab', dint(1, 3, t, key, 'n_insert'), t, key, 'extra')} AS extra,
             {absent('names', 'vocab', dint(2, 10, t, key, 'n_absent'), t, key, 'absent')} AS absent,
             {u_(t, key, 'exist')} < {p['exist']} AS ex
      FROM s),
c AS (SELECT *, CASE WHEN ex THEN {random_insert('names', 'extra', t, key)} ELSE absent END AS choices FROM a)
SELECT {sql_finish(NORMALIZATION, key, {"text": "text", "choices": join_list("choices")},
                   f"CASE WHEN ex THEN {join_list('names')} ELSE {sql_lit(w['none'])} END", "choices", SEED, sep=None if raw else " | ")}
FROM c"""


# ---------------------------------------------------------------- BLD5

def classification_ctes() -> str:
    t, key, w, p = CLASSIFICATION.name, ["doc_id"], CLASSIFICATION.words, CLASSIFICATION.probs
    return f"""
cd AS (SELECT doc_id, text, source, [source] AS own FROM documents WHERE source <> {sql_lit(w['drop'])}),
cvocab AS (SELECT DISTINCT source AS label FROM cd),
ca AS (SELECT *, {absent('own', 'cvocab', dint(3, 9, t, key, 'n_none'), t, key, 'absent_none')} AS absent_none,
              {absent('own', 'cvocab', dint(2, 9, t, key, 'n_absent'), t, key, 'absent')} AS absent,
              {u_(t, key, 'not_exist')} < {p['not_exist']} AS nx
       FROM cd),
cc AS (SELECT *, CASE WHEN nx THEN absent_none ELSE absent || own END AS choices,
              CASE WHEN nx THEN {sql_lit(w['none'])} ELSE source END AS target_
       FROM ca)"""


def build_classification(raw: bool = False) -> str:
    sel = sql_finish(CLASSIFICATION, ["doc_id"], {"text": "text", "choices": join_list("choices")},
                     "target_", "choices", SEED, sep=None if raw else " | ")
    return f"WITH {classification_ctes()}\nSELECT {sel} FROM cc"


def build_classification_sized(raw: bool = False) -> str:
    t, key, w, p = CLASSIFICATION_SIZED.name, ["doc_id"], CLASSIFICATION_SIZED.words, CLASSIFICATION_SIZED.probs
    unit = u_(t, key, "size")
    return f"""
WITH {classification_ctes()},
sizes AS (SELECT len(choices) AS n, count(*) AS cnt FROM cc GROUP BY 1),
dist AS (SELECT n, sum(cnt) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) / sum(cnt) OVER () AS cum FROM sizes),
rd AS (SELECT d.doc_id, d.text, coalesce(n.n_name, 'ELSEWHERE') AS region, [coalesce(n.n_name, 'ELSEWHERE')] AS own
       FROM documents d LEFT JOIN nation n ON n.n_nationkey = TRY_CAST(regexp_extract(d.source, '(\\d+)$', 1) AS INTEGER)),
rvocab AS (SELECT n_name AS label FROM nation),
m AS (SELECT *, coalesce((SELECT greatest(n - 1, 0) FROM dist WHERE cum > {unit} ORDER BY n LIMIT 1),
                         (SELECT greatest(max(n) - 1, 0) FROM dist)) AS m FROM rd),
a AS (SELECT *, {absent('own', 'rvocab', 'm', t, key, 'absent')} AS absent,
             {absent('own', 'rvocab', 'm + 1', t, key, 'absent_none')} AS absent_none,
             {u_(t, key, 'exist')} < {p['exist']} AS ex
      FROM m),
c AS (SELECT *, CASE WHEN ex THEN {random_insert('absent', 'own', t, key)} ELSE absent_none END AS choices FROM a)
SELECT {sql_finish(CLASSIFICATION_SIZED, key, {"text": "text", "choices": join_list("choices")},
                   f"CASE WHEN ex THEN region ELSE {sql_lit(w['none'])} END", "choices", SEED, sep=None if raw else " | ")}
FROM c"""


# ---------------------------------------------------------------- BLD6

def build_pair_match(raw: bool = False) -> str:
    from .common import sql_sample_id
    from ..operators.templates import sql_pick_template, sql_render
    spec, key = PAIR_MATCH, ["doc_id"]
    wording = spec.words["wording"]
    yl = "[" + ", ".join(sql_lit(x[0]) for x in wording) + "]"
    nl = "[" + ", ".join(sql_lit(x[1]) for x in wording) + "]"
    idx = sql_pick_template(len(spec.templates), SEED, spec.name, key)
    return f"""
WITH pr AS (SELECT a.doc_id, a.text AS text1, b.text AS text2, CASE WHEN a.lang = b.lang THEN '1' ELSE '0' END AS label
            FROM documents a JOIN documents b ON b.doc_id - 1 = a.doc_id),
x AS (SELECT *, {idx} AS ti FROM pr),
y AS (SELECT *, {yl}[ti + 1] AS yw, {nl}[ti + 1] AS nw FROM x)
SELECT {sql_render(spec.templates, 'ti', {"a": "text1", "b": "text2"})} AS input,
       CASE WHEN label = '1' THEN yw ELSE nw END AS target,
       {"[yw, nw]" if raw else "yw || ' | ' || nw"} AS answer_choices, {sql_lit(spec.task_type)} AS task_type,
       {sql_lit(spec.name)} AS task_dataset, {sql_sample_id(spec, key)} AS sample_id
FROM y"""


def build_ordinal_match(raw: bool = False) -> str:
    spec, key = ORDINAL, ["o_orderkey"]
    ch = "[" + ", ".join(sql_lit(x) for x in spec.words["choices"]) + "]"
    return f"""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS label,
                  {ch} AS choices FROM orders)
SELECT {sql_finish(spec, key, {"a": "'order ' || CAST(o_orderkey AS VARCHAR)",
                               "b": "'customer ' || CAST(o_custkey AS VARCHAR) || ' on ' || strftime(o_orderdate, '%Y-%m-%d')",
                               "choices": join_list("choices")}, "choices[label + 1]", "choices", SEED, sep=None if raw else " | ")}
FROM o"""


# ---------------------------------------------------------------- BLD7

def build_relevance(raw: bool = False) -> str:
    spec, key, w, p = RELEVANCE, ["conv_id", "turn"], RELEVANCE.words, RELEVANCE.probs
    return f"""
WITH q AS (SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user'),
d AS (SELECT conv_id AS d_conv, turn AS d_turn, text AS doc,
             row_number() OVER (ORDER BY conv_id, turn) - 1 AS d_idx, count(*) OVER () AS n_docs
      FROM conversations WHERE role = 'assistant'),
lk AS (SELECT conv_id, turn, arg_max(conv_id, turn) AS d_conv, arg_max(turn + 1, turn) AS d_turn
       FROM q GROUP BY 1, 2),
pos AS (SELECT lk.conv_id, lk.turn, d.d_idx AS pos_idx, d.n_docs FROM lk JOIN d USING (d_conv, d_turn)),
qq AS (SELECT q.*, pos.pos_idx, pos.n_docs, {u_(spec.name, key, 'relevant')} < {p['relevant']} AS rel,
              CAST(floor({u_(spec.name, key, 'negative')} * (pos.n_docs - 1)) AS BIGINT) AS ni
       FROM q JOIN pos USING (conv_id, turn)),
qd AS (SELECT qq.*, d.doc FROM qq JOIN d ON d.d_idx = CASE WHEN rel THEN pos_idx WHEN ni >= pos_idx THEN ni + 1 ELSE ni END)
SELECT {sql_finish(spec, key, {"a": "query", "b": "doc"},
                   f"CASE WHEN rel THEN {sql_lit(w['yes'])} ELSE {sql_lit(w['no'])} END",
                   f"[{sql_lit(w['yes'])}, {sql_lit(w['no'])}]", SEED, sep=None if raw else " | ")}
FROM qd"""


# ---------------------------------------------------------------- ordering and sampling

def _udoc(task: str, draw: str) -> str:
    return sql_u(SEED, task, ["doc_id"], draw)


def sample_k() -> str:
    return f"""
SELECT doc_id, lang, source, n_chars FROM documents
QUALIFY row_number() OVER (ORDER BY {_udoc('documents', 'sample')}, doc_id) <= floor(count(*) OVER () * 0.3)"""


def shuffle_rows() -> str:
    return f"""
SELECT doc_id, row_number() OVER (ORDER BY {_udoc('shuffle', 'shuffle')}, doc_id) - 1 AS position FROM documents"""


def head_split() -> str:
    return """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < floor(count(*) OVER () * 5 / 100 + 0.5)
                    THEN 'validation' ELSE 'train' END AS split
FROM documents"""


def cap_rows() -> str:
    return "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= 700"


def assign_shard() -> str:
    return """
WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, ceil(count(*) OVER () / 8) AS per
           FROM documents)
SELECT doc_id, CAST(floor(idx / per) AS INTEGER) AS shard, CAST(idx - floor(idx / per) * per AS BIGINT) AS shard_row
FROM x"""


def assign_batch() -> str:
    return """
WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)
SELECT doc_id, idx // 64 AS batch, CAST(idx % 64 AS INTEGER) AS batch_row FROM x"""


# ---------------------------------------------------------------- runs and histograms

def merge_runs() -> str:
    return f"""
WITH f AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NULL OR lag(event_type) OVER w <> event_type
                          THEN 1 ELSE 0 END AS flag
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(flag) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, arg_min(event_id, (ts, event_id)) AS first_event_id,
       count(*) AS n_turns, string_agg(props, {NL} ORDER BY ts, event_id) AS text
FROM r GROUP BY user_id, run"""


def turn_histogram() -> str:
    return """
WITH f AS (SELECT *, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w <> role THEN 1 ELSE 0 END AS flag
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
runs AS (SELECT conv_id, role FROM f WHERE flag = 1),
roles AS (SELECT unnest(['user', 'assistant', 'system']) AS role),
convs AS (SELECT DISTINCT conv_id FROM conversations),
per AS (SELECT c.conv_id, r.role, (SELECT count(*) FROM runs x WHERE x.conv_id = c.conv_id AND x.role = r.role) AS n_runs
        FROM convs c, roles r)
SELECT role, n_runs, count(*) AS n_conversations FROM per GROUP BY role, n_runs"""


def marker_histogram() -> str:
    ms = [DIALOGUE.words["user"].strip("\n"), DIALOGUE.words["assistant"].strip("\n")]
    arms = " UNION ALL ".join(
        f"SELECT {sql_lit(m)} AS marker, CAST((length(input) - length(replace(input, {sql_lit(m)}, ''))) "
        f"// {len(m)} AS INTEGER) AS n FROM dh" for m in ms)
    return f"""
WITH dh AS ({dialogue_history()})
SELECT marker, n, count(*) AS n_rows FROM ({arms}) GROUP BY marker, n"""


# ---------------------------------------------------------------- vocabularies

def vocabulary() -> str:
    return """
WITH v AS (SELECT DISTINCT p_name AS label FROM part WHERE p_name IS NOT NULL)
SELECT label, row_number() OVER (ORDER BY label) - 1 AS position FROM v"""


def vocabulary_first_seen() -> str:
    return """
WITH v AS (SELECT source AS label, min(doc_id) AS first_seen FROM documents GROUP BY source)
SELECT label, first_seen, row_number() OVER (ORDER BY first_seen) - 1 AS position FROM v"""


def size_distribution() -> str:
    return f"""
WITH {classification_ctes()},
s AS (SELECT CAST(len(choices) AS INTEGER) AS n, count(*) AS count FROM cc GROUP BY 1)
SELECT n, count, round(count / sum(count) OVER (), 6) AS probability,
       round(sum(count) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) / sum(count) OVER (), 6) AS cumulative
FROM s"""


# ---------------------------------------------------------------- template recognition

def _relation_rows_with_template() -> str:
    from ..operators.templates import sql_pick_template
    idx = sql_pick_template(len(RELATIONS.templates), SEED, RELATIONS.name, ["o_custkey", "o_year"])
    sql = build_relations()
    head, sel = sql.rsplit("SELECT ", 1)
    return f"{head}SELECT {idx} AS template_id, {sel}"


def _matched_list() -> str:
    from ..operators.templates import pattern_of
    arms = ", ".join(f"CASE WHEN regexp_matches(input, {sql_lit(pattern_of(t))}) THEN {i} END"
                     for i, t in enumerate(RELATIONS.templates))
    return f"list_filter([{arms}], lambda x: x IS NOT NULL)"


def match_templates() -> str:
    return f"""
WITH rr AS ({_relation_rows_with_template()}),
m AS (SELECT sample_id, CAST(template_id AS INTEGER) AS template_id, {_matched_list()} AS matched FROM rr)
SELECT sample_id, template_id, array_to_string(list_transform(matched, lambda x: CAST(x AS VARCHAR)), ',') AS matched,
       CAST(len(matched) AS INTEGER) AS n_matched
FROM m"""


def recognise_templates() -> str:
    from ..operators.templates import pattern_of
    from .tasks import ALL_TASKS
    every = [t for spec in ALL_TASKS for t in spec.templates]
    hits = ", ".join(f"CASE WHEN regexp_matches(input, {sql_lit(pattern_of(t))}) THEN '{i}' END" for i, t in enumerate(every))
    arms = " UNION ALL ".join(f"SELECT sample_id, input FROM ({q(raw=True)})" for q in (
        build_ordinal_match, build_pair_match, build_classification, build_relations))
    return f"SELECT sample_id, array_to_string(list_filter([{hits}], lambda x: x IS NOT NULL), ',') AS matched FROM ({arms})"


def pattern_counts() -> str:
    return f"""
WITH rr AS ({_relation_rows_with_template()}),
m AS (SELECT unnest({_matched_list()}) AS template_id FROM rr)
SELECT CAST(template_id AS INTEGER) AS template_id, count(*) AS n_rows FROM m GROUP BY 1"""


# ---------------------------------------------------------------- exemplar report

def exemplar_report() -> str:
    return """
WITH d AS (SELECT source, doc_id, text, length(text) AS length FROM documents),
g AS (SELECT source, arg_min(doc_id, doc_id) AS first_id, arg_min(length, doc_id) AS first_len,
             arg_min(doc_id, (length, doc_id)) FILTER (WHERE length > 50) AS best_id
      FROM d GROUP BY source),
pick AS (SELECT source, CASE WHEN first_len <= 50 OR best_id IS NULL THEN first_id ELSE best_id END AS doc_id FROM g)
SELECT d.source, d.doc_id, d.length,
       replace('| ' || d.source || ' | ' || CAST(d.doc_id AS VARCHAR) || ' | ' || CAST(d.length AS VARCHAR) || ' | '
               || d.text || ' |', chr(10), '\\n') AS markdown
FROM pick JOIN d USING (source, doc_id)"""


# ---------------------------------------------------------------- mixture

def _sampled(sql: str, fraction: float, task: str) -> str:
    unit = sql_u(SEED, task, ["sample_id"], "sample")
    return (f"SELECT * FROM ({sql}) QUALIFY row_number() OVER (ORDER BY {unit}, sample_id) "
            f"<= floor(count(*) OVER () * {fraction})")


def mixture(raw: bool = False) -> str:
    f = _B.MIX_FRACTION
    builders = ((build_relations, RELATIONS), (build_entities, ENTITIES), (build_tagged_entities, TAGGED),
                (build_events, EVENTS), (build_normalization, NORMALIZATION), (build_classification, CLASSIFICATION),
                (build_classification_sized, CLASSIFICATION_SIZED), (build_pair_match, PAIR_MATCH),
                (build_ordinal_match, ORDINAL), (build_relevance, RELEVANCE), (dialogue_history, DIALOGUE))
    parts = [(make(raw=raw), spec.name) for make, spec in builders]
    base = f"""WITH {dialogue_pairs_sql()}
SELECT prompt AS input, reply AS target, CAST(NULL AS VARCHAR{"[]" if raw else ""}) AS answer_choices, 'base' AS task_type,
       'base' AS task_dataset, concat_ws('-', 'base', CAST(conv_id AS VARCHAR), CAST(i AS VARCHAR)) AS sample_id
FROM pairs"""
    arms = [f"SELECT input, target, answer_choices, task_type, task_dataset, sample_id FROM ({base})"]
    arms += [f"SELECT input, target, answer_choices, task_type, task_dataset, sample_id FROM ({_sampled(s, f, t)})"
             for s, t in parts]
    return "\nUNION ALL\n".join(arms)


def task_counts() -> str:
    return f"SELECT task_dataset, count(*) AS n_rows FROM ({mixture()}) GROUP BY task_dataset"


def content_manifest() -> str:
    def item(c: str) -> str:
        return f"coalesce(CAST(length({c}) AS VARCHAR) || ':' || {c}, 'N')"

    fields = [item(c) for c in ("input", "target", "task_type", "task_dataset", "sample_id")]
    fields.insert(2, "coalesce('A' || CAST(len(answer_choices) AS VARCHAR) || ':' || array_to_string(list_transform("
                     f"answer_choices, lambda x: {item('x')}), ''), 'N')")
    parts = [f"CAST(sum(CAST(('0x' || substr(h, {i}, 13))::BIGINT AS HUGEINT)) AS VARCHAR)" for i in (1, 14, 27, 40, 53)]
    return f"""
WITH m AS (SELECT task_dataset, sha256({" || ".join(fields)}) AS h FROM ({mixture(raw=True)}))
SELECT task_dataset, count(*) AS n_rows, {" || '-' || ".join(parts)} AS digest FROM m GROUP BY task_dataset"""


# ---------------------------------------------------------------- parsers

from ..functions.text import sql_strip_ws as _strip  # noqa: E402
from ..operators import parse as _P  # noqa: E402


def _rep_first(inp: str, a: str, b: str, n: int = 100) -> str:
    parts = f"string_split({inp}, '{a}')"
    return (f"(CASE WHEN len({parts}) <= {n + 1} THEN replace({inp}, '{a}', '{b}') "
            f"ELSE array_to_string({parts}[1:{n + 1}], '{b}') || '{a}' || array_to_string({parts}[{n + 2}:], '{a}') END)")


def _noisy(src_sql: str) -> str:
    t = "target"
    return f"""
SELECT * REPLACE (
  CASE nk WHEN 0 THEN '' WHEN 1 THEN translate({t}, '：，；', ':,;') WHEN 2 THEN 'note' || {NL} || {t} || {NL} || {NL}
          WHEN 3 THEN repeat('x,', 120) || {t} || repeat(', y', 120) WHEN 4 THEN replace({t}, {NL}, {NL} || '  ')
          ELSE {t} END AS target,
  CASE WHEN nk <> 5 THEN sample_id END AS sample_id)
FROM (SELECT *, CAST(floor({sql_u(SEED, 'noise', ['sample_id'], 'kind')} * 8) AS INTEGER) AS nk FROM ({src_sql}))"""


def _folded(src_sql: str) -> str:
    """CTEs ending in ``pf`` (noisy predictions, numbered; ``sample_id`` defaulted, ``g`` = folded target)."""
    return f"""src AS ({_noisy(src_sql)}),
f1 AS (SELECT * REPLACE (coalesce(sample_id, '{_P.MISSING_ID}') AS sample_id,
                         coalesce(answer_choices, []::VARCHAR[]) AS answer_choices),
              row_number() OVER () AS rn, {_rep_first('target', ':', '：')} AS g1 FROM src),
f2 AS (SELECT *, {_rep_first('g1', ',', '，')} AS g2 FROM f1),
pf AS (SELECT *, {_rep_first('g2', ';', '；')} AS g FROM f2)"""


def _with_empty(cols: str) -> str:
    """Rows of ``r`` per prediction; a prediction without one keeps a row of nulls."""
    return f"SELECT pf.task_dataset, pf.sample_id, {cols} FROM pf LEFT JOIN r USING (rn)"


def _items(x: str) -> str:
    """split on the list separator, strip every item, drop empty ones."""
    return f"list_filter(list_transform(string_split({x}, '{_P.SEP}'), lambda z: {_strip('z')}), lambda z: length(z) > 0)"


def _lines_of(x: str) -> str:
    return f"unnest(list_transform({x}, lambda x, i: {{'line': x, 'li': i - 1}}))"


def _entity_src() -> str:
    return f"SELECT * FROM ({build_entities(raw=True)}) UNION ALL SELECT * FROM ({build_tagged_entities(raw=True)})"


def parse_entities() -> str:
    words = {t.name: t.words["line"] for t in (ENTITIES, TAGGED)}
    w = "(CASE task_dataset " + " ".join(f"WHEN {sql_lit(k)} THEN {sql_lit(v)}" for k, v in words.items()) + " END)"
    wc = f"{w} || {sql_lit(_P.COLON)}"
    return f"""
WITH {_folded(_entity_src())},
c AS (SELECT rn, task_dataset, g, unnest(list_transform(answer_choices, lambda x, i: {{'type': x, 'ci': i - 1}})) AS c FROM pf),
l AS (SELECT rn, task_dataset, c.type AS type, c.ci AS choice_no, {_lines_of(f"string_split(g, {NL})")} AS l FROM c),
h AS (SELECT rn, type, choice_no, l.li AS line_no,
             {_items(f"replace(l.line, type || {wc}, '')")} AS ms
      FROM l WHERE starts_with(l.line, type || {w})),
r AS (SELECT rn, type, CAST(choice_no AS INTEGER) AS choice_no, CAST(line_no AS INTEGER) AS line_no,
       CAST(m.mi - 1 AS INTEGER) AS mention_no, m.entity
      FROM h, unnest(list_transform(ms, lambda x, i: {{'entity': x, 'mi': i}})) AS t(m))
{_with_empty("r.type, r.choice_no, r.line_no, r.mention_no, r.entity")}"""


def parse_triples() -> str:
    pre, mark, head, tail = (RELATIONS.words[k] for k in ("line_a", "line_b", "head", "tail"))
    return f"""
WITH {_folded(build_relations(raw=True))},
l AS (SELECT rn, {_lines_of(f"string_split(g, {NL})")} AS l FROM pf),
p AS (SELECT rn, l.li AS line_no, l.line AS line,
             {_strip(f"substr(string_split(l.line, {sql_lit(mark)})[1], {len(pre) + 1})")} AS predicate FROM l),
b AS (SELECT *, replace(line, {sql_lit(pre)} || predicate || {sql_lit(mark + _P.COLON)}, '') AS body FROM p),
s AS (SELECT rn, predicate, line_no,
             unnest(list_transform(string_split(body, '{_P.STOP}'), lambda x, i: {{'spo': x, 'si': i - 1}})) AS s FROM b),
t AS (SELECT *, string_split(s.spo, {sql_lit(_P.SEP + tail)}) AS pc FROM s),
r AS (SELECT rn, predicate, {_strip(f"replace(pc[1], {sql_lit(head)}, '')")} AS subject,
             {_strip(f"replace(pc[2], {sql_lit(tail)}, '')")} AS object,
             CAST(line_no AS INTEGER) AS line_no, CAST(s.si AS INTEGER) AS pair_no
      FROM t WHERE len(pc) >= 2)
{_with_empty("r.predicate, r.subject, r.object, r.line_no, r.pair_no")}"""


def parse_terms() -> str:
    return f"""
WITH {_folded(build_normalization(raw=True))},
a AS (SELECT rn, list_filter({_items(f"string_split(g, {NL})[-1]")},
                             lambda z: list_contains(answer_choices, z)) AS vals FROM pf),
d AS (SELECT rn, {first_seen('vals')} AS vals FROM a),
r AS (SELECT rn, CAST(v.i - 1 AS INTEGER) AS term_no, v.x AS entity, 'normalization' AS type
      FROM d, unnest(list_transform(vals, lambda x, i: {{'x': x, 'i': i}})) AS t(v))
{_with_empty("r.term_no, r.entity, r.type")}"""


def parse_events() -> str:
    keys, list_keys = EVENTS.words["keys"], EVENTS.words["list_keys"]
    ctes, cur, prev = [], "pcs", "p"
    for i, k in enumerate(keys):
        kc = sql_lit(k + _P.COLON)
        ctes.append(f"""c{i} AS (SELECT *, starts_with({prev}, {kc}) AS h{i},
    CASE WHEN starts_with({prev}, {kc}) THEN {_strip(f"replace({prev}, {kc}, '')")} ELSE {prev} END AS v{i}
    FROM {cur})""")
        cur, prev = f"c{i}", f"v{i}"
    cols = []
    for i, k in enumerate(keys):
        last = f"arg_max(v{i}, pi) FILTER (WHERE h{i})"
        val = f"array_to_string({_items(last)}, ' + ')" if k in list_keys else last
        cols.append(f"coalesce({val}, '') AS {sql_name(k)}")
    return f"""
WITH {_folded(build_events(raw=True))},
ev AS (SELECT rn, {_lines_of(f"string_split(g, {NL})[2:]")} AS e FROM pf),
pcs0 AS (SELECT rn, e.li AS event_no,
                unnest(list_transform(string_split(e.line, '{_P.FIELD_SEP}'), lambda x, i: {{'p': x, 'pi': i}})) AS q FROM ev),
pcs AS (SELECT rn, event_no, q.p AS p, q.pi AS pi FROM pcs0),
{",".join(ctes)},
r AS (SELECT rn, CAST(event_no AS INTEGER) AS event_no, {", ".join(cols)} FROM {cur} GROUP BY rn, event_no)
{_with_empty("r.event_no, " + ", ".join(f"r.{sql_name(k)}" for k in keys))}"""


def sql_name(k: str) -> str:
    return f'"{k.lower()}"'


def _label_src() -> str:
    return (f"SELECT * FROM ({build_pair_match(raw=True)}) UNION ALL SELECT * FROM ({build_classification(raw=True)}) "
            f"UNION ALL SELECT * FROM ({build_ordinal_match(raw=True)}) UNION ALL SELECT * FROM ({build_relevance(raw=True)})")


def parse_labels() -> str:
    from .catalog import SYNONYMS
    a = _strip("g")
    folded = a
    for k, v in SYNONYMS.items():
        folded = f"(CASE WHEN {folded} = {sql_lit(k)} THEN {sql_lit(v)} ELSE {folded} END)"
    return f"""
WITH {_folded(_label_src())}
SELECT task_dataset, sample_id, CASE WHEN task_dataset = 'pair_match' THEN {folded} ELSE {a} END AS label FROM pf"""


def _findings_src() -> str:
    return f"""
SELECT 'findings of the day' AS input,
       'Findings:' || {NL} || string_agg(line, {NL} ORDER BY ts, event_id) AS target,
       {"[" + ", ".join(sql_lit(c) for c in _B.FINDING_CHOICES) + "]"} AS answer_choices,
       'findings' AS task_type, 'findings' AS task_dataset,
       concat_ws('-', 'findings', CAST(user_id AS VARCHAR), CAST(day AS VARCHAR)) AS sample_id
FROM (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id,
             CASE WHEN event_type IN ('error', 'purchase') THEN event_type || ' ' || props || ':' || attr
                  ELSE event_type || ' ' || json_extract_string(props, '$.k') || ':' || attr END AS line
      FROM (SELECT *, CASE WHEN value < 20 THEN 'positive' WHEN value < 60 THEN 'negative' ELSE 'mixed' END AS attr
            FROM events))
GROUP BY user_id, day"""


def parse_findings() -> str:
    from .catalog import FALLBACK
    return f"""
WITH {_folded(_findings_src())},
l AS (SELECT rn, answer_choices, {_lines_of(f"string_split(g, {NL})[2:]")} AS l FROM pf),
p AS (SELECT *, string_split({_strip('l.line')}, '{_P.COLON}') AS pc FROM l),
r AS (SELECT rn, {_strip('pc[1]')} AS entity,
             CASE WHEN list_contains(answer_choices, pc[2]) THEN pc[2] ELSE '{FALLBACK}' END AS attr,
             CAST(l.li AS INTEGER) AS line_no
      FROM p WHERE len(pc) = 2)
{_with_empty("r.entity, r.attr, r.line_no")}"""


def _report_src() -> str:
    n = len(_B.REPORT_KEYS)
    keys = "[" + ", ".join(sql_lit(k) for k in _B.REPORT_KEYS) + "]"
    return f"""
SELECT 'write the report' AS input,
       'Report ' || CAST(doc_id AS VARCHAR) || {NL} ||
       array_to_string(list_transform(string_split(text, {NL}), lambda x, i: {keys}[(i - 1) % {n} + 1] || x), {NL})
       || {NL} || {sql_lit(_B.REPORT_KEYS[0])} || string_split(text, {NL})[-1] AS target,
       CAST(NULL AS VARCHAR[]) AS answer_choices, 'report' AS task_type, 'report' AS task_dataset,
       concat_ws('-', 'report', CAST(doc_id AS VARCHAR)) AS sample_id
FROM documents"""


def parse_report() -> str:
    keys = "[" + ", ".join(sql_lit(k) for k in _B.REPORT_KEYS) + "]"
    return f"""
WITH {_folded(_report_src())},
l AS (SELECT rn, {_lines_of(f"string_split({_strip('g')}, {NL})[2:]")} AS l FROM pf),
k AS (SELECT rn, l.line AS line, l.li AS li, unnest({keys}) AS key FROM l),
m AS (SELECT rn, li, substr(key, 1, length(key) - 1) AS section,
             {_strip(f"string_split({_strip('line')}, key)[-1]")} AS text
      FROM k WHERE starts_with(line, key)),
r AS (SELECT rn, section, arg_max(text, li) AS text FROM m GROUP BY rn, section)
{_with_empty("r.section, r.text")}"""


def submission_counts() -> str:
    """Predictions and answers per task, from the long tables above (a null first answer column: none)."""
    from .catalog import ROUTES
    tasks = ", ".join(f"({sql_lit(t)})" for t in ROUTES)
    firsts = {"type": parse_entities(), "predicate": parse_triples(), "term_no": parse_terms(), "event_no": parse_events(),
              "label": parse_labels(), "line_no": parse_findings(), "section": parse_report()}
    longs = " UNION ALL ".join(f"SELECT task_dataset, count({c}) AS a FROM ({q}) GROUP BY 1" for c, q in firsts.items())
    srcs = (_entity_src(), build_relations(raw=True), build_normalization(raw=True), build_events(raw=True), _label_src(),
            _findings_src(), _report_src())
    samples = " UNION ALL ".join(f"SELECT task_dataset FROM ({q})" for q in srcs)
    return f"""
WITH dim(task_dataset) AS (VALUES {tasks}),
s AS (SELECT task_dataset, count(*) AS n FROM ({samples}) GROUP BY 1),
a AS ({longs})
SELECT dim.task_dataset, CAST(coalesce(s.n, 0) AS BIGINT) AS n_samples, CAST(coalesce(a.a, 0) AS BIGINT) AS n_answers
FROM dim LEFT JOIN s USING (task_dataset) LEFT JOIN a USING (task_dataset)"""


def submission_written() -> str:
    return submission_counts()


def submission_document() -> str:
    return submission_counts()


def submission_files() -> str:
    return f"SELECT * FROM ({submission_counts()}) WHERE n_samples > 0"


def extract_response() -> str:
    marker = sql_lit(_P.RESPONSE_MARKER)
    raw = f"{sql_lit(_TK.PROMPT_HEAD)} || prompt || {sql_lit(_TK.PROMPT_MID)} || reply"
    return f"""
WITH {dialogue_pairs_sql()},
r AS (SELECT concat_ws('-', 'dialogue', CAST(conv_id AS VARCHAR), CAST(i AS VARCHAR)) AS sample_id, {raw} AS raw FROM pairs)
SELECT sample_id, {_strip(f"string_split(raw, {marker})[-1]")} AS target FROM r"""


# ---------------------------------------------------------------- wraps, tokens, packing

from ..operators import tokens as _TK  # noqa: E402

RE = sql_lit(_TK.TOKEN_RE)
EOSL = sql_lit(_TK.EOS)


def _pairs_sql() -> str:
    return f"""{dialogue_pairs_sql()},
pp AS (SELECT *, concat_ws('-', 'dialogue', CAST(conv_id AS VARCHAR), CAST(i AS VARCHAR)) AS sample_id FROM pairs)"""


def _ensure(x: str) -> str:
    return f"(CASE WHEN ends_with({x}, {EOSL}) THEN {x} ELSE {x} || {EOSL} END)"


def _wrap_train(i: str, t: str) -> str:
    return f"({sql_lit(_TK.PROMPT_HEAD)} || {i} || {sql_lit(_TK.PROMPT_MID)} || {t} || {EOSL})"


def wrap_train() -> str:
    return f"WITH {_pairs_sql()} SELECT sample_id, {_ensure('reply')} AS output, {_wrap_train('prompt', 'reply')} AS text FROM pp"


def wrap_prompt() -> str:
    return (f"WITH {_pairs_sql()} SELECT sample_id, {sql_lit(_TK.PROMPT_HEAD)} || prompt || "
            f"{sql_lit(_TK.PROMPT_MID)} AS newinput FROM pp")


def ensure_eos() -> str:
    return f"WITH {_pairs_sql()} SELECT sample_id, {_ensure('reply')} AS output, {_ensure(_ensure('reply'))} AS output_twice FROM pp"


def _preference_sql() -> str:
    return f"""
q AS (SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user'),
d AS (SELECT conv_id AS d_conv, turn AS d_turn, text AS doc,
             row_number() OVER (ORDER BY conv_id, turn) - 1 AS d_idx, count(*) OVER () AS n_docs
      FROM conversations WHERE role = 'assistant'),
pos AS (SELECT q.conv_id, q.turn, q.query, d.doc AS chosen, d.d_idx, d.n_docs
        FROM q JOIN d ON d.d_conv = q.conv_id AND d.d_turn = q.turn + 1),
rr AS (SELECT *, CAST(floor({sql_u(SEED, 'preference', ['conv_id', 'turn'], 'rejected')} * (n_docs - 1)) AS BIGINT) AS ri FROM pos),
pref AS (SELECT concat_ws('-', 'pref', CAST(rr.conv_id AS VARCHAR), CAST(rr.turn AS VARCHAR)) AS sample_id,
                rr.query AS prompt, rr.chosen, d.doc AS rejected
         FROM rr JOIN d ON d.d_idx = CASE WHEN rr.ri >= rr.d_idx THEN rr.ri + 1 ELSE rr.ri END),
pt AS (SELECT sample_id, prompt || chosen || {EOSL} AS text_pos, prompt || rejected || {EOSL} AS text_neg FROM pref)"""


def preference_pairs() -> str:
    return f"WITH {_preference_sql()} SELECT sample_id, text_pos, text_neg FROM pt"


def _vocab_sql(name: str, source: str) -> str:
    specials = ", ".join(f"({sql_lit(t)}, {i}, 0)" for i, t in enumerate(_TK.SPECIALS))
    sp = ", ".join(sql_lit(t) for t in _TK.SPECIALS)
    return f"""
{name}_cnt AS (SELECT token, count(*) AS count FROM (SELECT unnest(regexp_extract_all(text, {RE})) AS token FROM {source})
               WHERE token NOT IN ({sp}) GROUP BY token),
{name} AS (SELECT token, CAST(row_number() OVER (ORDER BY count DESC, token) - 1 + {len(_TK.SPECIALS)} AS INTEGER) AS id,
                  CAST(count AS BIGINT) AS count
           FROM {name}_cnt
           UNION ALL SELECT * FROM (VALUES {specials}) AS s(token, id, count)),
{name}_map AS (SELECT map(list(token), list(id)) AS m FROM {name})"""


def build_vocab() -> str:
    return f"WITH {_vocab_sql('v', 'documents')} SELECT token, id, count FROM v"


def _ids(text: str, vmap: str, bos: bool) -> str:
    ids = (f"list_transform(regexp_extract_all({text}, {RE}), "
           f"lambda t: coalesce(map_extract_value({vmap}.m, t), {_TK.UNK_ID}))")
    return f"([{_TK.BOS_ID}] || {ids})" if bos else ids


def _join_ids(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def encode_labels() -> str:
    from .catalog import MAX_LEN
    return f"""
WITH {_pairs_sql()}, {_vocab_sql('v', 'conversations')},
e AS (SELECT sample_id, {_ids('prompt', 'v_map', True)} AS p, {_ids(_ensure('reply'), 'v_map', False)} AS r FROM pp, v_map),
l AS (SELECT sample_id, list_slice(p || r, 1, {MAX_LEN}) AS ids,
             list_slice(list_transform(p, lambda x: -100) || r, 1, {MAX_LEN}) AS labels,
             list_slice(list_transform(p || r, lambda x: 1), 1, {MAX_LEN}) AS mask FROM e)
SELECT sample_id, CAST(len(ids) AS INTEGER) AS n_ids, {_join_ids('ids')} AS input_ids, {_join_ids('labels')} AS labels,
       {_join_ids('mask')} AS attention_mask FROM l"""


def encode_all() -> str:
    return f"""
WITH {_pairs_sql()}, {_vocab_sql('v', 'conversations')},
e AS (SELECT sample_id, {_ids(_wrap_train('prompt', 'reply'), 'v_map', True)} AS ids FROM pp, v_map)
SELECT sample_id, CAST(len(ids) AS INTEGER) AS n_ids, {_join_ids('ids')} AS input_ids, {_join_ids('ids')} AS labels,
       {_join_ids('list_transform(ids, lambda x: 1)')} AS attention_mask FROM e"""


def _doc_ids_sql() -> str:
    return f"""{_vocab_sql('v', 'documents')},
di AS (SELECT doc_id, {_ids('text', 'v_map', True)} AS ids FROM documents, v_map)"""


def truncate_filter() -> str:
    return f"""
WITH {_doc_ids_sql()},
c AS (SELECT * FROM di QUALIFY row_number() OVER (ORDER BY doc_id) <= 700)
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_ids, {_join_ids('list_slice(ids, 1, 128)')} AS prompt_ids
FROM c WHERE len(ids) <= 2048"""


def encode_pairs() -> str:
    return f"""
WITH {_preference_sql()}, {_vocab_sql('v', 'conversations')},
e AS (SELECT sample_id, {_ids('text_pos', 'v_map', True)} AS a, {_ids('text_neg', 'v_map', True)} AS b FROM pt, v_map)
SELECT sample_id, {_join_ids('a')} AS input_ids_pos, {_join_ids('list_transform(a, lambda x: 1)')} AS attention_mask_pos,
       {_join_ids('b')} AS input_ids_neg, {_join_ids('list_transform(b, lambda x: 1)')} AS attention_mask_neg FROM e"""


def pack_blocks() -> str:
    b, rows = 128, 100
    return f"""
WITH {_doc_ids_sql()},
r AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // {rows} AS batch FROM di),
o AS (SELECT *, coalesce(sum(len(ids)) OVER (PARTITION BY batch ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
             (sum(len(ids)) OVER (PARTITION BY batch)) // {b} * {b} AS usable
      FROM r),
t AS (SELECT batch, off, usable, unnest(list_transform(ids, lambda x, i: {{'id': x, 'p': off + i - 1}})) AS t FROM o),
k AS (SELECT batch, t.p AS p, t.id AS id FROM t WHERE t.p < usable)
SELECT CAST(batch AS BIGINT) AS batch, CAST(p // {b} AS BIGINT) AS block, CAST(count(*) AS INTEGER) AS n_ids,
       array_to_string(list(id ORDER BY p), ' ') AS input_ids, array_to_string(list(id ORDER BY p), ' ') AS labels,
       CAST(count(*) AS INTEGER) AS mask_sum
FROM k GROUP BY batch, p // {b}"""


def map_tokenizer() -> str:
    return f"SELECT doc_id, CAST(len(regexp_extract_all(text, {RE})) AS BIGINT) AS n_tokens FROM documents"


# ---------------------------------------------------------------- metrics

def shifted_accuracy() -> str:
    return f"""
WITH {_doc_ids_sql()},
p AS (SELECT ids, list_transform(ids[2:] || [{_TK.EOS_ID}], lambda x, i: CASE WHEN (x * 7 + i - 1) % 10 < 7 THEN x ELSE {_TK.UNK_ID} END) AS preds
      FROM di),
c AS (SELECT greatest(len(ids) - 1, 0) AS n,
             len(list_filter(range(1, greatest(len(ids) - 1, 0) + 1), lambda k: preds[k] = ids[k + 1])) AS ok FROM p)
SELECT CAST(sum(n) AS BIGINT) AS n_compared, CAST(sum(ok) AS BIGINT) AS n_correct,
       round(sum(ok) / sum(n), 6) AS accuracy FROM c"""


def perplexity() -> str:
    return """
SELECT event_type, round(avg(value), 9) AS mean_loss, exp(round(avg(value), 9)) AS perplexity
FROM events GROUP BY event_type"""


def capped_counts() -> str:
    return """
WITH s AS (SELECT CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < floor(count(*) OVER () * 5 / 100 + 0.5)
                       THEN 'validation' ELSE 'train' END AS split FROM documents)
SELECT split, count(*) AS n_rows, least(500, count(*)) AS samples FROM s GROUP BY split"""


# ---------------------------------------------------------------- files and streaming

def jsonl_roundtrip() -> str:
    return f"SELECT * FROM ({build_events()}) UNION ALL SELECT * FROM ({build_classification()})"


def tsv_pairs() -> str:
    t = "regexp_replace(text, '[\\t\\r\\n]', ' ', 'g')"
    return f"""
SELECT q.conv_id * 1000 + q.turn AS query_id, d.conv_id * 1000 + d.turn AS doc_id,
       {t.replace('text', 'q.text')} AS query, {t.replace('text', 'd.text')} AS doc
FROM conversations q JOIN conversations d ON d.conv_id = q.conv_id AND d.turn = q.turn + 1
WHERE q.role = 'user' AND d.role = 'assistant'"""


def tsv_last_links() -> str:
    return """
WITH l AS (SELECT conv_id, turn, turn + 1 + 2 * j AS d_turn,
                  row_number() OVER (ORDER BY md5(concat_ws('|', conv_id, turn, j))) - 1 AS position
           FROM conversations, (VALUES (0), (1), (2)) AS x(j) WHERE role = 'user')
SELECT conv_id, turn, arg_max(d_turn, position) AS d_turn, max(position) AS position FROM l GROUP BY conv_id, turn"""


def aligned_predictions() -> str:
    return f"""
WITH {dialogue_pairs_sql()},
b AS (SELECT concat_ws('-', 'base', CAST(conv_id AS VARCHAR), CAST(i AS VARCHAR)) AS sample_id, prompt FROM pairs)
SELECT row_number() OVER (ORDER BY sample_id) - 1 AS position, sample_id,
       'answer to ' || length(prompt) || ' of ' || sample_id AS target FROM b"""


def ext_sources() -> str:
    split = ("CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < floor(count(*) OVER () * 5 / 100 + 0.5) "
             "THEN 'validation' ELSE 'train' END")
    return f"""
WITH s AS (SELECT {split} AS split, doc_id, lang, source FROM documents)
SELECT 'csv' AS fmt, split, CAST(doc_id AS VARCHAR) AS key, lang || ' ' || source AS value FROM s
UNION ALL SELECT 'json', split, CAST(doc_id AS VARCHAR), lang || ' ' || source FROM s
UNION ALL SELECT 'txt', 'train', CAST(count(*) AS VARCHAR), sha256(line || {NL}) FROM (
    SELECT unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), {NL})) AS line FROM documents) GROUP BY line"""


def split_by_task() -> str:
    return f"""
SELECT task_dataset, count(*) AS n_rows FROM (
  SELECT task_dataset FROM ({build_ordinal_match()}) UNION ALL SELECT task_dataset FROM ({build_classification()}))
GROUP BY task_dataset"""


def write_predictions() -> str:
    head, sel = dialogue_history().rsplit("SELECT ", 1)
    sel = sel.replace("reply AS target", f"{_strip('reply')} AS target")
    return f"{head}SELECT {sel}"


def merge_shards() -> str:
    return """
WITH x AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS idx, ceil(count(*) OVER () / 8) AS per
           FROM documents)
SELECT doc_id, lang, CAST(floor(idx / per) AS INTEGER) AS shard, CAST(idx - floor(idx / per) * per AS BIGINT) AS shard_row
FROM x"""


def file_manifest() -> str:
    return f"""
WITH f AS (SELECT concat_ws('-', CAST(c_nationkey AS VARCHAR), CAST(c_custkey // 1000 AS VARCHAR)) AS part,
                  string_agg(lpad(CAST(c_custkey AS VARCHAR), 12, '0') || '|' || c_name, {NL} ORDER BY c_custkey, c_name) || {NL} AS t
           FROM customer GROUP BY 1)
SELECT part, CAST(strlen(t) AS BIGINT) AS length, sha256(t) AS sha256 FROM f"""


def stream_prepare() -> str:
    return encode_labels()


def stream_pack() -> str:
    b = 128
    return f"""
WITH {_doc_ids_sql()},
o AS (SELECT *, doc_id % 3 AS part,
             coalesce(sum(len(ids)) OVER (PARTITION BY doc_id % 3 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
             (sum(len(ids)) OVER (PARTITION BY doc_id % 3)) // {b} * {b} AS usable FROM di),
t AS (SELECT part, off, usable, unnest(list_transform(ids, lambda x, i: {{'id': x, 'p': off + i - 1}})) AS t FROM o),
k AS (SELECT part, t.p AS p, t.id AS id FROM t WHERE t.p < usable)
SELECT CAST(part AS INTEGER) AS part, CAST(p // {b} AS BIGINT) AS block, CAST(count(*) AS INTEGER) AS n_ids,
       array_to_string(list(id ORDER BY p), ' ') AS input_ids,
       (SELECT count(DISTINCT doc_id % 3) FROM documents) AS n_batches
FROM k GROUP BY part, p // {b}"""


def unmapped_codes() -> str:
    return """
SELECT event_type AS code, count(*) AS n_rows FROM events
WHERE event_type IS NULL OR event_type NOT IN ('click', 'purchase', 'error') GROUP BY event_type"""


def tag_length_check() -> str:
    return f"""
WITH {decode_tags_sql()},
t AS (SELECT user_id, CAST(day AS VARCHAR) AS day, sentence,
             CAST(n_tags - CASE WHEN {sql_u(SEED, 'tag_length', ['user_id', 'day'], 'lost')} < 0.2 THEN 1 ELSE 0 END AS INTEGER) AS n_tags
      FROM dec)
SELECT user_id, day, sentence, n_tags FROM t WHERE length(sentence) <> n_tags"""


def template_violations() -> str:
    from ..operators.templates import pattern_of
    arms = []
    for spec, sql in ((RELATIONS, build_relations()), (ENTITIES, build_entities()), (ORDINAL, build_ordinal_match()),
                      (CLASSIFICATION, build_classification()), (DIALOGUE, dialogue_history())):
        hits = " + ".join(f"CAST(regexp_matches(input, {sql_lit(pattern_of(t))}) AS INTEGER)" for t in spec.templates)
        arms.append(f"""
SELECT task_dataset, sample_id, n_matched FROM (
  SELECT task_dataset, sample_id, {hits} AS n_matched FROM (
    SELECT task_dataset, sample_id, CASE WHEN {sql_u(SEED, 'violations', ['sample_id'], 'cut')} < 0.1 THEN substr(input, 25)
                                         ELSE input END AS input FROM ({sql}))) WHERE n_matched <> 1""")
    return " UNION ALL ".join(arms)


def packed_lists() -> str:
    names = lambda cond: f"list(p_name ORDER BY p_partkey) FILTER (WHERE {cond})"
    return f"""
WITH g AS (SELECT p_brand, coalesce({names('p_size <= 25')}, ['']) AS a0, coalesce({names('p_size > 25')}, ['']) AS b0
           FROM part GROUP BY p_brand),
d AS (SELECT p_brand, {first_seen('a0')} AS a, b0 AS b FROM g)
SELECT p_brand, array_to_string(a, '##') AS names, CAST(len(a) AS INTEGER) AS n_names,
       array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), '##') AS only_small FROM d"""


def shape_columns() -> str:
    return f"""
SELECT 'instruction' AS kind, sample_id, prompt AS input, {_ensure('reply')} AS output, {_wrap_train('prompt', 'reply')} AS text
FROM (WITH {_pairs_sql()} SELECT * FROM pp)
UNION ALL
SELECT 'preference' AS kind, sample_id, prompt AS input, {_ensure('chosen')} AS output, rejected AS text FROM ({{pref}})
UNION ALL
SELECT 'pairs' AS kind, sample_id, prompt AS input, prompt || chosen || {EOSL} AS output, prompt || rejected || {EOSL} AS text
FROM ({{pref}})""".replace("{pref}", f"WITH {_preference_sql()} SELECT * FROM pref")


def text_lines() -> str:
    return f"""
WITH l AS (SELECT unnest(string_split(replace(text, chr(13), ' '), {NL})) AS t FROM documents),
k AS (SELECT true AS kept, t || {NL} AS t FROM l UNION ALL SELECT false, t FROM l)
SELECT kept, sha256(t) AS line_sha, count(*) AS n FROM k GROUP BY 1, 2"""


def bom_rows() -> str:
    return "SELECT doc_id, lang, sha256(text) AS text_sha FROM documents WHERE doc_id % 17 <> 0"


def read_splits() -> str:
    return """
SELECT 'whole' AS source, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < floor(count(*) OVER () * 5 / 100 + 0.5)
                               THEN 'validation' ELSE 'train' END AS split, doc_id, lang FROM documents
UNION ALL
SELECT 'given', CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'train' END, doc_id, lang FROM documents"""


def sample_exact() -> str:
    unit = sql_u(SEED, "exact", ["doc_id"], "sample")
    return f"SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (ORDER BY {unit}, doc_id) <= 100"


def json_shapes() -> str:
    from .catalog import CONVS_PER_DOC
    g = f"CAST(floor(conv_id / {CONVS_PER_DOC}) AS BIGINT)"
    return f"""
WITH c AS (SELECT *, {g} AS g FROM conversations),
n AS (SELECT *, dense_rank() OVER (PARTITION BY g ORDER BY conv_id) - 1 AS conv_no,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_no FROM c)
SELECT 'arrays' AS shape, g, CAST(conv_no AS BIGINT) AS conv, CAST(turn_no AS BIGINT) AS turn, role, text FROM n
UNION ALL SELECT 'rows', g, conv_id, turn, role, text FROM n
UNION ALL SELECT 'keyed', g, conv_id, CAST(turn_no AS BIGINT), role, text FROM n"""
