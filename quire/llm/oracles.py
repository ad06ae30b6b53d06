"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

#: Kinds of secrets for the SQL, apart from those of the code: (name, pattern, group of the value, least length), and from
#: how many owners on a value is a copied example.  Names of keys have letters in either case.
_KEYS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in key) for key in (
    "password", "passwd", "secret", "token", "api_?key"))
KINDS = (
    ("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("live", r"[A-Za-z0-9+/_]{24,}", 0, 24),
)
COPIED_OWNERS = 3

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op4_secret_ownership() -> str:
    found = []
    for order, (_, pattern, group, least) in enumerate(KINDS):
        p = quoted(pattern)
        found.append(f"""
SELECT doc_id, source, {order} AS ord, start, start + length(m[i]) AS stop, v[i] AS value
FROM (SELECT doc_id, source, m, v, i, CAST(list_sum(list_transform(p[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start
      FROM (SELECT doc_id, source, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS v,
                   string_split_regex(t, {p}) AS p FROM d), unnest(range(1, len(m) + 1)) AS u(i))
WHERE length(v[i]) >= {least}""")
    n = len(KINDS) - 1
    kind = "CASE ord " + " ".join(f"WHEN {i} THEN '{k[0]}'" for i, k in enumerate(KINDS)) + " END"
    text = f"string_agg({kind} || ':' || start || ':' || stop, ',' ORDER BY start, ord)"
    counts = ", ".join(f"count(*) FILTER (WHERE ord = {i}) AS n_{k[0]}" for i, k in enumerate(KINDS[:-1]))
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(found)}),
b AS (SELECT * FROM f WHERE ord < {n}),
a AS (SELECT * FROM b UNION ALL
      SELECT f.* FROM f WHERE ord = {n} AND regexp_matches(value, '[0-9].*[0-9].*[0-9]') AND regexp_matches(value, '[A-Z]')
      AND regexp_matches(value, '[a-z]')
      AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = f.doc_id AND f.start < b.stop AND b.start < f.stop)),
o AS (SELECT value, count(DISTINCT source) + max(CAST(source IS NULL AS INTEGER)) AS owners FROM a GROUP BY value),
s AS (SELECT a.*, owners < {COPIED_OWNERS} AS live FROM a JOIN o USING (value) WHERE ord < {n} OR owners < {COPIED_OWNERS}),
g AS (SELECT doc_id, {counts}, {text} FILTER (WHERE ord < {n}) AS base, {text} AS spans,
             count(*) FILTER (WHERE live) AS n_owner_specific FROM s GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k[0]}, 0) AS n_{k[0]}" for k in KINDS[:-1])},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owner_specific, 0) AS n_owner_specific
FROM d LEFT JOIN g USING (doc_id)"""


def op7_suffix_automata() -> str:
    return f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM w, unnest(range(1, len(w) - 33)) AS u(i)),
twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i FROM win SEMI JOIN twice USING (k)), unnest(range(35)) AS u(j)),
words AS (SELECT doc_id, p, w[p] AS word FROM w, unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


def op8_parity_join() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(lower)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i)
      WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(doc_id, x) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(x) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""


def op10_columnar_topk() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""


def op11_warc_archive() -> str:
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    part = "CAST('0x' || substr(h, {at}, 5) AS BIGINT)"
    base32 = " || ".join(f"substr('{digits}', CAST(({part.format(at=1 + 5 * i)} >> {shift}) & 31 AS INTEGER) + 1, 1)"
                         for i in range(8) for shift in (15, 10, 5, 0))
    return f"""
WITH d AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS best FROM d
      WINDOW w AS (PARTITION BY t ORDER BY page_id DESC NULLS LAST))
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, {base32} AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN best END AS refers_to
FROM r"""


def op12_fingerprint_phrases() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lower}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, w[i:i + k - 1] AS g FROM w, unnest([1, 2, 3, 4, 5]) AS x(k), unnest(range(1, len(w) - k + 2)) AS u(i)),
f AS (SELECT lang, g, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY lang, g HAVING count(*) >= 100),
c AS (SELECT f.lang, f.g, f.a, k, l.a AS l, r.a AS r, n, 1000 * f.a * n // (l.a * r.a) AS score
      FROM f JOIN t USING (lang), unnest(range(1, len(f.g))) AS x(k)
      JOIN f AS l ON l.lang = f.lang AND l.g = f.g[1:k] JOIN f AS r ON r.lang = f.lang AND r.g = f.g[k + 1:]),
s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (SELECT DISTINCT f.lang, f.g[i:j] AS g, f.a FROM f, unnest(range(1, len(f.g) + 1)) AS x(i),
           unnest(range(i + 1, len(f.g) + 1)) AS y(j) WHERE j - i + 1 < len(f.g)),
kept AS (SELECT * FROM s WHERE NOT EXISTS (
      SELECT 1 FROM inside WHERE inside.lang = s.lang AND inside.g = s.g AND 100 * inside.a >= 100 * s.a)),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase,
      row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000"""
