"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
ASSIGN = re.compile(r"""(?a)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def secrets(text: str | None) -> tuple[int, int, int, str]:
    text = text or ""
    found = []
    for order, (kind, pattern, group, least) in enumerate((
            ("assign", ASSIGN, 2, 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
            ("hex", re.compile(r"[0-9a-f]+"), 0, 24))):
        found += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    kinds = [f[3] for f in found]
    spans = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
    return kinds.count("assign"), kinds.count("access"), kinds.count("hex"), sha(spans)


def shingles(text: str | None) -> frozenset:
    w = WORDS(lower(text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(docs: list[tuple[int, str | None]]) -> list[tuple[int, int, int]]:
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                if x != y:
                    x, y = sorted((x, y), key=lambda k: (docs[k][0], k))
                    parent[y] = x
    smallest: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        smallest[find(i)] = min(smallest.get(find(i), d), d)
    return sorted((d, len(sets[i]), smallest[find(i)]) for i, (d, _) in enumerate(docs))


def without_repeats(docs: list[tuple[int, str | None]], window: int = 35) -> list[tuple[int, int, int, str]]:
    words = [WORDS(t or "") for _, t in docs]
    count: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            count[key] = count.get(key, 0) + 1
    out = []
    for (d, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out)


def edits(docs: list[tuple[int, str | None]]) -> list[tuple[int, int, str]]:
    rows = sorted((d, t or "") for d, t in docs)
    out = []
    for i, (d, t) in enumerate(rows):
        n = len(t) // 4
        after = rows[(i + 1) % len(rows)][1]
        out.append((d, len(t), sha(t[:len(t) - n] + after[:n])))
    return out


def top(vectors: list[tuple[int, list[float]]], k: int = 20) -> list[tuple[int, int, int, int]]:
    import numpy as np

    ids = [i for i, _ in vectors]
    v = np.floor(64 * np.array([x for _, x in vectors], dtype=np.float64)).astype(np.int64)
    out = []
    for q, i in enumerate(ids):
        if i % 20 == 0:
            s = v @ v[q]
            best = sorted((-int(x), j) for x, j in zip(s, ids) if j != i)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(best)]
    return sorted(out)


def targets(sizes: list[tuple[str | None, int]], weights=(5, 2, 1), share=1.5) -> dict[str | None, float]:
    """Round by round: whoever is above twice its size stops there, the excess goes to the others by weight."""
    total: dict[str | None, int] = {}
    for s, n in sizes:
        total[s] = total.get(s, 0) + n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    amount, free, out = share * sum(total.values()), set(order), {}
    while True:
        got = {s: amount * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if got[s] > 2 * total[s]]
        if not over:
            return out | got
        for s in over:
            out[s] = 2.0 * total[s]
            amount -= out[s]
            free.remove(s)


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def page_records(pages: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of (page_id, html) rows; a null id is the least."""
    import base64

    least = lambda d: -(1 << 64) if d is None else d
    best: dict[str, int] = {}
    for i, (d, t) in enumerate(pages):
        t = t or ""
        if t not in best or least(d) > least(pages[best[t]][0]):
            best[t] = i
    out = []
    for i, (d, t) in enumerate(pages):
        raw, first = (t or "").encode(), best[t or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((d, len(raw), digest, "response" if first == i else "revisit", None if first == i else pages[first][0]))
    return sorted(out, key=str)


def collocations(docs: list[tuple[str | None, str | None]], least=100, longest=5, top=2000) -> list[tuple]:
    from collections import Counter

    n: Counter = Counter()
    f: Counter = Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    candidates = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    covered = set()
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= 100 * candidates[lang, p[i:i + k]]:
                    covered.add((lang, p[i:i + k]))
    rows = []
    for (lang, p), a in candidates.items():
        if (lang, p) not in covered:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]],
                                         f[lang, p[k:]]) for k in range(1, len(p)))
            rows.append((lang, -score, -a, " ".join(p).encode(), left, right))
    rank: Counter = Counter()
    out = []
    for lang, score, a, phrase, left, right in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out, key=str)


def token_bytes() -> tuple:
    """Functions that give (id, bytes) of a text's tokens, by the libraries."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(c): c for c in shown}
    letters.update({chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)})

    def of_a(text):
        return [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]

    def of_b(text):
        out = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            out.append((i, bytes.fromhex(p[3:5]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        return out

    return of_a, of_b


def spans_of(tokens: list[tuple[int, bytes]]) -> list[tuple[int, int, int]]:
    at, out = 0, []
    for i, b in tokens:
        out.append((i, at, at + len(b)))
        at += len(b)
    return out


def alignments(docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    """One merge pass over the token ends of each document."""
    from collections import Counter

    of_a, of_b = token_bytes()
    holds: Counter = Counter()
    rows = []
    for d, text in docs:
        a, b = (of_a(text), of_b(text)) if text else ([], [])
        data = (" " + (text or "")).encode()
        if b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
            a = b = []
        a, b = spans_of(a), spans_of(b)
        links, groups, i, j = [], [], 0, 0
        ga, gb = ([a[0][0]], [b[0][0]]) if a else ([], [])
        while i < len(a):
            links.append((a[i][0], b[j][0]))
            ea, eb = a[i][2], b[j][2]
            if ea == eb:
                groups.append((ga, gb))
                ga, gb = [], []
            if ea <= eb:
                i += 1
                ga += [a[i][0]] if i < len(a) else []
            if eb <= ea:
                j += 1
                gb += [b[j][0]] if j < len(b) else []
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        holds.update(set(links))
        rows.append((d, len(a), len(b), len(groups), links, sha(shown) if a else ""))
    best: Counter = Counter()
    for (x, _), c in holds.items():
        best[x] = max(best[x], c)
    return sorted(((d, na, nb, ng, len(links), sum(holds[p] == best[p[0]] for p in links), sum(holds[p] for p in links), s)
                   for d, na, nb, ng, links, s in rows), key=str)
