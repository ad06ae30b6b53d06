"""Collocations: frequent phrases whose parts occur together more often than apart, by Rabin-Karp fingerprints.

Texts are cut into pieces and words and packed into chunks of one language: word codes and the chunk's words.  Within a
chunk, prefix polynomials over the words' hashes give the fingerprint of every n-gram in numpy; each distinct one is
sent once per chunk with its count, packed by bucket.  A bucket adds up the counts and answers each chunk with one bit
per fingerprint it sent: frequent or not.  A fingerprint's place in a chunk's message is its occurrence pointer: the
chunk finds the words again by it.  Words and pairs of words go first; of longer n-grams only those whose pairs are all
frequent are sent at all, as no phrase is more frequent than its parts.

Fingerprints only select.  A chunk then spells the n-grams whose bits are set, told apart by their words, again packed
by bucket, and counts are added up by text, so two phrases that share a fingerprint are separate again; only frequent
phrases become text, and rows of their own only once they are added up.  The scores are joins of that table with itself.

Each chunk sends a fingerprint at most once, so the commonest phrase has a row per chunk, not per occurrence.  The
number of buckets follows the words of the corpus.  Parts that very many phrases share are looked up with
``lookup_join``, and a language's first phrases are selected bucket by bucket first.

Defined cases: null text is empty; a null language counts as ``und``; pieces without words give nothing; a very long
text is cut where a chunk is full, the next chunk repeating the last words as context, so no n-gram is lost or counted
twice; repeated rows count as often as they occur; ties are settled by the phrase; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, powers, row_slices, stored, text_bytes, word_table
from .hotkeys import lookup_join

LONGEST = 5
LEAST = 100
#: Words of one chunk, and words that a task's unfinished chunks may hold in their dictionaries altogether.
CHUNK_WORDS = 1 << 20
CHUNK_TYPES = 400_000
#: Fingerprints that meet in one bucket, on average at most.
BUCKET_VALUES = 500_000
UNDEFINED = "und"
_BASE = 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Of a fingerprint, the bucket's bits and these many bytes below them travel.
SENT_BYTES = 6
_TABLE = bytearray(range(256))
_TABLE[ord("A"):ord("Z") + 1] = range(ord("a"), ord("z") + 1)
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 0xFF  # no byte of UTF-8
_TABLE = bytes(_TABLE)
BREAK = b"\xff"
CHUNK = "chunk long, lang string, context int, n_words long, codes binary, words string"


# ------------------------------------------------------------------ chunks

class Codes(dict):
    def __missing__(self, word):
        self[word] = code = len(self)
        return code


class OpenChunk:
    """Words of one language that wait for a full chunk; code 0 is the end of a piece."""

    def __init__(self, context: list[bytes] = ()):
        self.types = Codes({BREAK: 0})
        self.parts = [self.coded(list(context))]
        self.context = self.held = len(context)

    def coded(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.types.__getitem__, words), np.int32, len(words))

    def add(self, words: list[bytes]) -> None:
        self.parts.append(self.coded(words))
        self.held += len(words)


def normal_slices(texts: list[str], limit: int) -> Iterator[bytes]:
    """The texts, lowered, with every end of a piece or text as ``BREAK``, in slices cut between words."""
    for a, b in row_slices(text_bytes(texts), limit):
        data = BREAK.join(t.encode("utf-8", "surrogatepass").translate(_TABLE) for t in texts[a:b]) + BREAK
        at = 0
        while at < len(data):
            end = at + 2 * limit
            if end < len(data):
                found = [p for p in (data.find(s, end) for s in (b" ", b"\t", BREAK)) if p >= 0]
                end = min(found) + 1
            yield data[at:end]
            at = end


def text_chunks(docs: DataFrame, chunk_words: int = CHUNK_WORDS, longest: int = LONGEST) -> DataFrame:
    """CHUNK rows of (lang, text)."""

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        number = 0
        open_chunks: dict[str, OpenChunk] = {}

        def closed(lang: str) -> pd.DataFrame:
            nonlocal number
            one = open_chunks.pop(lang)
            codes = np.concatenate(one.parts)
            words = list(one.types)
            tail = [words[c] for c in codes[-(longest - 1):].tolist()] if longest > 1 else []
            open_chunks[lang] = OpenChunk(tail)
            number += 1
            return pd.DataFrame({
                "chunk": [base + number], "lang": [lang], "context": [one.context],
                "n_words": [int(np.count_nonzero(codes[one.context:]))], "codes": [codes.tobytes()],
                "words": [b" ".join(words[1:]).decode("utf-8", "surrogatepass")]})

        for pdf in batches:
            for lang, group in pdf.groupby("lang", sort=False):
                for data in normal_slices(group["text"].tolist(), 1_000_000):
                    one = open_chunks.setdefault(lang, OpenChunk())
                    one.add(data.replace(BREAK, b" \xff ").split())
                    if one.held >= chunk_words:
                        yield closed(lang)
                    while sum(len(c.types) for c in open_chunks.values()) > CHUNK_TYPES:
                        largest = max(open_chunks, key=lambda x: len(open_chunks[x].types))
                        if open_chunks[largest].held == open_chunks[largest].context:
                            break
                        yield closed(largest)
        for lang in list(open_chunks):
            if open_chunks[lang].held > open_chunks[lang].context:
                yield closed(lang)

    plain = docs.select(F.coalesce("lang", F.lit(UNDEFINED)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInPandas(run, CHUNK)


# ------------------------------------------------------------------ fingerprints

class Chunk:
    """A chunk's words (without breaks) and the fingerprints of its n-grams."""

    def __init__(self, lang: str, context: int, codes: bytes, words: str):
        coded = np.frombuffer(codes, dtype=np.int32)
        word = coded != 0
        self.words = words.split(" ") if words else []
        self.code = coded[word].astype(np.int64) - 1
        self.piece = np.cumsum(~word, dtype=np.int32)[word]
        self.own = int(np.count_nonzero(word[:context]))  # n-grams that end before were counted by the chunk before
        hashes = word_table([words])[0]
        n = len(self.code)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes[self.code] * powers(_BASE, n + 1)[:n], dtype=np.uint64, out=self.prefix[1:])
        self.salt = mix64(word_table([lang + " "])[0][:1] + np.uint64(len(lang)))[0] if lang.strip() else np.uint64(7)

    def starts(self, n: int) -> np.ndarray:
        """Where the n-grams of this chunk begin."""
        if len(self.code) < n:
            return np.zeros(0, dtype=np.int64)
        last = np.arange(n - 1, len(self.code))
        return last[(last >= self.own) & (self.piece[last] == self.piece[last - n + 1])] - n + 1

    def fingerprints(self, start: np.ndarray, n: int) -> np.ndarray:
        poly = (self.prefix[start + n] - self.prefix[start]) * powers(_INVERSE, len(self.code) + 1)[start]
        with np.errstate(over="ignore"):
            return mix64(poly + self.salt * np.uint64(2 * n + 1))


def distinct(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct fingerprints ascending, number of each, place of each fingerprint among them)."""
    value, place, count = np.unique(prints, return_inverse=True, return_counts=True)
    return value, count, place


def bucket_of(value: np.ndarray, bits: int) -> np.ndarray:
    return (value >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(value), dtype=np.int64)


def message(chunk: int, value: np.ndarray, count: np.ndarray, bits: int, width: int = SENT_BYTES) -> pd.DataFrame:
    """(bucket, chunk, prints, counts, more): distinct fingerprints, packed by bucket."""
    bucket = bucket_of(value, bits)
    ends = np.cumsum(np.bincount(bucket, minlength=1)) if len(bucket) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    packed = np.ascontiguousarray(value << np.uint64(bits)).view(np.uint8).reshape(-1, 8)[:, 8 - width:]
    small = np.minimum(count, 255).astype(np.uint8)
    some = np.flatnonzero(ends > starts).tolist()
    parts = [slice(starts[k], ends[k]) for k in some]
    return pd.DataFrame({
        "bucket": np.array(some, dtype=np.int64), "chunk": np.full(len(some), chunk, dtype=np.int64),
        "prints": [packed[p].tobytes() for p in parts], "counts": [small[p].tobytes() for p in parts],
        "more": [count[p][small[p] == 255].astype(np.int64).tobytes() for p in parts]})


def answered(messages: DataFrame, least: int, width: int = SENT_BYTES) -> DataFrame:
    """(chunk, bucket, bits): for each fingerprint of a message, whether all chunks together have ``least`` of it."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = np.frombuffer(b"".join(pdf["prints"]), dtype=np.uint8).reshape(-1, width)
        wide = np.zeros((len(raw), 8), dtype=np.uint8)
        wide[:, :width] = raw
        count = np.frombuffer(b"".join(pdf["counts"]), dtype=np.uint8).astype(np.int64)
        count[count == 255] = np.frombuffer(b"".join(pdf["more"]), dtype=np.int64)
        value, place = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
        total = np.zeros(len(value), dtype=np.int64)
        np.add.at(total, place, count)
        frequent = (total >= least)[place]
        ends = np.cumsum([len(p) // width for p in pdf["prints"]])
        rows = []
        for chunk, bucket, a, b in zip(pdf["chunk"], pdf["bucket"], np.concatenate([[0], ends[:-1]]), ends):
            if frequent[a:b].any():
                rows.append((chunk, bucket, np.packbits(frequent[a:b]).tobytes()))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "bits"])

    return messages.groupBy("bucket").applyInPandas(answer, "chunk long, bucket long, bits binary")


def flags(value: np.ndarray, answers, bits: int) -> np.ndarray:
    """The answers to a chunk's messages, in the order of ``value``."""
    out = np.zeros(len(value), dtype=bool)
    if answers is None:
        return out
    bucket = bucket_of(value, bits)
    for a in answers:
        begin, end = np.searchsorted(bucket, [a["bucket"], a["bucket"] + 1])
        out[begin:end] = np.unpackbits(np.frombuffer(a["bits"], dtype=np.uint8), count=end - begin)
    return out


def first_prints(c: Chunk) -> tuple[list[np.ndarray], tuple]:
    """Starts of words and pairs, and their distinct fingerprints."""
    starts = [c.starts(n) for n in (1, 2)]
    return starts, distinct(np.concatenate([c.fingerprints(s, n) for n, s in zip((1, 2), starts)]))


def marked(c: Chunk, starts: list[np.ndarray], hit: np.ndarray) -> list[np.ndarray]:
    """For each length the places where a frequent n-gram begins, as flags over the chunk's words."""
    out, at = [], 0
    for s in starts:
        flag = np.zeros(len(c.code) + 1, dtype=bool)
        flag[s] = hit[at:at + len(s)]
        at += len(s)
        out.append(flag)
    return out


def longer_prints(c: Chunk, words_pairs: list[np.ndarray], longest: int) -> tuple[list[np.ndarray], tuple]:
    """Starts of the n-grams of 3 words and more whose pairs are all frequent, and their distinct fingerprints.  A pair
    in the context counts if its words do: whether it is frequent was answered to another chunk."""
    word, pair = words_pairs
    may = pair.copy()
    may[:max(0, c.own - 1)] = True
    starts, chain = [], may[:len(c.code)]
    for n in range(3, longest + 1):
        shifted = np.zeros(len(chain), dtype=bool)
        shifted[:max(0, len(chain) - n + 2)] = may[n - 2:len(chain)]
        chain = chain & shifted
        s = c.starts(n)
        starts.append(s[chain[s]])
    return starts, distinct(np.concatenate([c.fingerprints(s, n) for n, s in zip(range(3, longest + 1), starts)])
                            if starts else np.zeros(0, np.uint64))


def spelled(c: Chunk, flagged: list[np.ndarray]) -> list[tuple[int, str, int]]:
    """(n, phrase, count) of the chunk's n-grams at flagged places, told apart by their words."""
    rows = []
    for n, flag in enumerate(flagged, start=1):
        start = np.flatnonzero(flag)
        if not len(start):
            continue
        ident = c.code[start]
        for k in range(1, n):
            ident = np.unique(ident, return_inverse=True)[1] * np.int64(len(c.words)) + c.code[start + k]
        _, first, count = np.unique(ident, return_index=True, return_counts=True)
        for at, m in zip(start[first].tolist(), count.tolist()):
            rows.append((n, " ".join([c.words[x] for x in c.code[at:at + n].tolist()]), m))
    return rows


def spelled_message(rows: list[tuple[int, str, int]], lang: str, bits: int) -> pd.DataFrame:
    """(bucket, lang, phrases, counts) of a chunk's phrases, by a hash of their text; a phrase has no line end."""
    texts = [r[1] for r in rows]
    value = (pd.util.hash_array(np.array(texts, dtype=object), categorize=False) if texts else np.zeros(0, np.uint64))
    bucket = bucket_of(value.astype(np.uint64), bits)
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    parts = [order[a:b].tolist() for a, b in zip(first, [*first[1:], len(order)])]
    return pd.DataFrame({
        "bucket": bucket[order[first]], "lang": [lang] * len(parts),
        "phrases": ["\n".join([texts[i] for i in p]) for p in parts],
        "counts": [np.array([rows[i][2] for i in p], dtype=np.int64).tobytes() for p in parts]})


def added_up(messages: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, a): phrases that all chunks of a language together have ``least`` times."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        sums: dict[tuple[str, str], int] = {}
        for lang, phrases, counts in zip(pdf["lang"], pdf["phrases"], pdf["counts"]):
            for phrase, n in zip(phrases.split("\n"), np.frombuffer(counts, dtype=np.int64).tolist()):
                key = (lang, phrase)
                sums[key] = sums.get(key, 0) + n
        rows = [(lang, p, p.count(" ") + 1, n) for (lang, p), n in sums.items() if n >= least]
        return pd.DataFrame(rows, columns=["lang", "phrase", "words", "a"])

    return messages.groupBy("bucket").applyInPandas(total, "lang string, phrase string, words int, a long")


def bucket_bits(values: int, per_bucket: int = BUCKET_VALUES) -> int:
    return max(0, -(-values // per_bucket) - 1).bit_length()


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, chunk_words: int = CHUNK_WORDS,
                     bucket_values: int = BUCKET_VALUES, sent_bytes: int = SENT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): (lang, phrase, words, a) of all phrases of up to ``longest`` words that occur ``least`` times
    in a language, and (lang, n), the words of each language."""
    chunks = stored(text_chunks(docs, chunk_words, longest), "word-chunks")
    size = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    bits = bucket_bits(2 * size, bucket_values)
    sent = "bucket long, chunk long, prints binary, counts binary, more binary"

    def rows_of(pdf):
        for r in pdf.itertuples(index=False):
            yield r, Chunk(r.lang, r.context, r.codes, r.words)

    def first(batches):
        for pdf in batches:
            for r, c in rows_of(pdf):
                value, count, _ = first_prints(c)[1]
                yield message(r.chunk, value, count, bits, sent_bytes)

    def second(batches):
        for pdf in batches:
            for r, c in rows_of(pdf):
                starts, (value, _, place) = first_prints(c)
                known = marked(c, starts, flags(value, r.first, bits)[place])
                value, count, _ = longer_prints(c, known, longest)[1]
                yield message(r.chunk, value, count, bits, sent_bytes)

    def spell(batches):
        for pdf in batches:
            for r, c in rows_of(pdf):
                starts, (value, _, place) = first_prints(c)
                known = marked(c, starts, flags(value, r.first, bits)[place])
                starts, (value, _, place) = longer_prints(c, known, longest)
                known += marked(c, starts, flags(value, r.second, bits)[place])
                yield spelled_message(spelled(c, known), r.lang, bits)

    def by_chunk(answers, name):
        return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))

    one = stored(by_chunk(answered(chunks.mapInPandas(first, sent), least, sent_bytes), "first"), "frequent-pairs")
    informed = chunks.join(one, "chunk", "left")
    two = stored(by_chunk(answered(informed.mapInPandas(second, sent), least, sent_bytes), "second"), "frequent-ngrams")
    phrases = added_up(chunks.join(one, "chunk").join(two, "chunk", "left").mapInPandas(
        spell, "bucket long, lang string, phrases string, counts binary"), least)
    totals = chunks.groupBy("lang").agg(F.sum("n_words").alias("n")).where("n > 0")
    return stored(phrases, "frequent-phrases"), stored(totals, "language-words")


# ------------------------------------------------------------------ scores

def cut_at(k: Column) -> Column:
    """The first k words of a phrase, the last -k if k is negative."""
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), k)


def collocation_scores(phrases: DataFrame, totals: DataFrame, scale: int = 1000) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score): each phrase of two words or more with its lowest-scoring cut.  Products
    are 38-digit decimals; the division is a whole-number one."""
    cuts = stored(phrases.where("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "words", "a", "k", cut_at(F.col("k")).alias("left"),
        cut_at(F.col("k") - F.col("words")).alias("right")), "cuts")
    part = lambda side, name: phrases.select("lang", F.col("phrase").alias(side), F.col("a").alias(name))
    cuts = stored(lookup_join(cuts, part("left", "l"), ["lang", "left"]).drop("left"), "cuts-left")
    cuts = stored(lookup_join(cuts, part("right", "r"), ["lang", "right"]).drop("right"), "cuts-both")
    cuts = lookup_join(cuts, totals, ["lang"])
    score = F.expr(f"(cast({scale} AS decimal(38,0)) * cast(a AS decimal(19,0)) * cast(n AS decimal(19,0))) "
                   "div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))")
    cut = F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r", "a", "n", "words"))
    out = cuts.groupBy("lang", "phrase").agg(cut.alias("c"))
    return out.select("lang", "phrase", "c.words", "c.a", "c.l", "c.r", "c.n", "c.score")


def uncontained(scored: DataFrame, percent: int = 100) -> DataFrame:
    """Without the phrases that lie in a longer one at least ``percent`` per cent as frequent.  If any longer phrase is,
    so is the one with one word more around the phrase, hence those are enough."""
    longer = scored.where("words > 2")
    inner = [cut_at(k * (F.col("words") - 1)).alias("phrase") for k in (F.lit(1), F.lit(-1))]
    held = longer.select("lang", inner[0], "a").unionByName(longer.select("lang", inner[1], "a")).groupBy(
        "lang", "phrase").agg(F.max("a").alias("a_longer"))
    return scored.join(held, ["lang", "phrase"], "left").where(
        F.coalesce(F.col("a_longer") * 100 < F.col("a") * percent, F.lit(True))).drop("a_longer")


def first_rows(scored: DataFrame, top: int, per_bucket: int = 50_000) -> DataFrame:
    """The first ``top`` rows of each language with their rank; buckets of a language are cut down first."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    bits = bucket_bits(scored.count(), max(per_bucket, 2 * top))
    while bits > 0:
        part = F.pmod(F.xxhash64("phrase"), F.lit(1 << bits))
        scored = scored.withColumn("part", part).withColumn("place", F.row_number().over(
            Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top).drop("part", "place")
        bits -= min(bits, 4)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = 2000, percent: int = 100,
                 chunk_words: int = CHUNK_WORDS, bucket_values: int = BUCKET_VALUES,
                 sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text): each language's first ``top`` collocations."""
    phrases, totals = frequent_phrases(docs, least, longest, chunk_words, bucket_values, sent_bytes)
    scored = stored(uncontained(collocation_scores(phrases, totals), percent), "collocations")
    return first_rows(scored, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
