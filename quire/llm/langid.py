"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is parsed against it into longest matches: the
walk follows transitions while they exist and starts a new phrase where none does.  Few phrases mean that the text is
made of the language's own strings; c phrases over n characters cost about c * log2(size of the labelled text) / n bits
a character, and the language with the smallest such figure wins.

Texts are lower-cased letter strings, everything else is one space.  Long texts are parsed in lanes of ``LANE``
characters (whole texts; a lane starts a new phrase for every language alike), so that numpy walks thousands of lanes
at a time through dense transition tables.

The labelled sample is bounded: ``chars_per_language`` characters, taken from the documents in the order of a hash of
their id and text.  All labelled text is counted; the bound keeps the model, about 60 bytes * letters per character and
language, in a worker's memory.

Defined cases: null text or one without a letter gives ``und`` and score 0; ties go to the language first by name; with
no labelled row at all every text is ``und``; rows and other columns stay as they are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import row_slices, text_bytes

UNKNOWN = "und"
LANE = 256
CHARS_PER_LANGUAGE = 48_000
#: Characters over all languages, shared out where there are many of them.
CHARS_ALTOGETHER = 1_000_000
#: Powers of two of the sample's hash.
LEVELS = 49
MAX_LETTERS = 62
FOLDS = 16
RESULT = "lang string, score double, letters long, bits double"
_LETTER: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Lower-case code point of every letter; 0 for everything else."""
    global _LETTER
    if _LETTER is None:
        table = np.zeros(0x110000, dtype=np.int32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low[0])
        _LETTER = table
    return _LETTER


def letters(text: str) -> np.ndarray:
    """Lower-case letters as code points; every run of other characters, and either end, is one 0."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.zeros(len(codes) + 2, dtype=np.int32)
    out[1:-1] = letter_table()[codes]
    return out[np.concatenate([[True], (out[1:] != 0) | (out[:-1] != 0)])]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of ``codes``; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[new] = twin
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
        last = new
    return step


class Parser:
    """The model: one transition table per language over a common alphabet."""

    def __init__(self, samples: dict[str, str]):
        coded = {lang: letters(t) for lang, t in sorted(samples.items())}
        coded = {lang: c for lang, c in coded.items() if (c != 0).any()}
        count = Counter()
        for c in coded.values():
            count.update(dict(zip(*(x.tolist() for x in np.unique(c[c != 0], return_counts=True)))))
        common = sorted(count, key=lambda c: (-count[c], c))[:MAX_LETTERS]
        # 0: no letter; then the common letters; then classes of all other letters; the last symbol pads lanes.
        self.symbol = {c: i + 1 for i, c in enumerate(common)}
        self.width = 1 + len(common) + FOLDS + 1
        self.pad = self.width - 1
        self.languages = list(coded)
        self.bits = [math.log2(max(2, len(c))) for c in coded.values()]
        self.tables = [self.table(self.symbols(c).tolist()) for c in coded.values()]
        self._by_code: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_by_code": None}

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        if getattr(self, "_by_code", None) is None:
            by_code = 1 + len(self.symbol) + np.arange(0x110000, dtype=np.int32) % FOLDS
            by_code[0] = 0
            for c, s in self.symbol.items():
                by_code[c] = s
            self._by_code = by_code
        return self._by_code[codes]

    def table(self, codes: list[int]) -> np.ndarray:
        """Entry (state, symbol): row offset of the next state, doubled, plus 1 where a new phrase starts."""
        steps = suffix_automaton(codes)
        root = np.ones(self.width, dtype=np.int32)
        for c, s in steps[0].items():
            root[c] = (s * self.width << 1) | 1
        out = np.tile(root, (len(steps), 1))
        for s, own in enumerate(steps):
            if s and own:
                out[s, list(own)] = np.fromiter(own.values(), dtype=np.int64, count=len(own)) * self.width << 1
        out[:, self.pad] = np.arange(len(steps), dtype=np.int64) * self.width << 1
        return out.ravel()

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(letters, characters, phrases per language) of each text."""
        codes = [letters(t) for t in texts]
        n = np.array([len(c) for c in codes], dtype=np.int64)
        alpha = np.array([int((c != 0).sum()) for c in codes], dtype=np.int64)
        lanes = -(-n // LANE)
        flat = np.full(int(lanes.sum()) * LANE, self.pad, dtype=np.int32)
        first = np.cumsum(lanes) - lanes
        for c, at in zip(codes, (first * LANE).tolist()):
            flat[at:at + len(c)] = self.symbols(c)
        grid = np.ascontiguousarray(flat.reshape(-1, LANE).T)
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        some = lanes > 0
        for k, table in enumerate(self.tables):
            at = np.zeros(grid.shape[1], dtype=np.int32)
            total = np.zeros(grid.shape[1], dtype=np.int32)
            for row in grid:
                at += row
                np.take(table, at, out=at)
                total += at & 1
                at >>= 1
            if some.any():
                out[some, k] = np.add.reduceat(total, first[some])
        return alpha, n, out

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        rows: list[tuple] = []
        plain = [t or "" for t in texts]
        for a, b in row_slices(text_bytes(plain)):
            if not self.languages:
                rows += [(UNKNOWN, 0.0, 0, 0.0)] * (b - a)
                continue
            alpha, n, found = self.phrases(plain[a:b])
            cost = found * np.array(self.bits)
            for i in range(b - a):
                if not alpha[i]:
                    rows.append((UNKNOWN, 0.0, 0, 0.0))
                    continue
                order = np.argsort(cost[i], kind="stable")
                best = cost[i][order[0]]
                score = float(cost[i][order[1]] / (best + cost[i][order[1]])) if len(order) > 1 else 1.0
                rows.append((self.languages[order[0]], score, int(alpha[i]), float(best / n[i])))
        return pd.DataFrame(rows, columns=["lang", "score", "letters", "bits"])


def training_sample(labelled: DataFrame, chars_per_language: int = CHARS_PER_LANGUAGE,
                    chars_altogether: int = CHARS_ALTOGETHER) -> dict[str, str]:
    """At most ``chars_per_language`` characters of each language, from the documents first in hash order.

    ``labelled`` has doc_id, lang, text.  Rows count from their first letter on, up to the bound.  Their lengths are
    summed by language and power of two of the hash (``LEVELS`` sums per language reach the driver); the levels that
    fill the bound are read, so a language with a letter always has a sample.  Equal rows reach the driver once.
    """
    hashed = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text", F.lit(6))
    rows = labelled.where(F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}"))).select(
        "lang", F.pmod(hashed, F.lit(1 << (LEVELS - 1))).alias("u"),
        F.when(F.rlike("text", F.lit(r"^\p{L}")), F.col("text")).otherwise(
            F.regexp_replace("text", r"^\P{L}+", "")).alias("text")).withColumn("level", F.length(F.bin("u")))

    def level_sums(bound):
        return rows.groupBy("lang", "level").agg(F.sum(F.least(F.length("text"), F.lit(bound))).alias("n")).collect()

    sums = level_sums(chars_per_language)
    if not sums:
        return {}
    bound = max(1000, min(chars_per_language, chars_altogether // len({r["lang"] for r in sums})))
    if bound != chars_per_language:
        sums = level_sums(bound)
    room, last = {}, {}
    for r in sorted(sums, key=lambda r: r["level"]):
        if room.setdefault(r["lang"], bound) > 0:
            room[r["lang"]] -= r["n"]
            last[r["lang"]] = r["level"]
    upto = F.create_map(*[x for lang, level in last.items() for x in (F.lit(lang), F.lit(level))])
    taken = rows.where(F.col("level") <= F.element_at(upto, F.col("lang"))).select(
        "lang", "u", F.substring("text", 1, bound).alias("text")).groupBy("lang", "u", "text").count().collect()
    out: dict[str, list[str]] = {}
    room = dict.fromkeys(last, bound)
    for r in sorted(taken, key=lambda r: (r["u"], r["text"])):
        for _ in range(r["count"]):
            if room[r["lang"]] <= 0:
                break
            out.setdefault(r["lang"], []).append(r["text"][:room[r["lang"]]])
            room[r["lang"]] -= len(r["text"])
    return {lang: "\n".join(texts) for lang, texts in out.items()}


def fit(labelled: DataFrame, chars_per_language: int = CHARS_PER_LANGUAGE) -> Parser:
    return Parser(training_sample(labelled, chars_per_language))


@contextmanager
def shared_model(spark: SparkSession, model: Parser):
    """The model as a broadcast (its size is bounded by the sample), destroyed at the end: store within what needs it."""
    shared = spark.sparkContext.broadcast(model)
    try:
        yield shared
    finally:
        shared.destroy()


def identify(docs: DataFrame, model: Parser | Broadcast, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into``: lang, score (0 to 1), letters, bits a character."""
    shared = model if isinstance(model, Broadcast) else docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf(RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield shared.value.predict(texts.tolist())

    return docs.withColumn(into, predict(F.col(text)))


def accepted(language: Column, most_bits: float = 8.0, least_letters: int = 20) -> Column:
    """Rejects texts without a letter, and longer ones that no language's strings make up (nearly a phrase for every
    second character)."""
    return (language["lang"] != UNKNOWN) & ((language["letters"] < least_letters) | (language["bits"] <= most_bits))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2
