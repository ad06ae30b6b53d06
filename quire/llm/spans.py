"""Removal of repeated passages with suffix automata of routed reference shards.

A window is ``window`` consecutive words; a word goes if a window over it also starts anywhere else.  Which text must be
compared with which is decided by content: the window's anchor is the least hash among its 8-word strings, so equal
windows have equal anchors.  Consecutive windows with one anchor position form a segment (28 windows at most), and a
segment is routed to the shard of its anchor.  This takes the place of sending every shard to every document, whose
cost would grow with documents times shards; a shard meets exactly the text that can match it.

Anchors that occur once are dropped.  An anchor whose segments are all equal needs no comparison.  For the others a
shard's reference is its distinct segments with their number of occurrences: their generalised suffix automaton is
built and each segment streamed through it; where the matching statistic reaches the window's length, the state tells
how often that window occurs.  An anchor with more than ``SHARD_SEGMENTS`` distinct segments (a common phrase in ever
new surroundings) is routed more finely, each window by itself, which groups and counts equal windows.

Words are compared as text in both ways; 64-bit hashes decide which segments are equal.

Defined cases: null text has no words; texts shorter than a window lose nothing; repeated rows are occurrences of their
own, so all their windows repeat; rows are told apart by doc_id, a 64-bit hash of the text and its length (rows alike
in all three are equal rows, whose marks are the same); a null doc_id counts as the least long meanwhile; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (gram_hashes, mix64, powers, row_slices, shuffle_width, signed, stored, text_bytes, word_table)

WINDOW = 35
ANCHOR_WORDS = 8
SHARD_SEGMENTS = 1024
NULL_ID = -(1 << 63)
#: What tells rows apart.
ROW = ["doc_id", "text_hash", "n_chars"]
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of every ``width`` entries, the first of equal ones."""
    n = len(h) - width + 1
    value, at, covered = h, np.arange(len(h)), 1
    while covered < width:
        shift = min(covered, width - covered)
        left, right = value[:len(value) - shift], value[shift:]
        second = right < left
        value, at = np.where(second, right, left), np.where(second, at[shift:], at[:len(at) - shift])
        covered += shift
    return at[:n]


def segments(texts: list[str], window: int = WINDOW, anchor_words: int = ANCHOR_WORDS) -> pd.DataFrame:
    """(row, start, n, anchor, segment): start counts words of the text; n windows begin there."""
    h, doc, _, _ = word_table(texts)
    n = len(h) - window + 1
    if n <= 0:
        return pd.DataFrame({"row": [], "start": [], "n": [], "anchor": [], "segment": []})
    grams = gram_hashes(h, anchor_words)
    least = sliding_least(grams, window - anchor_words + 1)[:n]
    inside = np.flatnonzero(doc[:n] == doc[window - 1:])
    if not len(inside):
        return pd.DataFrame({"row": [], "start": [], "n": [], "anchor": [], "segment": []})
    new = np.concatenate([[True], (least[inside[1:]] != least[inside[:-1]]) | (inside[1:] != inside[:-1] + 1)])
    first = np.flatnonzero(new)
    begin = inside[first]
    count = np.diff(np.concatenate([first, [len(inside)]]))
    # A segment's hash: its words' hashes as digits of a number, by prefix sums of the whole slice.
    power, inverse = powers(_BASE, len(h) + 1), powers(_INVERSE, len(h) + 1)
    acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1], dtype=np.uint64)])
    seg = mix64((acc[begin + count + window - 1] - acc[begin]) * inverse[begin] + count.astype(np.uint64))
    row = doc[begin]
    at = np.searchsorted(doc, np.arange(len(texts)))
    return pd.DataFrame({"row": row, "start": begin - at[row], "n": count, "anchor": signed(grams[least[begin]]),
                         "segment": signed(seg)})


def repeated_anchors(docs: DataFrame, window: int) -> DataFrame:
    """(anchor): those with two occurrences at least.  A task sends an anchor twice at most."""
    width = shuffle_width(docs.sparkSession)
    bits = max(8, (4 * width - 1).bit_length())  # with the packed 56 bits, the whole anchor

    def send(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            found = [segments(texts[a:b], window)["anchor"].to_numpy(np.int64).view(np.uint64) for a, b in row_slices(
                text_bytes(texts))]
            if not found:
                continue
            value, count = np.unique(np.concatenate(found), return_counts=True)
            value = np.repeat(value, np.minimum(count, 2))
            bucket = (value >> np.uint64(64 - bits)).astype(np.int32)  # ascending, as value is
            ends = np.cumsum(np.bincount(bucket, minlength=1 << bits))
            starts = np.concatenate([[0], ends[:-1]])
            packed = np.ascontiguousarray(value).view(np.uint8).reshape(-1, 8)[:, :7]
            some = np.flatnonzero(ends > starts).tolist()
            yield pd.DataFrame({"bucket": np.array(some, dtype=np.int32),
                                "anchors": [packed[starts[k]:ends[k]].tobytes() for k in some]})

    def twice(bucket: int, parts: list[bytes]) -> pd.DataFrame:
        raw = np.zeros((sum(map(len, parts)) // 7, 8), dtype=np.uint8)
        raw[:, :7] = np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(-1, 7)
        tail = np.sort(raw.view(np.uint64).ravel())
        top = (np.uint64(bucket) << np.uint64(64 - bits)) >> np.uint64(56) << np.uint64(56)
        value = np.unique(tail[1:][tail[1:] == tail[:-1]]) | top
        return pd.DataFrame({"anchor": signed(value)})

    def receive(batches):
        at, parts = None, []
        for pdf in batches:
            for bucket, p in zip(pdf["bucket"], pdf["anchors"]):
                if bucket != at:
                    if parts:
                        yield twice(at, parts)
                    at, parts = bucket, []
                parts.append(p)
        if parts:
            yield twice(at, parts)

    sent = docs.select("text").mapInPandas(send, "bucket int, anchors binary")
    return sent.repartition(width, "bucket").sortWithinPartitions("bucket").mapInPandas(receive, "anchor long")


def all_segments(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_hash, n_chars, at, anchor, segment) of all documents; at is start * 32 + n."""

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in row_slices(text_bytes(texts)):
                s = segments(texts[a:b], window)
                row = s["row"].to_numpy(np.int64) + a
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[row], "text_hash": pdf["text_hash"].to_numpy()[row],
                                    "n_chars": pdf["n_chars"].to_numpy()[row], "at": s["start"].to_numpy(np.int64) * 32 + s["n"].to_numpy(np.int64),
                                    "anchor": s["anchor"].to_numpy(np.int64), "segment": s["segment"].to_numpy(np.int64)})

    return docs.mapInPandas(run, "doc_id long, text_hash long, n_chars int, at long, anchor long, segment long")


class ShardAutomaton:
    """Generalised suffix automaton over words, with the number of occurrences of every state's strings."""

    def __init__(self, parts: list[tuple[list[str], int]]):
        self.step: list[dict[str, int]] = [{}]
        self.link, self.length, self.uses = [-1], [0], [0]
        for words, weight in parts:
            last = 0
            for w in words:
                last = self.extend(last, w)
                self.uses[last] += weight
        for s in sorted(range(1, len(self.step)), key=self.length.__getitem__, reverse=True):
            self.uses[self.link[s]] += self.uses[s]

    def state(self, length: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.length.append(length)
        self.uses.append(0)
        return len(self.step) - 1

    def twin(self, p: int, w: str) -> int:
        """The state of the strings that end in p's longest followed by w."""
        step, q = self.step, self.step[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        new = self.state(self.length[p] + 1)
        step[new] = dict(step[q])
        self.link[new], self.link[q] = self.link[q], new
        while p != -1 and step[p].get(w) == q:
            step[p][w] = new
            p = self.link[p]
        return new

    def extend(self, last: int, w: str) -> int:
        if w in self.step[last]:
            return self.twin(last, w)
        new, p = self.state(self.length[last] + 1), last
        while p != -1 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        self.link[new] = 0 if p == -1 else self.twin(p, w)
        return new

    def repeated(self, words: list[str], window: int) -> int:
        """Bit i: the window that starts at word i occurs twice at least."""
        state = matched = mask = 0
        for j, w in enumerate(words):
            while state and w not in self.step[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.step[state]:
                state = self.step[state][w]
                matched += 1
            if matched >= window:
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                matched = min(matched, self.length[state])
                if self.uses[state] > 1:
                    mask |= 1 << (j - window + 1)
        return mask


def shard_masks(routed: DataFrame, window: int) -> DataFrame:
    """(anchor, segment, mask) from (anchor, segment, uses, words), one automaton per anchor."""

    def solve(anchor, group):
        automaton = ShardAutomaton([(words, uses) for _, uses, words in group])
        return [(anchor, seg, automaton.repeated(words, window)) for seg, _, words in group]

    def run(batches):
        at, group = None, []
        for pdf in batches:
            out = []
            for anchor, seg, uses, words in zip(pdf["anchor"], pdf["segment"], pdf["uses"], pdf["words"]):
                if anchor != at:
                    if group:
                        out += solve(at, group)
                    at, group = anchor, []
                group.append((seg, uses, words.split(" ")))
            yield pd.DataFrame(out, columns=["anchor", "segment", "mask"])
        if group:
            yield pd.DataFrame(solve(at, group), columns=["anchor", "segment", "mask"])

    spread = routed.repartition(shuffle_width(routed.sparkSession), "anchor").sortWithinPartitions("anchor")
    return spread.mapInPandas(run, "anchor long, segment long, mask long")


def window_masks(routed: DataFrame, window: int) -> DataFrame:
    """The same, each window routed by itself: equal windows are counted."""
    w = F.split("words", " ")
    each = routed.withColumn("w", w).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("w") - window))).select(
        "anchor", "segment", "uses", "i", F.sha2(F.array_join(F.slice("w", F.col("i") + 1, window), " "), 256).alias("hash"))
    often = each.groupBy("hash").agg(F.sum("uses").alias("all_uses")).where("all_uses > 1").select("hash")
    return each.join(often, "hash", "left_semi").groupBy("anchor", "segment").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i"))).alias("mask"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """(ROW, start, mask): bit i of mask says that the window starting at word start + i repeats."""
    found = all_segments(docs, window)
    again = stored(found.join(repeated_anchors(docs, window), "anchor", "left_semi"), "segments")
    shards = stored(again.groupBy("anchor", "segment").agg(
        F.count(F.lit(1)).alias("uses"), F.min(F.struct(*ROW, "at")).alias("one")), "shard-segments")
    sizes = shards.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("uses").alias("all_uses")).where(
        "all_uses > 1")
    sized = stored(shards.join(sizes, "anchor"), "sized-segments")
    equal = sized.where("kinds = 1").select("anchor", "segment", (F.call_function(
        "shiftleft", F.lit(1).cast("long"), (F.col("one.at") % 32).cast("int")) - 1).alias("mask"))
    asked = sized.where("kinds > 1").groupBy(*[F.col(f"one.{c}").alias(c) for c in ROW]).agg(F.collect_list(F.struct("one.at", "anchor", "segment", "uses", "kinds")).alias("asked"))

    def cut(batches):
        for pdf in batches:
            rows = []
            for text, asks in zip(pdf["text"], pdf["asked"]):
                words = _WORDS(text)
                for x in asks:
                    start, n = x["at"] >> 5, x["at"] & 31
                    rows.append((x["anchor"], x["segment"], x["uses"], x["kinds"], " ".join(words[start:start + n + window - 1])))
            yield pd.DataFrame(rows, columns=["anchor", "segment", "uses", "kinds", "words"])

    cut_out = docs.join(asked, ROW).select("text", "asked").mapInPandas(
        cut, "anchor long, segment long, uses long, kinds long, words string")
    routed = stored(cut_out.dropDuplicates(["anchor", "segment"]), "shard-texts")
    masks = equal.unionByName(shard_masks(routed.where(F.col("kinds") <= shard_segments), window)).unionByName(
        window_masks(routed.where(F.col("kinds") > shard_segments), window))
    return again.join(masks.where("mask != 0"), ["anchor", "segment"]).select(
        *ROW, F.shiftright("at", 5).alias("start"), "mask")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words left, joined by one space."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID).cast("long")).alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.length("text").alias("n_chars"), "text")
    marks = repeated_windows(docs, window).groupBy(*ROW).agg(
        F.collect_set(F.struct("start", "mask")).alias("marks"))

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, text, marks in zip(pdf["doc_id"], pdf["text"], pdf["marks"]):
                words = _WORDS(text)
                if marks is None or not len(marks):
                    rows.append((doc, len(words), 0, " ".join(words)))
                    continue
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for m in marks:
                    at, mask = m["start"], m["mask"]
                    while mask:
                        low = mask & -mask
                        i = at + low.bit_length() - 1
                        gone[i] += 1
                        gone[i + window] -= 1
                        mask ^= low
                keep = (np.cumsum(gone[:-1]) == 0).tolist()
                kept = [w for w, k in zip(words, keep) if k]
                rows.append((doc, len(words), len(words) - len(kept), " ".join(kept)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept"])

    out = docs.join(marks, ROW, "left").select("doc_id", "text", "marks").mapInPandas(
        run, "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID).cast("long")))
