"""Alignment of two tokenizers' tokens by sparse token-byte incidence matrices.

Both tokenizers cut the same bytes.  For tokens A and B of a batch of texts, the matrix A (tokens x bytes) has a 1 where
a token covers a byte, and so has B; both are held in compressed sparse rows (``Csr``: row pointers, column indices,
values), built from token lengths.  Gustavson's row-by-row product A * B^T then has an entry per pair of tokens whose
byte ranges overlap (the number of shared bytes): the overlap links.  Offsets at which tokens of both end cut the bytes
into groups; with G (bytes x groups), A * G and B * G tell each token's group, and (A * G) * (B * G)^T links all tokens
of a group.

How many documents of the corpus hold a pair of ids linked is counted per chunk of documents first: a chunk has a row
per distinct pair, pairs are added up by a shuffle, and each chunk gets the totals of its own pairs back, next to its
documents' links.  No text is encoded twice and no table of pairs is broadcast.

``ByteTokens`` and ``PieceTokens`` give ids and byte lengths.  The second encodes a text piece by piece, cut before
spaces, and remembers pieces: no token of such a vocabulary holds a space after another character (checked when it is
loaded), so merges never cross the cut.

Defined cases: null and empty texts, and texts whose joined token bytes differ from space + text under either
tokenizer (such as those that hold U+2581), have no tokens: counts are 0 and the text of the groups is empty; special
strings inside texts are plain text; very long texts are encoded whole, their matrices are multiplied in blocks of
rows; repeated rows and repeated or null ids are documents of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_slices, stored, text_bytes
from .tokenize import LONG_RUN, ByteEncoder, encoder, tokenizer_path

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters whose documents share a chunk, and entries that one block of a product expands to.
CHUNK_CHARS = 12_000_000
BLOCK_ENTRIES = 1 << 20
SLICE_BYTES = 1_000_000
#: Pieces a worker remembers, and the longest.
MEMO_PIECES = 400_000
MEMO_CHARS = 48


# ------------------------------------------------------------------ sparse matrices

@dataclass
class Csr:
    """Compressed sparse rows: row i holds ``values`` at the columns ``indices`` from ``indptr[i]`` to ``indptr[i+1]``."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def row_of(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The row of every entry of rows ``begin`` to ``end``."""
        end = self.rows if end is None else end
        return np.repeat(np.arange(begin, end, dtype=np.int64), np.diff(self.indptr[begin:end + 1]))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        counts = np.bincount(self.indices, minlength=self.columns)
        return Csr(np.concatenate([[0], np.cumsum(counts)]), self.row_of()[order], self.values[order], self.rows)


def interval_matrix(lengths: np.ndarray) -> Csr:
    """Consecutive tokens of these lengths over their bytes."""
    indptr = np.concatenate([[0], np.cumsum(lengths)])
    n = int(indptr[-1])
    return Csr(indptr, np.arange(n, dtype=np.int32), np.ones(n, dtype=np.int32), n)


def interval_transposed(lengths: np.ndarray) -> Csr:
    """``interval_matrix(lengths).transposed()``, directly: a byte's row has its one token."""
    n = int(lengths.sum())
    return Csr(np.arange(n + 1), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), np.ones(n, dtype=np.int32),
               len(lengths))


def row_blocks(work: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose ``work`` (running sum, from 0) stays within ``limit``, one row at least."""
    begin, rows = 0, len(work) - 1
    while begin < rows:
        end = max(begin + 1, int(np.searchsorted(work, work[begin] + limit, side="right")) - 1)
        yield begin, end
        begin = end


def gustavson(a: Csr, b: Csr, limit: int = BLOCK_ENTRIES) -> Csr:
    """a * b, row by row: row i is the sum of the rows of b that row i of a names, times their values.  Rows are taken
    in blocks that expand to ``limit`` entries."""
    per_entry = (b.indptr[1:] - b.indptr[:-1])[a.indices]
    work = np.concatenate([[0], np.cumsum(per_entry)])[a.indptr]
    counts, indices, values = np.zeros(a.rows, dtype=np.int64), [], []
    for begin, end in row_blocks(work, limit):
        entries = slice(a.indptr[begin], a.indptr[end])
        named, times = a.indices[entries], per_entry[entries]
        total = int(times.sum())
        if not total:
            continue
        # Where each named row of b starts, then one step per entry.
        at = np.repeat(b.indptr[named] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(total)
        row, column = np.repeat(a.row_of(begin, end), times), b.indices[at]
        value = np.repeat(a.values[entries], times) * b.values[at]
        key = row * np.int64(b.columns) + column
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key = key[first]
        counts[begin:end] = np.bincount(key // b.columns - begin, minlength=end - begin)
        indices.append(key % b.columns)
        values.append(np.add.reduceat(value, first))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return Csr(np.concatenate([[0], np.cumsum(counts)]), join(indices), join(values), b.columns)


def overlap_links(a_lengths: np.ndarray, b_lengths: np.ndarray) -> Csr:
    """A * B^T: shared bytes of every pair of overlapping tokens."""
    return gustavson(interval_matrix(a_lengths), interval_transposed(b_lengths))


def group_matrix(a_lengths: np.ndarray, b_lengths: np.ndarray) -> Csr:
    """G (bytes x groups)."""
    ends = np.intersect1d(np.cumsum(a_lengths), np.cumsum(b_lengths), assume_unique=True)
    return interval_transposed(np.diff(np.concatenate([[0], ends])))


def group_links(a_lengths: np.ndarray, b_lengths: np.ndarray) -> Csr:
    """(A * G) * (B * G)^T with ones for values: all pairs of tokens of one group."""
    g = group_matrix(a_lengths, b_lengths)
    ag, bg = (gustavson(interval_matrix(x), g) for x in (a_lengths, b_lengths))
    one = lambda m: Csr(m.indptr, m.indices, np.ones(len(m.values), dtype=np.int32), m.columns)
    return gustavson(one(ag), one(bg).transposed())


# ------------------------------------------------------------------ tokens

def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokens(ByteEncoder):
    """Ids of plain texts with a byte-level vocabulary; special strings are encoded as text."""

    def __init__(self, name: str):
        super().__init__(name)
        self.tokenizer.encode_special_tokens = True
        self.special = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}").search
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        letters = byte_alphabet()
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.tokens[k] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
        self.lengths = np.array(list(map(len, self.tokens)), dtype=np.int64)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(v, dtype=np.uint32) for v in self.values([" " + t for t in texts])]


class PieceTokens:
    """Ids of texts with a sentencepiece vocabulary that has byte fallback."""

    SPACE = "▁"

    def __init__(self, name: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(self.SPACE, " ").encode()
                       for i, p in enumerate(pieces)]
        self.lengths = np.array(list(map(len, self.tokens)), dtype=np.int64)
        self.cuts = not any(self.SPACE in p.lstrip(self.SPACE) for p in pieces)
        self.memo: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, dtype=np.uint32) for x in self.model.encode(texts, num_threads=1)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text; the library puts a space before it."""
        out: list = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if not self.cuts or self.SPACE in t]
        for i, x in zip(whole, self.encode([texts[i] for i in whole])):
            out[i] = x
        rest = [i for i in range(len(texts)) if out[i] is None]
        # Each piece is the spaces before a word and the word, less the space that the library adds.
        pieces = [re.findall(" +[^ ]*", " " + texts[i]) if texts[i] else [] for i in rest]
        memo = self.memo
        new = list({p for ps in pieces for p in ps if p not in memo})
        if len(memo) + len(new) > MEMO_PIECES:
            memo.clear()
            new = list({p for ps in pieces for p in ps})
        for p, x in zip(new, self.model.encode([p[1:] for p in new], num_threads=1)):
            # A lone space has nothing left to encode for the library: it is the word-less piece.
            memo[p] = np.array(x if p != " " else [self.model.piece_to_id(self.SPACE)], dtype=np.uint32).tobytes()
        for i, ps in zip(rest, pieces):
            out[i] = np.frombuffer(b"".join(map(memo.__getitem__, ps)), dtype=np.uint32)
        for p in new:
            if len(p) > MEMO_CHARS:
                del memo[p]
        return out


# ------------------------------------------------------------------ alignments

@dataclass
class Aligned:
    """Tokens, groups and links of a batch of texts, one after the other; ``*_ends`` are where each text's end."""

    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    links: Csr
    a_ends: np.ndarray
    b_ends: np.ndarray
    group_ends: np.ndarray

    @property
    def link_ends(self) -> np.ndarray:
        return self.links.indptr[self.a_ends]


def joined_bytes(enc, ids: np.ndarray) -> bytes:
    return b"".join(map(enc.tokens.__getitem__, ids.tolist()))


def align(texts: list[str], enc_a, enc_b) -> Aligned:
    """Tokens, groups and overlap links of ``texts``."""
    full = [i for i, t in enumerate(texts) if t]
    a_ids, b_ids = ([np.zeros(0, dtype=np.uint32)] * len(texts) for _ in "ab")
    some = [texts[i] for i in full]
    for i, t, a, b in zip(full, some, enc_a.ids(some), enc_b.ids(some)):
        data = b" " + t.encode("utf-8", "surrogatepass")
        if joined_bytes(enc_a, a) == data and joined_bytes(enc_b, b) == data:
            a_ids[i], b_ids[i] = a, b
    ends = lambda parts: np.cumsum([len(x) for x in parts], dtype=np.int64)
    join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    a, b = join(a_ids), join(b_ids)
    a_lengths, b_lengths = enc_a.lengths[a], enc_b.lengths[b]
    g = group_matrix(a_lengths, b_lengths)
    a_group, b_group = (gustavson(interval_matrix(x), g).indices for x in (a_lengths, b_lengths))
    a_ends, b_ends = ends(a_ids), ends(b_ids)
    last = np.where(a_ends > 0, a_group[np.maximum(a_ends, 1) - 1] + 1, 0) if len(a) else np.zeros(len(texts), np.int64)
    return Aligned(a, b, a_group, b_group, overlap_links(a_lengths, b_lengths), a_ends, b_ends, last)


def id_digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimals of 0 to size - 1, a byte before each left free, and how many bytes that makes."""
    text = [b"\x00" + str(i).encode() for i in range(size)]
    width = max(map(len, text))
    return np.frombuffer(b"".join(t.ljust(width, b"\x00") for t in text), dtype=np.uint8).reshape(size, width), np.array(
        list(map(len, text)), dtype=np.int64)


_DIGITS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def group_texts(x: Aligned, sizes: tuple[int, int]) -> list[bytes]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    size = max(sizes)
    if size not in _DIGITS:
        _DIGITS[size] = id_digits(size)
    digits, width = _DIGITS[size]
    ids = np.concatenate([x.a, x.b])
    group = np.concatenate([x.a_group, x.b_group])
    side = np.repeat([0, 1], [len(x.a), len(x.b)])
    order = np.argsort(group * 2 + side, kind="stable")
    ids, group, side = ids[order], group[order], side[order]
    before = np.full(len(ids), ord(","), dtype=np.uint8)
    if len(ids):
        new = np.concatenate([[True], group[1:] != group[:-1]])
        before[new] = ord(";")
        before[(side == 1) & np.concatenate([[False], side[:-1] == 0])] = ord("|")
    out = digits[ids]
    out[:, 0] = before
    length = width[ids]
    flat = out[np.arange(out.shape[1]) < length[:, None]].tobytes()
    at = np.concatenate([[0], np.cumsum(length)])
    ends = at[x.a_ends + x.b_ends].tolist()
    return [flat[a + 1:b] for a, b in zip([0, *ends[:-1]], ends)]


def link_pairs(x: Aligned) -> np.ndarray:
    """(A id << 32 | B id) of every link, in order."""
    return (x.a[x.links.row_of()] << 32) | x.b[x.links.indices]


DOC = "chunk long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def aligned_documents(docs: DataFrame, a_name: str = A_NAME, b_name: str = B_NAME,
                      chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """DOC rows: a document's distinct linked pairs, ascending (two 32-bit ids each), and how often each is linked.  A
    chunk also has a row with ``n_a`` -1: its distinct pairs and how many of its documents hold each."""

    def run(batches):
        enc_a, enc_b = encoder(ByteTokens, a_name), encoder(PieceTokens, b_name)
        sizes = (len(enc_a.tokens), len(enc_b.tokens))
        chunk, held, seen = TaskContext.get().partitionId() << 32, 0, []

        names = [c.split()[0] for c in DOC.split(", ")]

        def closed(chunk, seen):
            pairs, docs_with = np.unique(np.concatenate(seen), return_counts=True)
            return pd.DataFrame([(chunk, None, -1, 0, 0, 0, "", packed_pairs(pairs), docs_with.astype(np.uint32).tobytes())],
                                columns=names)

        for pdf in batches:
            texts = pdf["text"].tolist()
            for i, j in row_slices(text_bytes(texts), SLICE_BYTES):
                x = align(texts[i:j], enc_a, enc_b)
                shas = group_texts(x, sizes)
                pairs, link_ends = link_pairs(x), x.link_ends
                starts = np.concatenate([[0], link_ends[:-1]])
                rows = []
                for k in range(j - i):
                    value, times = np.unique(pairs[starts[k]:link_ends[k]], return_counts=True)
                    seen.append(value)
                    rows.append((packed_pairs(value), times.astype(np.uint32).tobytes()))
                firsts = lambda e: np.diff(np.concatenate([[0], e]))
                out = pd.DataFrame(rows, columns=["pairs", "times"]).assign(
                    chunk=chunk, doc_id=pdf["doc_id"].iloc[i:j].to_numpy(), n_a=firsts(x.a_ends), n_b=firsts(x.b_ends),
                    n_groups=firsts(x.group_ends), n_links=firsts(link_ends),
                    groups_sha256=[hashlib.sha256(s).hexdigest() if s else "" for s in shas])
                yield out[names]
                held += sum(map(len, texts[i:j]))
                if held >= chunk_chars:
                    yield closed(chunk, seen)
                    chunk, held, seen = chunk + 1, 0, []
        if seen:
            yield closed(chunk, seen)

    # Ids pass as text, which holds nulls.
    plain = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInPandas(run, DOC)


def packed_pairs(pairs: np.ndarray) -> bytes:
    """Two 32-bit ids a pair."""
    ids = np.stack([pairs >> 32, pairs & 0xFFFFFFFF], axis=1)
    return ids.astype(np.uint32).tobytes()


def unpacked_pairs(raw: bytes) -> np.ndarray:
    ids = np.frombuffer(raw, dtype=np.uint32).reshape(-1, 2).astype(np.int64)
    return (ids[:, 0] << 32) | ids[:, 1]


def pair_totals(chunk_pairs: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents a pair of ids is linked, and whether no pair of its A id has more."""
    totals = stored(chunk_pairs.groupBy("pair").agg(F.sum("n").alias("count")), "pair-totals")
    a_id = F.shiftright("pair", 32)
    most = totals.groupBy(a_id.alias("a_id")).agg(F.max("count").alias("most"))
    return totals.withColumn("a_id", a_id).join(most, "a_id").select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, a_name: str = A_NAME, b_name: str = B_NAME,
                    chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of (doc_id, text)."""
    rows = stored(aligned_documents(docs, a_name, b_name, chunk_chars), "aligned-documents")

    def listed(batches):
        for pdf in batches:
            for chunk, pairs, times in zip(pdf["chunk"], pdf["pairs"], pdf["times"]):
                pair = unpacked_pairs(pairs)
                yield pd.DataFrame({"chunk": np.full(len(pair), chunk, dtype=np.int64), "pair": pair,
                                    "n": np.frombuffer(times, dtype=np.uint32).astype(np.int64)})

    chunk_pairs = rows.where(F.col("n_a") < 0).select("chunk", "pairs", "times").mapInPandas(
        listed, "chunk long, pair long, n long")
    back = chunk_pairs.select("chunk", "pair").join(pair_totals(chunk_pairs), "pair").select("chunk", "pair", "count", "best")

    def weighed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("pair")
        pair, count, best = (right[c].to_numpy() for c in ("pair", "count", "best"))
        n_best, count_sum = [], []
        for pairs, times in zip(left["pairs"], left["times"]):
            at = np.searchsorted(pair, unpacked_pairs(pairs))
            times = np.frombuffer(times, dtype=np.uint32).astype(np.int64)
            n_best.append(int(times[best[at]].sum()))
            count_sum.append(int((times * count[at]).sum()))
        return left.drop(columns=["chunk", "pairs", "times"]).assign(n_best=n_best, count_sum=count_sum)[
            ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]]

    own = rows.where(F.col("n_a") >= 0)
    out = own.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(
        weighed, "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
