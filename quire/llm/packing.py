"""Best-fit packing with certified partitions.

Documents become pieces of at most ``capacity`` token ids (only longer ones are cut; the first piece may be shorter).
Pieces are dealt to partitions; each is packed best-fit decreasing, and dual-feasible functions give a lower bound of
the sequences that partition needs.  A partition that meets its bound is certified.  Of the others, full sequences
stay and the rest of their pieces are dealt anew among fewer partitions and packed again, until every partition is
certified or one partition holds what is left.

Defined cases: null text is empty (the end id alone, one piece); repeated rows are packed each for itself; an empty
table gives an empty result; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_slices, stored, text_bytes
from .tokenize import ByteEncoder, encoder

PIECE = "doc_id string, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", sequence_id long, offset long, certified boolean, open boolean"
#: Pieces packed together in one task at most (about 20 MB of rows); the number of partitions follows from the count.
PARTITION_PIECES = 20_000


def token_pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = 1024,
                 with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves."""
    schema = PIECE + (", ids binary" if with_ids else "")
    tail = int(end_id).to_bytes(4, "little")
    width = 4 * capacity

    def run(batches):
        enc = encoder(ByteEncoder, tokenizer)
        for pdf in batches:
            texts = pdf["text"].tolist()
            keys = pdf["doc_id"].tolist()
            rows = []
            for a, b in row_slices(text_bytes(texts)):
                for key, ids in zip(keys[a:b], enc.values(texts[a:b])):
                    ids += tail
                    end = len(ids) % width or min(width, len(ids))
                    start = piece = 0
                    while start < len(ids):
                        part = ids[start:end]
                        rows.append((key, piece, start // 4, len(part) // 4, zlib.crc32(part)) + ((part,) if with_ids else ()))
                        start, end, piece = end, end + width, piece + 1
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            yield out

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
                       ).mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: the largest bound over two families of dual-feasible functions."""
    if len(lengths) == 0:
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[:capacity + 1]
    size = np.arange(capacity + 1)
    total = int((count * size).sum())
    best = -(-total // capacity)
    # Family 1, threshold t: pieces over capacity - t count whole, those under t nothing.
    whole = np.cumsum(count[::-1])[::-1]  # pieces of at least this length
    mass = np.concatenate([[0], np.cumsum(count * size)])
    t = np.arange(1, capacity // 2 + 1)
    bound = whole[capacity - t + 1] * capacity + mass[capacity - t + 1] - mass[t]
    best = max(best, int(-(-bound.max() // capacity)))
    # Family 2, k: a length that is a multiple of 1 / (k + 1) keeps its share, others round down to multiples of 1 / k.
    for k in range(1, 101):
        scaled = (k + 1) * size
        exact = scaled % capacity == 0
        share = np.where(exact, size * k, (scaled // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, int(-(-int((count * share).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the room left in each bin.  Open bins are kept by the room they have; a bit set
    of the rooms in use gives the tightest one that fits."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []
    used = 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = used >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                used ^= 1 << room
        else:
            room, b = capacity, len(rooms)
            rooms.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        room -= n
        rooms[b] = room
        if room:
            by_room[room].append(b)
            used |= 1 << room
    return bins, offsets, np.array(rooms, dtype=np.int64)


def pack_part(level: int, last: bool, capacity: int):
    """Pack one partition; where it misses its bound and is not the last resort, pieces of unfilled sequences stay open."""

    def one(key, pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True],
                              ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, rooms = best_fit_decreasing(lengths, capacity)
        met = len(rooms) == lower_bound(lengths, capacity)
        full = rooms[bins] == 0
        return pdf.drop(columns="part").assign(sequence_id=(level << 58) | (int(key[0]) << 24) | bins, offset=offsets,
                                               certified=full | met, open=~full & (not met) & (not last))

    return one


def pack(pieces: DataFrame, capacity: int = 1024, partition_pieces: int = PARTITION_PIECES,
         max_rounds: int = 8) -> DataFrame:
    """Place every piece; returns its columns with sequence_id, offset and ``certified``: the piece's sequence is full, or
    its partition met its lower bound.  Only the last round can leave pieces without."""
    left = pieces.select(F.col("doc_id").cast("string").alias("doc_id"), *[c.split()[0] for c in PIECE.split(", ")[1:]])
    n = left.count()
    done: list[DataFrame] = []
    for level in range(max_rounds):
        parts = max(1, -(-n // partition_pieces))
        last = parts == 1 or level == max_rounds - 1

        # The row's number keeps repeated rows from meeting in one partition.
        part = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id(), F.lit(level)), F.lit(parts))
        placed = stored(left.withColumn("part", part).groupBy("part").applyInPandas(pack_part(level, last, capacity), PLACED), f"pack-{level}")
        done.append(placed.where(~F.col("open")).drop("open"))
        left = placed.where("open").drop("open", "certified", "sequence_id", "offset")
        n = left.count()
        if n == 0:
            break
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2,
                   capacity: int = 1024) -> DataFrame:
    return pack(stored(token_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
