"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles.  Hashing every shingle to one of m blocks and taking the XOR of the
hashes in each block gives a parity sketch: a shingle that two sets do not share changes one block at most, so the
number of blocks that differ is a lower bound of the symmetric difference.  Sets with Jaccard similarity J >= 0.8 and
sizes a and b differ in at most d = (a + b) / 9 shingles; with m > d blocks at least m - d blocks agree (pigeonhole).
Sizes are cut into bands so narrow that two similar sets lie in the same or in adjacent bands; each pair of adjacent
bands has its own d and m, and a set is sketched for both pairs it belongs to.

A block without a shingle agrees everywhere and says nothing.  m has so much room that a set nearly always has fewer
empty blocks than m - d, and then some agreeing block is not empty; a set with more also sends the 0.2 * size + 1
smallest hashes (the prefix filter), which finds every pair of two such sets.  So no link is lost.

Block values go, packed, to buckets; a task sorts a bucket's values and pairs the sets that share one.  Values shared by
up to ``ALL_PAIRS`` sets give all pairs.  Of larger groups, each set is first compared with one hub, the member of its
groups that shares most with the others (of copies of one text, that text).  Groups which the verified links leave in
several components are then compared in blocks: every member outside the main component meets all members, by size
and by the Hamming distance of 1024-bit sketches, which is a lower bound too, and only pairs that pass leave the task.
Pairs that components already connect need no check; all others are compared shingle by shingle.

Defined cases: null and wordless texts have the empty set and link with nothing; fewer words than a shingle's give one
shingle of all; equal sets are one class, whatever their number; repeated rows are kept, each with its class; a null
doc_id counts as the least long while components form and is returned as null; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (dropped, empty, gram_hashes, mix64, released_shuffles, row_slices, shuffle_width, signed, stored,
                     text_bytes, word_table)
from .components import components

WORDS = 5
SKETCH_WORDS = 16
ALL_PAIRS = 8
BLOCK_MEMBERS = 4096
#: Equal sets that one task meets again are not sent again, as far as its table of so many places remembers them.
REMEMBERED = 1 << 18
#: Values that a task holds before it packs them, and that one bucket holds on average at most.
PACKED_VALUES = 400_000
BUCKET_VALUES = 500_000
NULL_ID = -(1 << 63)


def size_bands(most: int) -> list[int]:
    """Band limits: the largest partner of a size in band k (5/4 of it) lies in band k + 1 at the latest."""
    limits = [1, 2]
    while limits[-1] <= most:
        limits.append(max(limits[-1] + 1, (limits[-1] - 1) * 5 // 4 + 1))
    return limits


_LIMITS = np.array(size_bands(1 << 40), dtype=np.int64)


def band_blocks(group: int) -> tuple[int, int]:
    """(d, m) of the pairs whose smaller set is in band ``group``."""
    largest = int(_LIMITS[group + 1]) - 1
    d = (largest + largest * 5 // 4) // 9
    return d, d + 1 + (d + 1) // 10 + 2


def shingle_sets(texts: list[str | None], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, doc, _, _ = word_table(texts, lower=True)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    grams = gram_hashes(h, k)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            s = np.sort(grams[a:b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mix64(gram_hashes(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_identity(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit values that equal sets share."""
    with np.errstate(over="ignore"):
        return (int(np.bitwise_xor.reduce(mix64(s ^ np.uint64(0x1F83D9ABFB41BD6B)), initial=np.uint64(0)).view(np.int64)),
                int(mix64(s ^ np.uint64(0x5BE0CD19137E2179)).sum(dtype=np.uint64).view(np.int64)))


def bit_sketch(s: np.ndarray) -> np.ndarray:
    """1024 bits, each the parity of the shingles hashed to it."""
    bits = np.bincount((s >> np.uint64(20)).astype(np.int64) & (64 * SKETCH_WORDS - 1), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def block_values(s: np.ndarray) -> np.ndarray:
    """The values that a set sends; bit 0 is 1 where it is the larger set of the pair of bands."""
    band = int(np.searchsorted(_LIMITS, len(s), side="right")) - 1
    value = mix64(s ^ np.uint64(0x3C6EF372FE94F82B))
    out = []
    for group in (band, band - 1) if band else (band,):
        d, m = band_blocks(group)
        salt = mix64(np.array([group * 2], dtype=np.uint64))[0]
        block = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # ascending, as s is
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        sent = mix64(np.bitwise_xor.reduceat(value, first) + mix64(block[first] + salt))
        if m - len(first) >= m - d:
            prefix = s[:len(s) - -(-4 * len(s) // 5) + 1]
            sent = np.concatenate([sent, mix64(prefix + mix64(np.array([group * 2 + 1], dtype=np.uint64))[0])])
        out.append((sent & ~np.uint64(1)) | np.uint64(group != band))
    return np.concatenate(out)


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, h1, h2, sketch) of every row of (doc_id, text)."""
    schema = "doc_id string, text_hash long, n long, h1 long, h2 long, sketch array<long>"

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            rows = []
            for a, b in row_slices(text_bytes(texts)):
                for s in shingle_sets(texts[a:b]):
                    rows.append((len(s), *set_identity(s), bit_sketch(s)))
            more = pd.DataFrame(rows, columns=["n", "h1", "h2", "sketch"])
            yield pd.concat([pdf[["doc_id", "text_hash"]].reset_index(drop=True), more], axis=1)

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       "text").mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def sent_values(docs: DataFrame, bits: int) -> DataFrame:
    """(bucket, values, ids): what all sets send, packed; a value's first ``bits`` bits are its bucket, its last 56 are
    packed, and a set's first 40 bits name it (an ambiguous name only adds candidates)."""

    def packed(values, names):
        value, name = np.concatenate(values), np.concatenate(names)
        bucket = (value >> np.uint64(64 - bits)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        value = np.ascontiguousarray(value[order]).view(np.uint8).reshape(-1, 8)[:, :7]
        name = np.ascontiguousarray(name[order]).view(np.uint8).reshape(-1, 8)[:, :5]
        ends = np.cumsum(np.bincount(bucket, minlength=1 << bits))
        starts = np.concatenate([[0], ends[:-1]])
        some = np.flatnonzero(ends > starts).tolist()
        return pd.DataFrame({"bucket": np.array(some, dtype=np.int32),
                             "values": [value[starts[k]:ends[k]].tobytes() for k in some],
                             "ids": [name[starts[k]:ends[k]].tobytes() for k in some]})

    def run(batches):
        seen = np.zeros((REMEMBERED, 2), dtype=np.int64)
        values, names, held = [], [], 0
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in row_slices(text_bytes(texts)):
                for s in shingle_sets(texts[a:b]):
                    if not len(s):
                        continue
                    who = set_identity(s)
                    place = seen[who[0] & (REMEMBERED - 1)]
                    if place[0] == who[0] and place[1] == who[1]:
                        continue
                    place[:] = who
                    v = block_values(s)
                    values.append(v)
                    names.append(np.full(len(v), (who[0] >> 24) & ((1 << 40) - 1), dtype=np.uint64))
                    held += len(v)
                    if held > PACKED_VALUES:
                        yield packed(values, names)
                        values, names, held = [], [], 0
        if held:
            yield packed(values, names)

    return docs.select("text").mapInPandas(run, "bucket int, values binary, ids binary")


def unpack(parts: list[bytes], width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :width] = raw
    return out.view(np.uint64).ravel()


def bucket_pairs(value: np.ndarray, name: np.ndarray) -> pd.DataFrame:
    """Candidates of one bucket: (kind, value, a, b); kind 0 is a pair, kind 1 a member of a large group."""
    order = np.argsort(value, kind="stable")
    value, name = value[order], name[order]
    key = value >> np.uint64(1)
    same = key[1:] == key[:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    key, name, larger = key[shared], name[shared], (value[shared] & np.uint64(1)).astype(bool)
    order = np.lexsort((larger, name, key))
    key, name, larger = key[order], name[order], larger[order]
    if len(key):
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])])
        key, name, larger = key[new], name[new], larger[new]
    if not len(key):
        return empty({"kind": "int32", "value": "int64", "a": "int64", "b": "int64"})
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([first, [len(key)]]))
    size_of = np.repeat(size, size)
    a, b = [], []
    few = size_of <= ALL_PAIRS
    for gap in range(1, ALL_PAIRS):
        i = np.flatnonzero(few[:-gap] & (key[gap:] == key[:-gap]))
        i = i[~(larger[i] & larger[i + gap])]
        a.append(name[i])
        b.append(name[i + gap])
    many = np.flatnonzero(~few)
    pairs = pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})
    pairs = pairs[pairs["a"] != pairs["b"]].drop_duplicates()
    members = pd.DataFrame({"value": signed(key[many]), "a": signed(name[many])}).assign(kind=1, b=0)
    return pd.concat([pairs.assign(kind=0, value=0), members])[["kind", "value", "a", "b"]]


def candidate_pairs(docs: DataFrame, shingles: int) -> DataFrame:
    """Candidates of ``docs``, whose sets have so many shingles together; a set sends about a value for each."""
    buckets = max(4 * shuffle_width(docs.sparkSession), -(-shingles // BUCKET_VALUES))
    bits = max(8, (buckets - 1).bit_length())

    def run(batches: Iterator[pd.DataFrame]):
        at, values, ids = None, [], []
        for pdf in batches:
            for bucket, v, i in zip(pdf["bucket"], pdf["values"], pdf["ids"]):
                if bucket != at:
                    if values:
                        yield bucket_pairs(unpack(values, 7), unpack(ids, 5))
                    at, values, ids = bucket, [], []
                values.append(v)
                ids.append(i)
        if values:
            yield bucket_pairs(unpack(values, 7), unpack(ids, 5))

    sent = sent_values(docs, bits).repartition(shuffle_width(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    return sent.mapInPandas(run, "kind int, value long, a long, b long").distinct()


def similar_enough(common: np.ndarray | Column, a, b, percent: int = 80):
    return 100 * common >= percent * (a + b - common)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) whose shingle sets are similar enough; ``texts`` is (node, text)."""

    def run(batches):
        for pdf in batches:
            keep = []
            ta, tb = pdf["text_u"].tolist(), pdf["text_v"].tolist()
            for a, b in row_slices([x + y for x, y in zip(text_bytes(ta), text_bytes(tb))]):
                for x, y in zip(shingle_sets(ta[a:b]), shingle_sets(tb[a:b])):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(similar_enough(common, len(x), len(y)))
            yield pdf[["u_id", "u_hash", "v_id", "v_hash"]][np.array(keep, dtype=bool)]

    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u").join(
        texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
    flat = both.select(F.col("u.id").alias("u_id"), F.col("u.hash").alias("u_hash"), F.col("v.id").alias("v_id"),
                       F.col("v.hash").alias("v_hash"), "text_u", "text_v")
    out = flat.mapInPandas(run, "u_id long, u_hash long, v_id long, v_hash long")
    return out.select(F.struct(F.col("u_id").alias("id"), F.col("u_hash").alias("hash")).alias("u"),
                      F.struct(F.col("v_id").alias("id"), F.col("v_hash").alias("hash")).alias("v"))


def hub_pairs(groups: DataFrame) -> DataFrame:
    """(u, v, shared): members of large groups (value, node, n, sketch) with the hubs of their groups that may be
    similar, and how many groups share that hub.  A group's hub is the member of most large groups."""
    degree = groups.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    hubs = groups.join(degree, "node").groupBy("value").agg(F.max(F.struct("degree", "node", "n", "sketch")).alias("hub"))
    hubs = hubs.select("value", F.col("hub.node").alias("p"), F.col("hub.n").alias("n_p"), F.col("hub.sketch").alias("s_p"))
    near = groups.select("value", F.col("node").alias("q"), F.col("n").alias("n_q"), F.col("sketch").alias("s_q")).join(
        hubs, "value").where((F.col("p") != F.col("q")) & may_be_similar())
    return near.groupBy(F.col("p").alias("u"), F.col("q").alias("v")).agg(F.count(F.lit(1)).alias("shared"))


def may_be_similar() -> Column:
    """Sizes n_p and n_q and sketches s_p and s_q allow the similarity."""
    far = F.aggregate(F.zip_with("s_p", "s_q", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return ((5 * F.col("n_p") >= 4 * F.col("n_q")) & (5 * F.col("n_q") >= 4 * F.col("n_p"))
            & (9 * far <= F.col("n_p") + F.col("n_q")))


def compared_blocks(members: DataFrame) -> DataFrame:
    """(u, v): near pairs of large groups that several components share.

    ``members``: value, main (the group's main root), root, k (its size), id, hash, n, sketch.  A group's members are
    dealt to blocks of ``BLOCK_MEMBERS``; those outside the main component are sent to every block and streamed past
    its members, so a task holds one block.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("k") / BLOCK_MEMBERS)).cast("int")
    cols = ["value", "block", "kind", "id", "hash", "root_id", "root_hash", "n", "sketch"]
    flat = members.withColumns({"root_id": F.col("root.id"), "root_hash": F.col("root.hash")})
    held = flat.withColumns({"block": F.pmod(F.xxhash64("id", "hash"), blocks).cast("int"), "kind": F.lit(0)}).select(*cols)
    sent = flat.where(F.col("root") != F.col("main")).withColumns(
        {"block": F.explode(F.sequence(F.lit(0), blocks - 1)), "kind": F.lit(1)}).select(*cols)

    def arrays(pdf):
        return (pdf[["id", "hash"]].to_numpy(np.int64), pdf[["root_id", "root_hash"]].to_numpy(np.int64),
                pdf["n"].to_numpy(np.int64), np.stack(pdf["sketch"].to_numpy()).view(np.uint64))

    def near_pairs(one, others):
        out = []
        for a, b in row_slices([len(one[0])] * len(others[0]), 40_000):
            who, root, n, sketch = (x[a:b] for x in others)
            apart = (root[:, None, :] != one[1][None]).any(axis=2)
            total = n[:, None] + one[2][None]
            alike = apart & (5 * n[:, None] >= 4 * one[2][None]) & (5 * one[2][None] >= 4 * n[:, None])
            i, j = np.nonzero(alike)
            far = np.bitwise_count(sketch[i] ^ one[3][j]).sum(axis=1, dtype=np.int64)
            fine = far * 9 <= total[i, j]
            out.append(np.concatenate([who[i[fine]], one[0][j[fine]]], axis=1))
        return np.concatenate(out)

    def run(batches):
        at, held_rows, one = None, [], None
        for pdf in batches:
            found = []
            new = (pdf[["value", "block", "kind"]] != pdf[["value", "block", "kind"]].shift()).any(axis=1).cumsum()
            for _, part in pdf.groupby(new, sort=False):
                key = (part["value"].iloc[0], part["block"].iloc[0])
                if part["kind"].iloc[0] == 0:
                    if key != at:
                        at, held_rows = key, []
                    held_rows.append(arrays(part))
                    one = None
                elif key == at:
                    if one is None:
                        one = tuple(np.concatenate(x) for x in zip(*held_rows))
                    found.append(near_pairs(one, arrays(part)))
            if found:
                yield pd.DataFrame(np.concatenate(found), columns=["a_id", "a_hash", "b_id", "b_hash"]).drop_duplicates()

    dealt = held.unionByName(sent).repartition(shuffle_width(members.sparkSession), "value", "block")
    out = dealt.sortWithinPartitions("value", "block", "kind").mapInPandas(
        run, "a_id long, a_hash long, b_id long, b_hash long")
    a, b = (F.struct(F.col(f"{x}_id").alias("id"), F.col(f"{x}_hash").alias("hash")) for x in "ab")
    return out.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, root) of every row of ``docs`` (doc_id, text).

    ``root`` (id, hash) tells components apart even where ids are null or repeated; component_id is only its id."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID).cast("long")).alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(described(docs), "shingle-sets")
    # One node per distinct set: its first row's id and text hash.
    node = F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    sets = stored(rows.where("n > 0").groupBy("h1", "h2", "n").agg(F.min(node).alias("node"), F.first("sketch").alias(
        "sketch")), "distinct-sets")
    with released_shuffles(docs.sparkSession):
        shingles = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    found = stored(candidate_pairs(docs, shingles), "candidates")
    named = sets.select(F.shiftrightunsigned("h1", 24).alias("name"), "node", "n", "sketch")
    side = lambda x, y: named.select(F.col("name").alias(x), F.col("node").alias(y), F.col("n").alias(f"n_{y}"),
                                     F.col("sketch").alias(f"s_{y}"))
    def pruned(pairs):
        return pairs.join(side("a", "p"), "a").join(side("b", "q"), "b").where(
            (F.col("p") != F.col("q")) & may_be_similar()).select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"))

    pairs = stored(pruned(found.where("kind = 0").select("a", "b")), "pairs")
    groups = stored(found.where("kind = 1").select("value", F.col("a").alias("name")).join(
        named, "name").select("value", "node", "n", "sketch"), "large-groups")
    dropped(found)
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).unionByName(
        groups.select("node")).distinct().select(F.col("node.id").alias("doc_id"), F.col("node.hash").alias("text_hash"))
    texts = docs.withColumn("text_hash", F.xxhash64("text")).join(wanted, ["doc_id", "text_hash"]).groupBy(
        "doc_id", "text_hash").agg(F.first("text").alias("text"))
    texts = stored(texts.select(F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).alias("node"),
                                "text"), "candidate-texts")
    # First each set with its smallest candidate and with the hub it shares most with, then what these leave apart.
    hubs = hub_pairs(groups)
    best = hubs.groupBy("v").agg(F.max_by("u", F.struct("shared", "u")).alias("u"))
    ordered = lambda d: d.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    first = stored(ordered(pairs.groupBy("v").agg(F.min("u").alias("u"))).unionByName(ordered(best)).distinct(), "first-pairs")
    links = stored(verified(first, texts), "links-1")
    root = stored(components(links), "roots-1")
    where = lambda x: root.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    apart = F.coalesce("root_u", "u") != F.coalesce("root_v", "v")
    rest = pairs.join(first, ["u", "v"], "left_anti").join(where("u"), "u", "left").join(
        where("v"), "v", "left").where(apart).select("u", "v")
    member = groups.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    main = member.groupBy("value", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("value").agg(
        F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("roots")).where(
        "roots > 1").drop("roots")
    split = member.join(main, "value").select(
        "value", "main", "root", "k", "node.id", "node.hash", "n", "sketch")
    crossed = stored(compared_blocks(split), "crossed")
    more = stored(verified(rest.unionByName(crossed.join(first, ["u", "v"], "left_anti")).distinct(), texts), "links-2")
    # From here on, texts and pairs are read no more.
    dropped(pairs, groups, texts, first, crossed)
    if not more.isEmpty():
        before, root = root, stored(components(links.unionByName(more)), "roots-2")
        dropped(before)
    dropped(links, more)
    classed = rows.join(sets.select("h1", "h2", "n", "node"), ["h1", "h2", "n"], "left").join(root, "node", "left")
    null_id = F.lit(NULL_ID).cast("long")
    classed = classed.withColumn("root", F.coalesce("root", "node", node))
    return classed.select(
        F.nullif("doc_id", null_id).alias("doc_id"), "text_hash", F.col("n").alias("n_shingles"),
        F.nullif("root.id", null_id).alias("component_id"), "root")
