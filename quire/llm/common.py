"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.scratch import dropped, released_shuffles  # noqa: F401
from quire.session import table  # noqa: F401
from quire.sinks.writers import scratch_path

#: A word: characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one numpy pass works on; bounds a worker's arrays (a longer document is alone in its pass).
SLICE_BYTES = 500_000
#: Bytes of one Arrow batch between the JVM and a worker (a longer row is alone in its batch).
BATCH_BYTES = 4_000_000
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs started inside exchange Arrow batches of at most ``BATCH_BYTES`` with their Python workers."""
    before = spark.conf.get(_BATCH_CONF)
    spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_CONF, before)


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to a fresh folder under ``spark.checkpoint.dir`` and read it back: cuts lineage, so that a lost
    executor re-reads files instead of rerunning what came before, and gives back the shuffle files of what came before.
    The folder goes when the application ends, or earlier with ``dropped``."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark), released_shuffles(spark):
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text):
    """Words of a text column (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(texts: list[str]) -> list[int]:
    """UTF-8 length of each text."""
    return [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]


def row_slices(lengths, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``budget`` bytes each, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > budget:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (a bijection of 64-bit words)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    a = np.full(n, base, dtype=np.uint64)
    a[0] = 1
    return np.cumprod(a, dtype=np.uint64)


_POW: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _POW or len(_POW[base]) < n:
        _POW[base] = _powers(base, max(n, SLICE_BYTES + 1024))
    return _POW[base][:n]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def word_table(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document index, byte start, byte end) of every word of ``texts``, in order; byte positions count within
    the UTF-8 of all texts joined without a separator.  The hash is a polynomial over random byte codes, finished by
    a 64-bit mixer; equal words have equal hashes."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
    n = len(buf)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z.astype(np.uint64), z, z, z
    ends = np.cumsum(lens)
    starts = ends - lens
    word = ~_SPACE[buf]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    before[starts[lens > 0]] = False
    s = np.flatnonzero(word & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[ends[lens > 0] - 1] = False
    e = np.flatnonzero(word & ~after) + 1
    if lower:
        buf = _LOWER[buf]
    acc = np.empty(n + 1, dtype=np.uint64)
    acc[0] = 0
    np.cumsum(_BYTES[buf] * powers(_BASE, n), dtype=np.uint64, out=acc[1:])
    h = (acc[e] - acc[s]) * powers(_INV, n + 1)[s]
    h = mix64(h + (e - s).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return h, np.searchsorted(ends, s, side="right"), s, e


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries of ``h`` (length ``len(h) - k + 1``, or 0)."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i:len(h) - k + 1 + i]
    return mix64(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def empty(columns: dict[str, str]) -> pd.DataFrame:
    return pd.DataFrame({k: pd.Series(dtype=v) for k, v in columns.items()})
