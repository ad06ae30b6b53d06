"""Scratch folders and tables written once and read back, in the shared checkpoint folder."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never a machine-local one on a cluster); it goes when the
    application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quire-io/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_inside, _before, _lock = 0, None, threading.Lock()


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is run inside gives its shuffle files back as each query ends; else they lie on the executors' disks until
    the driver happens to collect its garbage.  Blocks may be nested and may overlap in threads."""
    global _inside, _before
    with _lock:
        if not _inside:
            _before = spark.conf.get(_CLEANUP_CONF, None)
            spark.conf.set(_CLEANUP_CONF, "true")
        _inside += 1
    try:
        yield
    finally:
        with _lock:
            _inside -= 1
            if not _inside and _before is None:
                spark.conf.unset(_CLEANUP_CONF)
            elif not _inside:
                spark.conf.set(_CLEANUP_CONF, _before)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def dropped(*frames: DataFrame) -> None:
    """Delete the folders of those ``frames`` that ``stored`` returned, once nothing is left to be read from them."""
    for df in frames:
        if path := vars(df).get("_scratch_path"):
            discard(df.sparkSession, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch folder and read it back: what reads the result reads files, however often, and a lost
    executor reruns nothing that came before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
