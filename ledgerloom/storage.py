"""Shared scratch storage: the one place where intermediate tables are written."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (tests, a single machine) a temporary
    folder is chosen and remembered in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        found = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """Collects the paths of the tables that :func:`written` makes inside the block."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield paths
    finally:
        _scopes[:] = [s for s in _scopes if s is not paths]


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to shared storage and read it back.

    Unlike a local checkpoint the copy survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    for scope in _scopes:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch folders."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`written` that is no longer needed."""
    root = scratch_dir(spark).removeprefix("file:").lstrip("/")
    remove(spark, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles() if root in f}))


def release(spark: SparkSession, rounds: int = 3) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    It does so when the driver's garbage is collected, which on its own may
    come long after the disk is full. One collection frees the plans, the next
    the shuffles they held; Spark's cleaner works beside, hence the pauses.
    """
    for _ in range(rounds):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
