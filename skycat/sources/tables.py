"""Derived tables written once into the session's shared checkpoint folder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from skycat.session import ensure_checkpoint_dir


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def fingerprint(spark: SparkSession, path: str) -> str:
    """A text that changes when the files at ``path`` (a file or a folder of files) do."""
    fs, p = _fs(spark, path)
    files = sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p))
    return f"{path}:{files}"


#: Size of a Parquet row group in a derived table, the least that one task can read.
ROW_GROUP_BYTES = 32 << 20
#: Rows that a task of a scan before a shuffle reads, row groups permitting.
SCAN_ROWS = 1 << 19


@contextmanager
def scan_tasks(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside reads files of ``rows`` rows in tasks of about ``SCAN_ROWS`` at most.

    A shuffle into many partitions holds what a task has read until it is sorted by
    partition, and spills it if that is too much; Spark's default is 128 MB of a file a
    task, whatever that is in memory.
    """
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    tasks = max(-(-rows // SCAN_ROWS), int(before or 0))
    if tasks <= spark.sparkContext.defaultParallelism:  # there are as many without
        yield
        return
    spark.conf.set(name, str(tasks))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialized(
    spark: SparkSession,
    key: str,
    build: Callable[[], DataFrame],
    partition_by: tuple[str, ...] = (),
    rows: Callable[[], int] | None = None,
) -> DataFrame:
    """Write ``build()`` as Parquet under the checkpoint folder once; read it back.

    The folder comes from ``spark.checkpoint.dir`` (a shared, reliable location
    on a cluster), so the table survives executor loss and cuts the lineage of
    the expressions that built it.  A finished write is recognised by its
    ``_SUCCESS`` marker; a half-written one is rewritten.  ``rows`` says, for a build that
    shuffles what it reads, how many rows that is (``scan_tasks``).
    """
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/tables/{hashlib.sha1(key.encode()).hexdigest()[:16]}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        w = build().write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES)
        if partition_by:
            w = w.partitionBy(*partition_by)
        with scan_tasks(spark, rows() if rows else 0):
            w.parquet(path)
    return spark.read.parquet(path)


def scratch_path(spark: SparkSession, key: str) -> str:
    """A folder for files written by a job (exports), under the checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/files/{hashlib.sha1(key.encode()).hexdigest()[:16]}"
