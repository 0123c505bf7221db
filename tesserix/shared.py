"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A session that names none gets its own only if it runs on one machine, as tests do."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tesserix-"))
    return sc.getCheckpointDir()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside go when each action ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows from the checkpoint folder: no part of the plan above runs again, and its shuffle files are gone."""
    shared_dir(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str, rows: int | None = None, each: int = 1_000_000) -> DataFrame:
    """Dealt by the keys over as many partitions as its rows ask for (rows, else counted), so a task's sort or hash table doesn't grow with the table."""
    n = df.count() if rows is None else rows
    return df.repartition(max(1, -(-n // each)), *keys)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Parquet tables under one new folder of the shared one. drop() removes a table that no later plan reads; the rest go when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def path(self, table: str) -> str:
        return f"{self.top}/{table}"

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        with shuffles_freed(self.spark):
            df.write.parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        for table in tables:
            remove(self.spark, self.path(table))

    def _end(self) -> None:
        try:
            remove(self.spark, self.top)
        except Exception:  # the session may be gone; then its folder is no longer in use
            return
