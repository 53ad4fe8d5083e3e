"""Intermediate tables in the folder that the whole cluster shares, and columns that pass through."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # of rows on their way to a Python worker
BROADCAST_ROWS = 2_000_000  # rows of a few numbers each; a larger side is shuffled


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tideline-")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a folder of our own in local mode; on a
    cluster this is an error, since executors would not see each other's files."""
    conf = spark.sparkContext.getConf()
    given = conf.get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_own_folder()}"


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, in folders ``by`` columns, and read it back: cuts the lineage,
    survives lost executors, and keeps Parquet's statistics and column pruning. As a plain
    scan, the result is also a join side that Spark can copy to the parts of a skewed key."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    with _set(spark, *BATCH_BYTES):
        df.write.parquet(path, partitionBy=list(by) or None)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def removed(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``df``; nothing may read it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(path, True)


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """What is written here leaves no shuffle files behind: Spark removes them as soon as a write has ended."""
    with _set(spark, CLEANUP, "true"):
        yield


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count finds it within the bound."""
    return F.broadcast(df) if df.count() <= rows else df


def carried(docs: DataFrame) -> list[Column]:
    """All columns under names of our own, so that none clashes with what a step adds."""
    return [F.col(f"`{c}`").alias(f"c_{k}") for k, c in enumerate(docs.columns)]


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns that ``carried`` took from ``docs``, under their names."""
    return df.select(*(F.col(f"c_{k}").alias(c) for k, c in enumerate(docs.columns)))


def name_of(docs: DataFrame, column: str) -> str:
    """The carried name of a column."""
    return f"c_{docs.columns.index(column)}"
