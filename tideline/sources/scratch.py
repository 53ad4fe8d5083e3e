"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tideline-")


def scratch_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of our own in local mode. On a
    cluster this is an error, since executors would not see each other's files."""
    conf = spark.sparkContext.getConf()
    given = conf.get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_own_folder()}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(at, True)
