"""Writing tables so that readers see whole versions only."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written


def _version(spark: SparkSession) -> str:
    stamp = spark.sql("select date_format(current_timestamp(), 'yyyyMMddHHmmssSSS')").first()[0]
    return f"v{stamp}-{uuid4().hex[:8]}"


def publish(df: DataFrame, root: str, partition_by: list[str] | None = None) -> str:
    """Write a new version below ``root`` and return its path. A version counts once its
    _SUCCESS file is there, which Spark writes last; earlier versions stay readable."""
    path = f"{root}/{_version(df.sparkSession)}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return path


def _latest(spark: SparkSession, root: str) -> str:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = sorted(s.getPath().toString() for s in fs.listStatus(path) if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS")))
    if not whole:
        raise FileNotFoundError(f"no whole version below {root}")
    return whole[-1]


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The latest whole version below ``root``."""
    return spark.read.parquet(_latest(spark, root))


def write_variants(df: DataFrame, path: str, by: list[str]) -> None:
    """Write ``df`` in partitions by the columns ``by``. Only partitions that ``df`` has rows of are
    replaced, all others stay as they are; readers that ask for some partitions read no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def publish_panel(df: DataFrame, root: str, entity: str, ts: str, buckets: int) -> str:
    """Write a new version of a panel below ``root``: rows in ``buckets`` files by a hash of the entity,
    each in order of entity and time, so that ``sorted_panel`` serves windows over an entity without an
    exchange or a sort. Rows of equal entity and time are in no particular order. Returns the version's path."""
    spark = df.sparkSession
    version = _version(spark)
    layout = spark.createDataFrame([(entity, ts, buckets)], "entity string, ts string, buckets int")
    layout.coalesce(1).write.json(f"{root}/_layout/{version}")  # before the version counts
    name = f"panel_{uuid4().hex}"
    # one task for each bucket, hence one file
    rows = df.repartition(buckets, entity).sortWithinPartitions(entity, ts)
    try:
        rows.write.bucketBy(buckets, entity).sortBy(entity, ts).option("path", f"{root}/{version}").saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay
    return f"{root}/{version}"


def sorted_panel(spark: SparkSession, root: str) -> DataFrame:
    """The latest whole version that ``publish_panel`` wrote below ``root``, as a scan that Spark knows to be
    dealt by entity and in order of entity and time. Sets the session's switch for that order."""
    path = _latest(spark, root)
    layout = spark.read.schema("entity string, ts string, buckets int").json(f"{root}/_layout/{path.rsplit('/', 1)[1]}").first()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", True)
    name = f"panel_{uuid4().hex}"
    try:
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{layout.entity}`) SORTED BY (`{layout.entity}`, `{layout.ts}`) INTO {layout.buckets} BUCKETS LOCATION '{path}'")
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def in_order(df: DataFrame, keys: list[str], name: str = "place") -> DataFrame:
    """``df`` sorted by ``keys`` as a whole, with each row's place from 1: rows are dealt into ranges of the keys,
    sorted there and written; places are a range's offset (one number for each range) and the row's own."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = written(ranged.select("*", F.monotonically_increasing_id().alias("_id")), "in_order")
    own = F.shiftright("_id", 33)
    sizes = rows.groupBy(own.alias("_range")).agg(F.count("*").alias("_n")).collect()  # a row for each task of the sort
    before, ahead = [], 0
    for k, n in sorted((r["_range"], r["_n"]) for r in sizes):
        before.append((k, ahead))
        ahead += n
    offsets = F.broadcast(spark.createDataFrame(before, "_range long, _ahead long"))
    placed = rows.withColumn("_range", own).join(offsets, "_range")
    return placed.select(*df.columns, (F.col("_ahead") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    (df.write.option("compression", "gzip") if gzip else df.write).option("header", True).csv(path)


def write_results(df: DataFrame, path: str) -> None:
    """A tidy result table as JSON lines."""
    df.write.json(path)


def tidy(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value): one row per number."""
    rest = [c for c in df.columns if c not in keys]
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in rest))
    return df.select(*keys, F.explode(pairs).alias("_m")).select(*keys, "_m.metric", "_m.value")
