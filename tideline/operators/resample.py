"""Permutations and bootstraps from md5 draws, repeatable in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import draw


def cluster_weights(clusters: DataFrame, cluster: str, replicates: int, seed: int) -> DataFrame:
    """(rep, cluster, w): how often each cluster is drawn in each replicate, with as many
    draws as clusters. ``clusters``: distinct ones; they are numbered in md5 order."""
    spark = clusters.sparkSession
    numbered = numbered_by_md5(clusters.select(cluster), "_i", cluster)
    n = clusters.count()
    slots = spark.range(replicates * n).select(F.expr(f"id div {max(n, 1)}").alias("rep"), (F.col("id") % max(n, 1)).alias("slot"))
    picked = slots.withColumn("_i", draw(F.lit(str(seed)), F.col("rep"), F.col("slot")) % max(n, 1) + 1)
    return picked.groupBy("rep", "_i").agg(F.count("*").alias("w")).join(numbered, "_i").select("rep", cluster, "w")


def interval(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """2.5th and 97.5th percentiles of replicate values; null ones are left out."""
    p = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return (df.groupBy(*by) if by else df).agg(p[0].alias("lo"), p[1].alias("hi"), F.count(value).alias("replicates"))


def shuffled_order(seed: int, *key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)))


def stratified_split(df: DataFrame, label: str, fraction: float, seed: int, *key: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``is_test``: exactly round(fraction x size) rows of each stratum, the first
    in md5 order; a stratum of any size is numbered in ranges."""
    placed = _numbered(df.withColumn("_o", shuffled_order(seed, *key)), "_o", key, parts, (label,))
    sizes = df.groupBy(label).agg(F.bround(F.count("*") * fraction).alias("_test")).withColumnRenamed(label, "_l")
    met = placed.join(sizes, F.col(label).eqNullSafe(F.col("_l")))  # broadcast where small enough
    return met.withColumn("is_test", F.col("_n") <= F.col("_test")).drop("_n", "_o", "_l", "_test")


def permuted(df: DataFrame, column: str, seed: int, *key: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``column`` permuted over all rows: the i-th row in key order takes the value
    of the i-th row in md5 order. Both orders are numbered in ranges, not in one task."""
    h = shuffled_order(seed, *key)
    spread = F.md5(F.concat_ws(":", *(F.col(k).cast("string") for k in key)))
    left = _numbered(df.withColumn("_o", spread), "_o", key, parts)
    right = _numbered(df.select(*key, column).withColumn("_o", h), "_o", key, parts).select("_n", F.col(column).alias("_new"))
    return left.join(right, "_n").withColumn(column, F.col("_new")).drop("_n", "_new", "_o")


def numbered_by_md5(df: DataFrame, name: str, *key: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in the order of the key's md5, in ranges, not in one task."""
    h = F.md5(F.concat_ws(":", *(F.col(k).cast("string") for k in key)))
    return _numbered(df.withColumn("_o", h), "_o", key, parts).withColumnRenamed("_n", name).drop("_o")


def _numbered(df: DataFrame, order: str, key: tuple[str, ...], parts: int | None, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``_n``, the place of each row by ``order`` (an md5 string), within ``by``. The
    ranges that are numbered apart are four for each shuffle partition of the session."""
    parts = parts or min(65536, max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    part = F.floor(F.conv(F.substring(order, 1, 4), 16, 10).cast("long") * parts / 65536)
    df = df.withColumn("_p", part)
    sizes = df.groupBy(*by, "_p").agg(F.count("*").alias("_c"))
    ahead = W.partitionBy(*(by or [F.lit(0)])).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # ``parts`` rows
    before = sizes.select(*(F.col(c).alias(f"_b_{c}") for c in by), F.col("_p").alias("_q"), F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_b"))
    met = F.col("_p") == F.col("_q")
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_p").orderBy(order, *key)))
    return ranked.join(before if by else F.broadcast(before), met).withColumn("_n", F.col("_b") + F.col("_r")).drop("_p", "_r", "_b", "_q", *(f"_b_{c}" for c in by))
