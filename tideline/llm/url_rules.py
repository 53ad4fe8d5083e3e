"""URL filters: a sorted sweep of canonical keys over nested rule intervals.

A host is written with its labels reversed and each followed by a dot (``a.example.com`` ->
``com.example.a.``), so that a rule's host covers exactly the keys from its own key K up to
K followed by the highest character. Such intervals lie within each other or apart: going
through their ends in order, the rules that hold form a stack. The stack after each end is
worked out once; URLs are then merged with the ends in key order, and each takes the stack
of the last end before it. Rules of the stack whose path starts the URL's path fit; the
longest (host and path together, then host) decides.

The sweep runs in lanes, each a sorted run of its own. Rows are dealt to lanes by a hash of the
row and of the partition that it was read in, so that a host, or one row repeated very often,
spreads evenly, and a task that runs again deals alike; the number of lanes follows the number of rows (``LANE`` in each). The ends, two for each
host of the rule list, are copied to each lane. Only DataFrame functions are used.

Results: a row per row of the input. A url that is null, empty or has no ``://`` has an empty
host and path and no rule fits it; a url of any length is judged whole. Repeated rows, rows
without page_id and further columns, whatever their names, do not matter. Of rules of one length
the one with the longer host decides, of rules listed twice block wins. Without a fitting rule the
verdict is ``default``. An empty table or an empty rule list is no error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RULE = "struct<host:string,path:string,verdict:string>"
#: Above every character that a host can hold.
HIGH = "\U0010ffff"
LANE = 100_000  # rows
LEAST_LANES = 64


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``rules``: (verdict, host, path)."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def ends(rules: DataFrame) -> DataFrame:
    """(key, stack): the rules that hold from this key on, for every begin and end of a
    rule host's interval."""
    hosts = rules.where("host is not null and path is not null").groupBy("host").agg(F.collect_set(F.struct("host", "path", "verdict")).cast(f"array<{RULE}>").alias("own"))
    hosts = hosts.withColumn("key", key_of(F.col("host")))
    # rules of a host and of the hosts above it: one row for each label, joined by equality
    above = hosts.select("key", F.explode(F.sequence(F.lit(1), F.size(F.split("host", r"\.")))).alias("n"))
    above = above.select("key", F.expr("concat(substring_index(key, '.', n), '.')").alias("at"), "n")
    held = above.join(hosts.select(F.col("key").alias("at"), "own"), "at")
    stacks = held.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "own"))).alias("s"), F.max(F.when(F.col("at") == F.col("key"), None).otherwise(F.struct("n", "at"))).alias("up"))
    stacks = stacks.select("key", F.flatten(F.transform("s", lambda x: x["own"])).alias("stack"), F.col("up.at").alias("up"))
    after = stacks.select(F.col("key").alias("up"), F.col("stack").alias("outer"))
    closed = stacks.join(after, "up", "left").select(F.concat("key", F.lit(HIGH)).alias("key"), F.coalesce("outer", F.array().cast(f"array<{RULE}>")).alias("stack"))
    return stacks.select("key", "stack").unionByName(closed)


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", lanes: int | None = None) -> DataFrame:
    """page_id, url, host, path, rule (host and path), verdict for each row of ``pages``."""
    lanes = lanes or max(LEAST_LANES, pages.count() // LANE)
    urls = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    lane = F.pmod(F.xxhash64("page_id", "url", F.spark_partition_id()), F.lit(lanes)).cast("int").alias("lane")
    urls = urls.select("*", key_of(F.col("host")).alias("key"), lane, F.lit(1).alias("is_url"))
    bounds = ends(rules).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("is_url", F.lit(0))
    order = W.partitionBy("lane").orderBy("key", "is_url").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = bounds.unionByName(urls, allowMissingColumns=True).withColumn("stack", F.last("stack", ignorenulls=True).over(order)).where("is_url = 1")
    fit = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    # the longest: rules of one host and path agree unless listed twice; then block wins
    rank = F.transform(fit, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("n"), F.length(r["host"]).alias("h"), r["verdict"].alias("verdict"), F.concat(r["host"], r["path"]).alias("rule")))
    best = F.when(F.col("host") != "", F.array_max(rank))
    return swept.withColumn("best", best).select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
