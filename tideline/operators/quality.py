"""Source validity, reconciliation and invariants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import draw


def row_digest(id_: Column) -> Column:
    """Which rows a cell has, in whatever order and number: sum and xor of md5 draws. Partial
    aggregation keeps a cell of any size to one row per task."""
    h = draw(id_)
    return F.concat_ws(":", F.sum(h).cast("string"), F.bit_xor(h).cast("string"))


def contradictions(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str], id_: str) -> DataFrame:
    """(pair, by, n, digest): rows whose count is positive while the share derived from it is
    zero."""
    hits = F.array(*(F.when((F.col(a) > 0) & (F.col(b) == 0), F.lit(f"{a}/{b}")) for a, b in pairs))
    long = df.select(*by, id_, F.explode(F.array_compact(hits)).alias("pair"))
    return long.groupBy("pair", *by).agg(F.count("*").alias("n"), row_digest(F.col(id_)).alias("digest"))


def against_ledger(observed: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, state) of each cell that is observed or on the ledger."""
    known = ledger.select(*keys, F.col("n").alias("_n"), F.col("digest").alias("_digest"))
    state = F.when(F.col("_n").isNull(), "unexpected").when(F.col("n").isNull(), "disappeared").when(F.col("n") != F.col("_n"), "count changed").when(F.col("digest") != F.col("_digest"), "other rows").otherwise("known")
    return observed.join(known, list(keys), "full").select(*keys, state.alias("state"))


def cardinality(df: DataFrame, group: str, member: str, expected: int) -> DataFrame:
    """Groups without exactly ``expected`` rows of distinct members."""
    g = df.groupBy(group).agg(F.count("*").alias("n_rows"), F.count_distinct(member).alias("n_distinct"))
    return g.where((F.col("n_rows") != expected) | (F.col("n_distinct") != F.col("n_rows")))


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations) in one pass; a rule is a condition that no row may meet."""
    names = list(rules)
    one = df.agg(*(F.count(F.when(rules[n], 1)).alias(f"_{i}") for i, n in enumerate(names)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"_{i}").alias("violations")) for i, n in enumerate(names)))).alias("x")).select("x.*")


def same_count(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.agg(F.count("*").alias("before")), after.agg(F.count("*").alias("after"))
    return a.join(F.broadcast(b)).select("before", "after", (F.col("before") == F.col("after")).alias("kept"))  # one row each


def vocabulary(df: DataFrame, column: str, declared: Sequence[str]) -> DataFrame:
    """Values that are not declared, and declared ones that do not occur."""
    seen = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    said = df.sparkSession.createDataFrame([(v,) for v in declared], "value string")
    lacking = said.join(seen, "value", "left_anti").withColumn("state", F.lit("not seen"))
    return seen.join(said, "value", "left_anti").withColumn("state", F.lit("not declared")).unionByName(lacking)


def anchored(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """(keys, equal): whether a stored number is met within ``tolerance``."""
    both = recomputed.join(stored.select(*keys, F.col(value).alias("_stored")), list(keys))
    return both.select(*keys, (F.abs(F.col(value) - F.col("_stored")) <= tolerance).alias("equal"))


def with_faults(df: DataFrame, column: str, value, where: Column) -> DataFrame:
    """``df`` with ``column`` overwritten where ``where`` holds: to see a guard fail."""
    return df.withColumn(column, F.when(where, F.lit(value)).otherwise(F.col(column)))
