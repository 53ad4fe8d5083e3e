"""Joins with dimensions, checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import in_year_range

BROADCAST_ROWS = 1_000_000


def has_repeats(df: DataFrame, keys: Sequence[str]) -> bool:
    return df.groupBy(*keys).count().where("count > 1").limit(1).count() > 0


def join_dimension(df: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that cannot multiply rows: repeated keys in ``dim`` are an error. Small
    dimensions are broadcast after a count, others are shuffled."""
    if has_repeats(dim, keys):
        raise ValueError(f"repeated keys in the dimension: {', '.join(keys)}")
    return df.join(F.broadcast(dim) if dim.count() <= BROADCAST_ROWS else dim, list(keys), "left")


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of two tables with the same unique keys; anything else is an error."""
    for df in (left, right):
        if has_repeats(df, keys):
            raise ValueError(f"repeated keys: {', '.join(keys)}")
    if left.join(right, list(keys), "left_anti").limit(1).count():
        raise ValueError("rows without a partner")
    return left.join(right, list(keys))


def recovered_ids(df: DataFrame, id_: str, name: str) -> DataFrame:
    """``df`` with null ids filled from rows of the same name. An ambiguous name or an id
    that stays null is an error."""
    if not df.where(F.col(id_).isNull()).limit(1).count():
        return df
    known = df.where(F.col(id_).isNotNull() & F.col(name).isNotNull()).groupBy(name).agg(F.count_distinct(id_).alias("_n"), F.min(id_).alias("_id"))
    if known.where("_n > 1").limit(1).count():
        raise ValueError(f"a {name} has several ids")
    out = df.join(known.drop("_n"), name, "left").withColumn(id_, F.coalesce(id_, "_id")).drop("_id").select(*df.columns)
    if out.where(F.col(id_).isNull()).limit(1).count():
        raise ValueError(f"{id_} stays null")
    return out


def coverage(want: DataFrame, have: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Keys that are missing and keys that are extra, counted by ``by``."""
    lacks = want.join(have, list(keys), "left_anti").groupBy(by).agg(F.count("*").alias("missing"))
    more = have.join(want, list(keys), "left_anti").groupBy(by).agg(F.count("*").alias("extra"))
    return lacks.join(more, by, "full").select(by, F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("extra", F.lit(0)).alias("extra"))


def calendar_breaks(rows: DataFrame, by: Sequence[str], day: str, gap: tuple[int, int], first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """(by, resume, before): in each calendar (the days that any row of it has) the longest gap of
    ``gap`` days whose end lies from ``first`` to ``last`` (month, day), of equal ones the later."""
    days = rows.select(*by, F.col(day).alias("resume")).distinct()
    g = days.withColumn("before", F.lag("resume").over(W.partitionBy(*by).orderBy("resume"))).withColumn("_gap", F.datediff("resume", "before"))
    g = g.where(F.col("_gap").between(*gap) & in_year_range(F.col("resume"), first, last))
    ranked = g.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("_gap"), F.desc("resume"))))
    return ranked.where("_rn = 1").select(*by, "resume", "before")
