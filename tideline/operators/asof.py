"""As-of lookups by union and window: one shuffle, no pairs of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _tagged(rows: DataFrame, events: DataFrame, keys: Sequence[str], day: str, event_day: str) -> DataFrame:
    """Rows (tag 0) and events (tag 1) on one axis ``_d`` of day numbers."""
    number = lambda c: F.unix_date(F.to_date(F.col(c))).cast("long").alias("_d")
    left = rows.select("*", number(day), F.lit(0).alias("_tag"))
    right = events.select(*keys, number(event_day), F.lit(1).alias("_tag"))
    return left.unionByName(right, allowMissingColumns=True)


def _day(n: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), n.cast("int"))


def previous_day(rows: DataFrame, events: DataFrame, keys: Sequence[str], day: str, event_day: str, name: str = "prev_day") -> DataFrame:
    """``rows`` with the last event day strictly before each row's day."""
    both = _tagged(rows, events, keys, day, event_day)
    w = W.partitionBy(*keys).orderBy("_d").rangeBetween(W.unboundedPreceding, -1)
    return both.withColumn(name, _day(F.max(F.when(F.col("_tag") == 1, F.col("_d"))).over(w))).where("_tag = 0").drop("_d", "_tag")


def history(rows: DataFrame, events: DataFrame, keys: Sequence[str], day: str, event_day: str, recent: int = 365) -> DataFrame:
    """``rows`` with the events strictly before the row's day: how many, how many within
    ``recent`` days, and the last one's day."""
    both = _tagged(rows, events, keys, day, event_day)
    w = W.partitionBy(*keys).orderBy("_d")
    hit, past = F.col("_tag") == 1, w.rangeBetween(W.unboundedPreceding, -1)
    both = both.withColumns({
        "n_before": F.coalesce(F.sum(hit.cast("long")).over(past), F.lit(0)),
        "n_recent": F.coalesce(F.sum(hit.cast("long")).over(w.rangeBetween(-recent, -1)), F.lit(0)),
        "last_day": _day(F.max(F.when(hit, F.col("_d"))).over(past)),
    })
    return both.where("_tag = 0").drop("_d", "_tag")


def count_until(rows: DataFrame, events: DataFrame, keys: Sequence[str], day: str, event_day: str, name: str, inclusive: bool = False) -> DataFrame:
    """``rows`` with the number of events before (or up to) each row's day; null without day."""
    both = _tagged(rows, events, keys, day, event_day)
    w = W.partitionBy(*keys).orderBy("_d").rangeBetween(W.unboundedPreceding, 0 if inclusive else -1)
    n = F.coalesce(F.sum((F.col("_tag") == 1).cast("long")).over(w), F.lit(0))
    return both.withColumn(name, F.when(F.col(day).isNotNull(), n)).where("_tag = 0").drop("_d", "_tag")


def between_counts(rows: DataFrame, events: DataFrame, keys: Sequence[str], low: str, high: str, event_day: str, name: str = "n_between") -> DataFrame:
    """``rows`` with the number of distinct event days strictly between two of a row's days."""
    days = events.select(*keys, event_day).distinct()
    out = count_until(rows, days, keys, low, event_day, "_upto", inclusive=True)
    out = count_until(out, days, keys, high, event_day, "_below")
    return out.withColumn(name, F.when(F.col("_upto").isNotNull() & F.col("_below").isNotNull(), F.greatest(F.col("_below") - F.col("_upto"), F.lit(0)))).drop("_upto", "_below")
