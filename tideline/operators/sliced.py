"""Running values of very large groups: a scan in two levels.

A window over a group is one task, however many rows the group has. Here the order axis is cut
at quantiles of all rows, so that no group has more than a slice's share of the table in one slice,
however its rows lie. Each (group, slice) is a window of its own; slices are summed, the sums run over
the slices of a group (at most as many rows as there are slices), and what came before a slice is
carried back into it. Rows that tie on the axis are in one slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written
from .asof import _day, _tagged

ACCURACY = 100_000


def slices_of(df: DataFrame) -> int:
    """Four for each shuffle partition of the session, from 64 to 1,024."""
    return min(1024, max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def cut_points(df: DataFrame, axis: Column, slices: int) -> list:
    """Values that cut all rows into about ``slices`` equal parts; fewer where values repeat."""
    shares = [k / slices for k in range(1, slices)]
    got = df.agg(F.percentile_approx(axis, shares, ACCURACY).alias("cuts")).first()["cuts"]
    return sorted(set(got or []))


def slice_number(axis: Column, cuts: Sequence) -> Column:
    """How many cuts are below ``axis``: a search tree of conditions. Null is in slice 0."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(axis > F.lit(cuts[mid]), tree(mid + 1, high)).otherwise(tree(low, mid))

    return tree(0, len(cuts))


class Running:
    """One running value: ``sum`` (nothing: 0), ``count`` of non-null values, ``max``, or ``last`` non-null value."""

    def __init__(self, kind: str, value: Column, inclusive: bool = False):
        self.kind, self.value, self.inclusive = kind, value, inclusive

    def inside(self, frame: W) -> Column:
        return {"sum": F.sum, "count": F.count, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[self.kind](self.value).over(frame)

    def total(self, order: str) -> Column:
        if self.kind == "last":
            return F.max_by(F.when(self.value.isNotNull(), self.value), F.when(self.value.isNotNull(), F.col(order)))
        return {"sum": F.sum, "count": F.count, "max": F.max}[self.kind](self.value)

    def carried(self, total: str, ahead: W) -> Column:
        return {"sum": F.sum, "count": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[self.kind](total).over(ahead)

    def joined(self, before: Column, inside: Column) -> Column:
        if self.kind == "last":
            return F.coalesce(inside, before)
        if self.kind == "max":
            return F.greatest(before, inside)
        return F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0))


def running(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Running], slices: int | None = None, ties: bool = False) -> DataFrame:
    """``df`` with ``values`` by ``keys`` over the rows before each in ``order`` (a column of whole numbers or
    times), with the row itself where inclusive. ``ties``: rows of equal order count as one moment: all of
    them are before, or none (``order`` must be numbers then). Null keys are a group, as in a window."""
    keys = list(keys)
    df = written(df, "running")  # read for the cuts, the totals and the rows; a chain of scans would work it out three times as often with each
    cuts = cut_points(df, F.col(order), slices or slices_of(df))
    cut = df.withColumn("_slice", slice_number(F.col(order), cuts))
    ahead = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_slice").agg(*(v.total(order).alias(f"_t_{n}") for n, v in values.items()))
    before = totals.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_slice").alias("_s"), *(v.carried(f"_t_{n}", ahead).alias(f"_b_{n}") for n, v in values.items()))
    met = F.col("_slice") == F.col("_s")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    w = W.partitionBy(*keys, "_slice").orderBy(order)
    frame = lambda v: (w.rangeBetween if ties else w.rowsBetween)(W.unboundedPreceding, 0 if v.inclusive else -1)
    inner = cut.select("*", *(v.inside(frame(v)).alias(f"_i_{n}") for n, v in values.items()))
    return inner.join(before, met).select(*df.columns, *(v.joined(F.col(f"_b_{n}"), F.col(f"_i_{n}")).alias(n) for n, v in values.items()))


def previous_day(rows: DataFrame, events: DataFrame, keys: Sequence[str], day: str, event_day: str, name: str = "prev_day", slices: int | None = None) -> DataFrame:
    """``asof.previous_day`` for groups of any size."""
    both = running(_tagged(rows, events, keys, day, event_day), keys, "_d", {"_last": Running("max", F.when(F.col("_tag") == 1, F.col("_d")))}, slices, ties=True)
    return both.where("_tag = 0").select(*rows.columns, _day(F.col("_last")).alias(name))


def count_until(rows: DataFrame, events: DataFrame, keys: Sequence[str], day: str, event_day: str, name: str, inclusive: bool = False, slices: int | None = None) -> DataFrame:
    """``asof.count_until`` for groups of any size."""
    both = running(_tagged(rows, events, keys, day, event_day), keys, "_d", {"_hits": Running("sum", (F.col("_tag") == 1).cast("long"), inclusive)}, slices, ties=True)
    return both.where("_tag = 0").select(*rows.columns, F.when(F.col(day).isNotNull(), F.col("_hits")).alias(name))


def between_counts(rows: DataFrame, events: DataFrame, keys: Sequence[str], low: str, high: str, event_day: str, name: str = "n_between", slices: int | None = None) -> DataFrame:
    """``asof.between_counts`` for groups of any size."""
    days = events.select(*keys, event_day).distinct()
    out = count_until(rows, days, keys, low, event_day, "_upto", True, slices)
    out = count_until(out, days, keys, high, event_day, "_below", False, slices)
    both = F.col("_upto").isNotNull() & F.col("_below").isNotNull()
    return out.select(*rows.columns, F.when(both, F.greatest(F.col("_below") - F.col("_upto"), F.lit(0))).alias(name))


def history(rows: DataFrame, events: DataFrame, keys: Sequence[str], day: str, event_day: str, recent: int = 365, slices: int | None = None) -> DataFrame:
    """``asof.history`` for groups of any size; recent events are those before the day less those
    before the day ``recent`` days earlier."""
    both = _tagged(rows, events, keys, day, event_day)
    values = {"n_before": Running("sum", (F.col("_tag") == 1).cast("long")), "_last": Running("max", F.when(F.col("_tag") == 1, F.col("_d")))}
    out = running(both, keys, "_d", values, slices, ties=True).where("_tag = 0").select(*rows.columns, "n_before", "_last")
    out = count_until(out.withColumn("_from", F.date_sub(day, recent)), events, keys, "_from", event_day, "_old", False, slices)
    known = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(*rows.columns, "n_before", (F.col("n_before") - known("_old")).alias("n_recent"), _day(F.col("_last")).alias("last_day"))


def season_totals(panel: DataFrame, keys: Sequence[str], at: str, measure: str, slices: int | None = None) -> DataFrame:
    """``panel`` with the sum (nothing: 0) and the mean (nothing: null) of ``measure`` over the earlier rows of the keys."""
    out = running(panel, keys, at, {"season_sum": Running("sum", F.col(measure)), "_n": Running("count", F.col(measure))}, slices)
    return out.select(*panel.columns, "season_sum", F.try_divide("season_sum", "_n").alias("season_mean"))


def forward_filled(panel: DataFrame, keys: Sequence[str], at: str, column: str, name: str, slices: int | None = None) -> DataFrame:
    """``panel`` with the last non-null value of ``column`` up to each row."""
    return running(panel, keys, at, {name: Running("last", F.col(column), inclusive=True)}, slices)
