"""Scalar column expressions; null in, null out unless said otherwise."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(x: Column) -> Column:
    """Round to six decimals, halves up, in a way that engines agree on."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def season_of(date: Column, first_month: int = 10) -> Column:
    """The year in which the season of a date began."""
    return F.when(F.month(date) >= first_month, F.year(date)).otherwise(F.year(date) - 1)


def season_label(season: Column) -> Column:
    """2019 -> 2019-20."""
    return F.concat(season.cast("string"), F.lit("-"), F.lpad(((season + 1) % 100).cast("string"), 2, "0"))


def is_true(predicate: Column) -> Column:
    """Null counts as false, so that negating keeps unknown rows."""
    return F.coalesce(predicate, F.lit(False))


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def to_number(x: Column) -> Column:
    """What does not parse becomes null."""
    return finite(x.try_cast("double"))


def to_time(x: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(x), F.try_to_timestamp(x, F.lit("MM/dd/yyyy")))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip without turning null into a bound."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def right_closed(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the interval (a, b] that holds ``x``; null outside all."""
    out = None
    for a, b, label in zip(edges[:-1], edges[1:], labels, strict=True):
        inside = (x > a) & (x <= b)
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def one_hot(x: Column, values: Iterable[str], prefix: str) -> list[Column]:
    """A 0/1 column for every declared value; an undeclared or null one has zeros only."""
    return [F.coalesce((x == v).cast("int"), F.lit(0)).alias(f"{prefix}{v}") for v in values]


def one_hot_decode(values: Iterable[str], prefix: str, default: str | None = None) -> Column:
    out = F.lit(default)
    for v in reversed(list(values)):
        out = F.when(F.col(f"{prefix}{v}") == 1, F.lit(v)).otherwise(out)
    return out


def logit(p: Column, edge: float = 1e-6) -> Column:
    q = clip(p, edge, 1 - edge)
    return F.log(q / (1 - q))


def day_gap(later: Column, earlier: Column) -> Column:
    """Calendar days between two times."""
    return F.datediff(F.to_date(later), F.to_date(earlier))


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole days of elapsed time, rounded down: the contrast to ``day_gap``."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000)).cast("int")


def in_year_range(date: Column, first: tuple[int, int], last: tuple[int, int]) -> Column:
    """Whether a date lies between two (month, day) of its own year."""
    return date.between(F.make_date(F.year(date), F.lit(first[0]), F.lit(first[1])), F.make_date(F.year(date), F.lit(last[0]), F.lit(last[1])))


def differs(a: Column, b: Column) -> Column:
    """Exact inequality in which two nulls are equal."""
    return ~a.eqNullSafe(b)


def rate(k: Column, n: Column) -> Column:
    return F.try_divide(k.cast("double"), n.cast("double"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson score interval of k successes in n; null where n is 0."""
    p = rate(k, n)
    nn = F.when(n > 0, n.cast("double"))
    middle = (p + z * z / (2 * nn)) / (1 + z * z / nn)
    half = z * F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn)) / (1 + z * z / nn)
    return middle - half, middle + half


def risk_ratio(k1: Column, n1: Column, k0: Column, n0: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """Ratio of two rates and its interval on the log scale; null where a cell is empty."""
    ok = (k1 > 0) & (k0 > 0) & (n1 > 0) & (n0 > 0)
    a, b, c, d = (F.when(ok, x.cast("double")) for x in (k1, n1, k0, n0))
    rr = (a / b) / (c / d)
    half = z * F.sqrt(1 / a - 1 / b + 1 / c - 1 / d)
    return rr, F.exp(F.log(rr) - half), F.exp(F.log(rr) + half)


def auc_error(auc: Column, positives: Column, negatives: Column) -> Column:
    """Standard error of an AUC from its value and the class sizes."""
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    return F.sqrt((auc * (1 - auc) + (positives - 1) * (q1 - auc * auc) + (negatives - 1) * (q2 - auc * auc)) / (positives * negatives))


def direction(observed: Column, expected: Column) -> Column:
    return F.when(observed > expected, "under-predicts").when(observed < expected, "over-predicts").otherwise("equal")


def draw(*parts: Column) -> Column:
    """A number below 2^32 from md5, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")
