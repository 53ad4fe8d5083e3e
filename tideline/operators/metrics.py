"""Scores against labels as distributed aggregates.

Running totals over a whole table never go through one task: rows are first counted by
distinct score, scores are dealt into ranges that are even in the score's logit (outside of 0 to
1 in the logarithm of its size), totals run inside each, and the ranges' offsets (some ten thousand
rows for each group) are joined back. So rare-label scores near 0 and scores of any other
scale spread too. Where the ranges lie does not change a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 1024  # for each unit of logit


def cumulative(df: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """One row per (by, score): n and positives there (``n``, ``k``) and above it (``n_above``, ``k_above``)."""
    w = F.col(weight) if weight else F.lit(1)
    by = list(by)
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.sum(w).alias("n"), F.sum(w * F.col(label)).alias("k"))
    x = F.col(score).cast("double")
    within = F.log(x / (1 - x))
    z = F.when((x > 0) & (x < 1), within).when(x <= 0, -1000 - F.log1p(-x)).otherwise(1000 + F.log1p(x - 1))
    counts = counts.withColumn("_b", F.floor(z * RANGES))
    inside = W.partitionBy(*by, "_b").orderBy(F.col(score).desc()).rowsBetween(W.unboundedPreceding, -1)
    per = counts.groupBy(*by, "_b").agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"))
    above = W.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("_b").desc()).rowsBetween(W.unboundedPreceding, -1)
    ahead = per.select(*by, "_b", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_k").over(above), F.lit(0)).alias("_k0"))
    ran = counts.withColumns({"_n1": F.coalesce(F.sum("n").over(inside), F.lit(0)), "_k1": F.coalesce(F.sum("k").over(inside), F.lit(0))})
    return ran.join(ahead, [*by, "_b"]).select(*by, score, "n", "k", (F.col("_n0") + F.col("_n1")).alias("n_above"), (F.col("_k0") + F.col("_k1")).alias("k_above"))


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by, auc, positives, n): the chance that a positive scores above a negative, ties half."""
    c = cumulative(df, score, label, by, weight)
    pairs = F.sum((F.col("n") - F.col("k")) * (F.col("k_above") + F.col("k") / 2.0))
    p, n = F.sum("k"), F.sum("n")
    out = F.try_divide(pairs, p.cast("double") * (n - p).cast("double"))
    return (c.groupBy(*by) if by else c).agg(out.alias("auc"), p.alias("positives"), n.alias("n"))


def ranking(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, auc, ap, positives, n) of ``auc`` and ``average_precision`` in one pass."""
    c = cumulative(df, score, label, by)
    pairs = F.sum((F.col("n") - F.col("k")) * (F.col("k_above") + F.col("k") / 2.0))
    p, n = F.sum("k"), F.sum("n")
    step = F.col("k") * (F.col("k_above") + F.col("k")) / (F.col("n_above") + F.col("n"))
    area = F.try_divide(pairs, p.cast("double") * (n - p).cast("double"))
    return (c.groupBy(*by) if by else c).agg(area.alias("auc"), F.try_divide(F.sum(step), p).alias("ap"), p.alias("positives"), n.alias("n"))


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, ap): precision at each distinct score, weighted by the positives there."""
    c = cumulative(df, score, label, by)
    step = F.col("k") * (F.col("k_above") + F.col("k")) / (F.col("n_above") + F.col("n"))
    return (c.groupBy(*by) if by else c).agg(F.try_divide(F.sum(step), F.sum("k")).alias("ap"))


def alert_budget(df: DataFrame, score: str, label: str, budgets: Sequence[float]) -> DataFrame:
    """By budget (share of rows that may be flagged): flagged k, threshold score, hits above
    it, ties, hits expected when ties are broken at random, and what follows from them."""
    c = cumulative(df, score, label)
    total = c.agg(F.sum("n").alias("rows"), F.sum("k").alias("pos"))
    b = df.sparkSession.createDataFrame([(float(x),) for x in budgets], "budget double").crossJoin(F.broadcast(total))  # a few rows
    b = b.withColumn("flagged", F.greatest(F.lit(1), F.bround(F.col("budget") * F.col("rows"))).cast("long"))
    at = c.join(F.broadcast(b), F.expr("n_above < flagged and n_above + n >= flagged"))
    slots = F.col("flagged") - F.col("n_above")
    hits = F.col("k_above") + slots * F.col("k") / F.col("n")
    precision = hits / F.col("flagged")
    return at.select(
        "budget", "flagged", F.col(score).alias("threshold"), F.col("k_above").alias("hits_above"), F.col("n").alias("tied"), F.col("k").alias("hits_tied"),
        hits.alias("expected_hits"), precision.alias("precision"), F.try_divide(hits, F.col("pos")).alias("recall"),
        F.try_divide(precision, F.col("pos") / F.col("rows")).alias("lift"), F.try_divide(F.lit(1.0), precision).alias("nns"),
    )


def brier(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Brier score, that of the prevalence, skill, that of zero, and observed : expected."""
    y, p = F.col(label).cast("double"), F.col(score)
    own, prevalence = F.avg((y - p) ** 2), F.avg(y)
    null = prevalence * (1 - prevalence)
    return (df.groupBy(*by) if by else df).agg(own.alias("brier"), null.alias("null_brier"), (1 - F.try_divide(own, null)).alias("skill"), F.avg(y * y).alias("zero_brier"), F.sum(y).alias("observed"), F.sum(p).alias("expected"), F.try_divide(F.sum(y), F.sum(p)).alias("oe"))


def net_benefit(df: DataFrame, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Decision curve: net benefit of the score and of treating all, by threshold. Rows are
    first counted by the highest threshold that they reach, then summed upwards."""
    ts = sorted(thresholds)
    reached = F.coalesce(*(F.when(F.col(score) >= t, F.lit(i)) for i, t in reversed(list(enumerate(ts)))), F.lit(-1))
    counts = df.groupBy(reached.alias("_i")).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("long")).alias("_k"))
    grid = df.sparkSession.createDataFrame([(i, float(t)) for i, t in enumerate(ts)], "_j int, threshold double")
    up = grid.join(F.broadcast(counts), F.expr("_i >= _j"), "left").groupBy("threshold").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_k"), F.lit(0)).alias("k"))
    whole = counts.agg(F.sum("_n").alias("rows"), F.sum("_k").alias("pos"))
    odds = F.col("threshold") / (1 - F.col("threshold"))
    model = F.col("k") / F.col("rows") - (F.col("n") - F.col("k")) / F.col("rows") * odds
    everyone = F.col("pos") / F.col("rows") - (1 - F.col("pos") / F.col("rows")) * odds
    out = up.crossJoin(F.broadcast(whole))  # one row
    return out.select("threshold", model.alias("net_benefit"), everyone.alias("treat_all"), ((model - everyone) / odds * 1000).alias("reduction_per_1000"))


def medians(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, median): the exact median, from counts by distinct value; no group is one task. Groups
    without values have no row."""
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_v"), F.lit(1).alias("_one"))
    c = cumulative(rows, "_v", "_one", by)
    size = c.groupBy(*by).agg(F.sum("n").alias("_size")) if by else c.agg(F.sum("n").alias("_size"))
    met = c.join(F.broadcast(size)) if not by else c.join(size, by)
    low, high = F.floor((F.col("_size") - 1) / 2), F.floor(F.col("_size") / 2)
    holds = lambda place: (F.col("n_above") <= place) & (place < F.col("n_above") + F.col("n"))
    met = met.where(holds(low) | holds(high))
    mid = ((F.min("_v") + F.max("_v")) / 2).alias("median")
    return met.groupBy(*by).agg(mid) if by else met.agg(mid)
