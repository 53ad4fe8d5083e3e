"""Rates, intervals and ratios by stratum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import rate, risk_ratio, wilson


def rates(df: DataFrame, label: str, by: Sequence[str | Column]) -> DataFrame:
    """(by, n, k, rate, lo, hi) with Wilson intervals."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return g.withColumns({"rate": rate(F.col("k"), F.col("n")), "lo": lo, "hi": hi})


def rates_all_bins(df: DataFrame, label: str, bin_: str, labels: Sequence[str]) -> DataFrame:
    """As ``rates``, with a row for every declared bin, also an empty one."""
    bins = df.sparkSession.createDataFrame([(x,) for x in labels], f"{bin_} string")
    counts = df.groupBy(bin_).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("k"))
    out = bins.join(counts, bin_, "left").select(bin_, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return out.withColumns({"rate": rate(F.col("k"), F.col("n")), "lo": lo, "hi": hi})


def ratio_by(df: DataFrame, label: str, exposed: Column, by: Sequence[str]) -> DataFrame:
    """Exposed against unexposed rows in each stratum: counts, risk ratio, interval."""
    y = F.col(label).cast("long")
    n = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0))
    one = F.lit(1).cast("long")
    g = df.where(exposed.isNotNull())
    g = (g.groupBy(*by) if by else g).agg(n(exposed, one).alias("n1"), n(exposed, y).alias("k1"), n(~exposed, one).alias("n0"), n(~exposed, y).alias("k0"))
    rr, lo, hi = risk_ratio(F.col("k1"), F.col("n1"), F.col("k0"), F.col("n0"))
    return g.withColumns({"rr": rr, "lo": lo, "hi": hi})


def distinct_bitmaps(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """Which values of ``number`` (whole numbers from 0, best without large gaps) each group has, as bitmaps: a row for
    each group and 32,768 numbers. Bitmaps of groups merge, so coarser levels need no second look at the rows."""
    bucket = F.bitmap_bucket_number(number).alias("bucket")
    return df.where(F.col(number).isNotNull()).groupBy(*by, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bitmap"))


def distinct_counts(bitmaps: DataFrame, by: list[str], name: str) -> DataFrame:
    """Exact distinct numbers by the columns ``by``, some or none of those of ``distinct_bitmaps``."""
    merged = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("_m"))
    count = F.coalesce(F.sum(F.bitmap_count("_m")), F.lit(0)).alias(name)
    return merged.groupBy(*by).agg(count) if by else merged.agg(count)
