"""Point-in-time features: every frame ends before the row itself.

All columns come from two window specifications, (entity) and (entity, season); after
``repartition(entity)`` both are satisfied by one exchange. A filter on labels must follow
these windows, never precede them: an excluded row is still part of the history.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import clip

DAY = 86_400_000_000


@dataclass(frozen=True)
class PanelSpec:
    """Which columns of a panel mean what."""

    entity: str
    ts: str
    day: str
    season: str
    measures: Sequence[str] = field(default_factory=tuple)
    category: str | None = None
    categories: Sequence[str] = field(default_factory=tuple)

    def history(self) -> W:
        return W.partitionBy(self.entity).orderBy(self.ts)

    def in_season(self) -> W:
        return W.partitionBy(self.entity, self.season).orderBy(self.ts)


PAST = (W.unboundedPreceding, -1)


def lagged_mean(c: str, k: int, spec: PanelSpec) -> Column:
    return F.avg(c).over(spec.history().rowsBetween(-k, -1))


def lagged_sd(c: str, k: int, spec: PanelSpec) -> Column:
    return F.stddev_samp(c).over(spec.history().rowsBetween(-k, -1))


def season_mean(c: str, spec: PanelSpec) -> Column:
    """Mean of the season's earlier rows; null at its first."""
    return F.avg(c).over(spec.in_season().rowsBetween(*PAST))


def season_sum(c: str, spec: PanelSpec) -> Column:
    return F.coalesce(F.sum(c).over(spec.in_season().rowsBetween(*PAST)), F.lit(0))


def concurrent_mean(c: str, k: int, spec: PanelSpec) -> Column:
    """Reads the row itself; for association only."""
    return F.avg(c).over(spec.history().rowsBetween(1 - k, 0))


def rest_days(spec: PanelSpec) -> Column:
    """Calendar days since the season's previous row; null at its first."""
    return F.datediff(spec.day, F.lag(spec.day).over(spec.in_season()))


def trailing_count(days: int, spec: PanelSpec) -> Column:
    """Rows in the ``days`` x 24 hours before this one, itself excluded."""
    w = W.partitionBy(spec.entity).orderBy(F.unix_micros(F.col(spec.ts).cast("timestamp"))).rangeBetween(1 - days * DAY, -1)
    return F.count(F.lit(1)).over(w)


def ordinal(w: W) -> Column:
    """How many rows came before."""
    return (F.row_number().over(w) - 1).cast("long")


def lagged_flag(flag: Column, spec: PanelSpec) -> Column:
    return F.coalesce(F.lag(flag.cast("int")).over(spec.history()), F.lit(0))


def prior_mode(spec: PanelSpec, default: str = "U") -> Column:
    """The commonest category of earlier rows; ties go to the first declared one."""
    counts = [F.coalesce(F.sum((F.col(spec.category) == v).cast("long")).over(spec.history().rowsBetween(*PAST)), F.lit(0)) for v in spec.categories]
    top = F.greatest(*counts)
    out = F.lit(None).cast("string")
    for n, v in reversed(list(zip(counts, spec.categories, strict=True))):
        out = F.when(n == top, F.lit(v)).otherwise(out)
    return F.when(top > 0, out).otherwise(F.lit(default))


def forward_fill(c: str, spec: PanelSpec) -> Column:
    return F.last(c, ignorenulls=True).over(spec.history().rowsBetween(W.unboundedPreceding, 0))


def build_features(panel: DataFrame, spec: PanelSpec, clip_rest: int = 30) -> DataFrame:
    """``panel`` with lag, rolling, season and schedule features, in one pass."""
    m: dict[str, Column] = {}
    for c in spec.measures:
        m |= {f"{c}_r{k}": lagged_mean(c, k, spec) for k in (3, 5, 10)}
        m |= {f"{c}_sd5": lagged_sd(c, 5, spec), f"{c}_std": season_mean(c, spec)}
    rest = rest_days(spec)
    m |= {
        "rest_days": clip(rest, high=clip_rest),
        "is_opener": rest.isNull().cast("int"),
        "is_back_to_back": F.coalesce((rest == 1).cast("int"), F.lit(0)),
        "rows_7d": trailing_count(7, spec),
        "rows_14d": trailing_count(14, spec),
        "panel_rows": ordinal(spec.history()),
        "season_rows": ordinal(spec.in_season()),
    }
    if spec.category:
        m["prior_mode"] = prior_mode(spec)
    out = panel.repartition(spec.entity).select("*", *(x.alias(n) for n, x in m.items()))
    return out.select("*", *((F.col(f"{c}_r5") / (F.abs(f"{c}_std") + 1e-3)).alias(f"{c}_acr") for c in spec.measures))


def sorted_features(panel: DataFrame, spec: PanelSpec, at: str) -> DataFrame:
    """``panel`` with the features of ``build_features`` and the category's, all from windows over (entity, ``at``: microseconds), so
    that a panel published in that order needs no exchange and no sort. Seasons must not go back in time:
    what is of a season is what has run up since its first row, a difference of two running totals (exact
    for whole numbers, to rounding for others)."""
    w = W.partitionBy(spec.entity).orderBy(at)
    past, upto = w.rowsBetween(*PAST), w.rowsBetween(W.unboundedPreceding, 0)
    same = F.col(spec.season).eqNullSafe(F.lag(spec.season).over(w)) & (F.row_number().over(w) > 1)
    m: dict[str, Column] = {"_same": same, "_before": ordinal(w), "_rest": F.when(same, F.datediff(spec.day, F.lag(spec.day).over(w)))}
    for c in spec.measures:
        m |= {f"{c}_r{k}": F.avg(c).over(w.rowsBetween(-k, -1)) for k in (3, 5, 10)} | {f"{c}_sd5": F.stddev_samp(c).over(w.rowsBetween(-5, -1))}
        m |= {f"_sum_{c}": F.coalesce(F.sum(c).over(past), F.lit(0)), f"_n_{c}": F.count(c).over(past)}
    m |= {f"rows_{k}d": F.count(F.lit(1)).over(w.rangeBetween(1 - k * DAY, -1)) for k in (7, 14)}
    if spec.category:
        m |= {f"_of_{k}": F.coalesce(F.sum((F.col(spec.category) == v).cast("long")).over(past), F.lit(0)) for k, v in enumerate(spec.categories)}
        m |= {f"{spec.category}_ff": F.last(spec.category, ignorenulls=True).over(upto), f"had_{spec.category}": F.coalesce(F.lag(F.col(spec.category).isNotNull().cast("int")).over(w), F.lit(0))}
    ran = panel.select("*", *(x.alias(n) for n, x in m.items()))
    start = lambda c: F.last(F.when(~F.col("_same"), F.col(c)), ignorenulls=True).over(upto)  # noqa: E731  as it was at the season's first row
    out = ran.select("*", start("_before").alias("_start"), *(start(f"_{k}_{c}").alias(f"_start_{k}_{c}") for c in spec.measures for k in ("sum", "n")))
    rest = F.col("_rest")
    made: dict[str, Column] = {
        "rest_days": clip(rest, high=30), "is_opener": rest.isNull().cast("int"), "is_back_to_back": F.coalesce((rest == 1).cast("int"), F.lit(0)),
        "panel_rows": F.col("_before"), "season_rows": F.col("_before") - F.col("_start"),
    }
    for c in spec.measures:
        made[f"{c}_season"] = F.col(f"_sum_{c}") - F.col(f"_start_sum_{c}")
        made[f"{c}_std"] = F.try_divide(made[f"{c}_season"], F.col(f"_n_{c}") - F.col(f"_start_n_{c}"))
        made[f"{c}_acr"] = F.col(f"{c}_r5") / (F.abs(made[f"{c}_std"]) + 1e-3)
    if spec.category:
        top, mode = F.greatest(*(F.col(f"_of_{k}") for k in range(len(spec.categories)))), F.lit(None).cast("string")
        for k, v in reversed(list(enumerate(spec.categories))):
            mode = F.when(F.col(f"_of_{k}") == top, F.lit(v)).otherwise(mode)
        made["prior_mode"] = F.when(top > 0, mode).otherwise(F.lit("U"))
    return out.select(*panel.columns, *(n for n in m if not n.startswith("_")), *(x.alias(n) for n, x in made.items()))
