"""Queries on point-in-time features (panel of events)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import clip, r6
from ..operators import asof
from ..operators import features as X
from ..operators import sliced
from ..operators.rates import rates
from ..sources import scratch, sinks
from .registry import ORACLES, query
from .views import E_CTE, ROLES, SPEC, appearances, labels, outcome_cte, outcomes, sql6, sql_wilson

KEY = ("user_id", "day")
H = "OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN {} AND {})"
S = "OVER (PARTITION BY user_id, season ORDER BY ts ROWS BETWEEN {} AND {})"
PAST = ("UNBOUNDED PRECEDING", "1 PRECEDING")


def on_panel(select: str) -> str:
    return f"WITH {E_CTE} SELECT user_id, day, {select} FROM app"


def back(k: int) -> str:
    return H.format(f"{k} PRECEDING", "1 PRECEDING")


@query("w01_lag", on_panel("lag(cents) OVER (PARTITION BY user_id ORDER BY ts) AS prev_cents"))
def w01(spark, d):
    return appearances(spark, d).select(*KEY, F.lag("cents").over(SPEC.history()).alias("prev_cents"))


@query("w02_lagged_rolling_mean", on_panel(", ".join(f"{sql6(f'avg(cents) {back(k)}')} AS r{k}" for k in (3, 5, 10))))
def w02(spark, d):
    return appearances(spark, d).select(*KEY, *(r6(X.lagged_mean("cents", k, SPEC)).alias(f"r{k}") for k in (3, 5, 10)))


@query("w03_lagged_rolling_sd", on_panel(f"round(stddev_samp(n) {back(5)}, 4) AS sd5"))
def w03(spark, d):
    return appearances(spark, d).select(*KEY, F.round(X.lagged_sd("n", 5, SPEC), 4).alias("sd5"))


@query("w04_season_to_date_mean", on_panel(f"{sql6(f'avg(cents) {S.format(*PAST)}')} AS std"))
def w04(spark, d):
    return appearances(spark, d).select(*KEY, r6(X.season_mean("cents", SPEC)).alias("std"))


@query("w05_concurrent_mean", on_panel(f"{sql6('avg(cents) ' + H.format('4 PRECEDING', 'CURRENT ROW'))} AS c5, cents AS c1"))
def w05(spark, d):
    return appearances(spark, d).select(*KEY, r6(X.concurrent_mean("cents", 5, SPEC)).alias("c5"), F.col("cents").alias("c1"))


@query("w06_acute_chronic_ratio", f"WITH {E_CTE}, x AS (SELECT user_id, day, avg(cents) {back(5)} AS r5, avg(cents) {S.format(*PAST)} AS std FROM app) SELECT user_id, day, {sql6('r5 / (abs(std) + 1e-3)')} AS acr FROM x")
def w06(spark, d):
    x = appearances(spark, d).select(*KEY, X.lagged_mean("cents", 5, SPEC).alias("r5"), X.season_mean("cents", SPEC).alias("std"))
    return x.select(*KEY, r6(F.col("r5") / (F.abs("std") + 1e-3)).alias("acr"))


REST = "date_diff('day', lag(day) OVER (PARTITION BY user_id, season ORDER BY ts), day)"


@query("w07_rest_days", on_panel(f"CAST(CASE WHEN {REST} IS NOT NULL THEN least({REST}, 3) END AS INTEGER) AS rest_days"))
def w07(spark, d):
    return appearances(spark, d).select(*KEY, clip(X.rest_days(SPEC), high=3).alias("rest_days"))


@query("w08_opener_flags", on_panel(f"CAST({REST} IS NULL AS INTEGER) AS is_opener, CAST(coalesce({REST} = 1, false) AS INTEGER) AS b2b"))
def w08(spark, d):
    rest = X.rest_days(SPEC)
    return appearances(spark, d).select(*KEY, rest.isNull().cast("int").alias("is_opener"), F.coalesce((rest == 1).cast("int"), F.lit(0)).alias("b2b"))


def trailing(days: int) -> str:
    return f"(SELECT count(*) FROM app b WHERE b.user_id = a.user_id AND b.ts < a.ts AND epoch_us(b.ts) > epoch_us(a.ts) - {days} * 86400000000)"


@query("w09_trailing_counts", f"WITH {E_CTE} SELECT user_id, day, {trailing(7)} AS rows_7d, {trailing(14)} AS rows_14d FROM app a")
def w09(spark, d):
    return appearances(spark, d).select(*KEY, X.trailing_count(7, SPEC).alias("rows_7d"), X.trailing_count(14, SPEC).alias("rows_14d"))


@query("w10_ordinals", on_panel("row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS panel_rows, row_number() OVER (PARTITION BY user_id, season ORDER BY ts) - 1 AS season_rows"))
def w10(spark, d):
    return appearances(spark, d).select(*KEY, X.ordinal(SPEC.history()).alias("panel_rows"), X.ordinal(SPEC.in_season()).alias("season_rows"))


@query("w11_lagged_flag", on_panel("coalesce(lag(CAST(role IS NOT NULL AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts), 0) AS had_role"))
def w11(spark, d):
    return appearances(spark, d).select(*KEY, X.lagged_flag(F.col("role").isNotNull(), SPEC).alias("had_role"))


@query(
    "w12_prior_mode",
    f"""WITH {E_CTE}, c AS (SELECT a.user_id, a.day, sum((b.role = 'click')::INT) AS c, sum((b.role = 'view')::INT) AS v, sum((b.role = 'purchase')::INT) AS p
 FROM app a LEFT JOIN app b ON a.user_id = b.user_id AND b.ts < a.ts GROUP BY ALL)
 SELECT user_id, day, CASE WHEN coalesce(greatest(c, v, p), 0) = 0 THEN 'U' WHEN c = greatest(c, v, p) THEN 'click' WHEN v = greatest(c, v, p) THEN 'view' ELSE 'purchase' END AS prior_mode FROM c""",
)
def w12(spark, d):
    return appearances(spark, d).select(*KEY, X.prior_mode(SPEC).alias("prior_mode"))


@query("w13_season_sum", on_panel(f"CAST(coalesce(sum(cents) {S.format(*PAST)}, 0) AS BIGINT) AS season_cents"))
def w13(spark, d):
    return appearances(spark, d).select(*KEY, X.season_sum("cents", SPEC).alias("season_cents"))


@query("w14_forward_fill", on_panel(f"last_value(role IGNORE NULLS) {H.format('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS role_ff"))
def w14(spark, d):
    return appearances(spark, d).select(*KEY, X.forward_fill("role", SPEC).alias("role_ff"))


@query(
    "w15_workload_spike",
    f"""WITH {E_CTE}, x AS (SELECT user_id, day, avg(cents) {H.format('4 PRECEDING', 'CURRENT ROW')} AS acute, avg(cents) {H.format('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS chronic FROM app)
 SELECT user_id, day, {sql6('acute')} AS acute, {sql6('chronic')} AS chronic, {sql6('acute / nullif(chronic, 0)')} AS spike FROM x""",
)
def w15(spark, d):
    w = SPEC.history()
    x = appearances(spark, d).select(*KEY, F.avg("cents").over(w.rowsBetween(-4, 0)).alias("a"), F.avg("cents").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("c"))
    return x.select(*KEY, r6(F.col("a")).alias("acute"), r6(F.col("c")).alias("chronic"), r6(F.try_divide("a", "c")).alias("spike"))


@query("w16_lead", on_panel("lead(cents) OVER (PARTITION BY user_id ORDER BY ts) AS next_cents"))
def w16(spark, d):
    return appearances(spark, d).select(*KEY, F.lead("cents").over(SPEC.history()).alias("next_cents"))


@query("w17_days_since_unlabelled", f"WITH {outcome_cte()} SELECT user_id, day, CAST(date_diff('day', max(CASE WHEN y = 0 THEN day END) {H.format(*PAST)}, day) AS INTEGER) AS days FROM outc")
def w17(spark, d):
    w = SPEC.history().rowsBetween(*X.PAST)
    return outcomes(spark, d).select(*KEY, F.datediff("day", F.last(F.when(F.col("y") == 0, F.col("day")), ignorenulls=True).over(w)).alias("days"))


@query("w18_first_row_after", f"WITH {E_CTE} SELECT user_id, min(day) AS day FROM app WHERE day > DATE '2024-01-15' GROUP BY user_id")
def w18(spark, d):
    x = appearances(spark, d).where("day > date'2024-01-15'").select(*KEY, F.row_number().over(W.partitionBy("user_id").orderBy("ts")).alias("rn"))
    return x.where("rn = 1").drop("rn")


@query(
    "w20_index_row_per_event",
    f"WITH {outcome_cte()} SELECT user_id, report_date, min(gap) AS gap, count(*) AS n_rows, arg_min(day, gap) AS day FROM att WHERE event_id IS NOT NULL GROUP BY user_id, report_date",
)
def w20(spark, d):
    x = outcomes(spark, d).where("event_id is not null").withColumn("n_rows", F.count("*").over(W.partitionBy("user_id", "report_date")))
    return x.where("is_index").select("user_id", "report_date", "gap", "n_rows", "day")


@query(
    "w21_random_row_per_entity",
    f"WITH {E_CTE} SELECT user_id, day FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('11:' || user_id || ':' || CAST(day AS VARCHAR))) AS rn FROM app) WHERE rn = 1",
)
def w21(spark, d):
    h = F.md5(F.concat_ws(":", F.lit("11"), F.col("user_id").cast("string"), F.col("day").cast("string")))
    x = appearances(spark, d).select(*KEY, F.row_number().over(W.partitionBy("user_id").orderBy(h)).alias("rn"))
    return x.where("rn = 1").drop("rn")


@query("w04_season_mean_sliced", ORACLES["w04_season_to_date_mean"])
def w04s(spark, d):
    """W4 where an entity may hold a third of all rows; w13 and w14 likewise."""
    return sliced.season_totals(appearances(spark, d), ["user_id", "season"], "ts", "cents").select(*KEY, r6(F.col("season_mean")).alias("std"))


@query("w13_season_sum_sliced", ORACLES["w13_season_sum"])
def w13s(spark, d):
    return sliced.season_totals(appearances(spark, d), ["user_id", "season"], "ts", "cents").select(*KEY, F.col("season_sum").alias("season_cents"))


@query("w14_forward_fill_sliced", ORACLES["w14_forward_fill"])
def w14s(spark, d):
    return sliced.forward_filled(appearances(spark, d).select(*KEY, "ts", "role"), ["user_id"], "ts", "role", "role_ff").select(*KEY, "role_ff")


@query("o01_global_panel_sort", f"WITH {E_CTE} SELECT user_id, day, cents, row_number() OVER (ORDER BY user_id, ts) AS place FROM app")
def o01(spark, d):
    """The whole panel in order of entity and time, each row with its place."""
    return sinks.in_order(appearances(spark, d).select(*KEY, "ts", "cents"), ["user_id", "ts"]).select(*KEY, "cents", "place")


PRIOR = [f"coalesce(sum((role = '{v}')::INT) {H.format(*PAST)}, 0)" for v in ROLES]


@query(
    "o01_sorted_panel_features",
    f"""WITH {E_CTE}, x AS (SELECT *, {PRIOR[0]} AS c, {PRIOR[1]} AS v, {PRIOR[2]} AS p, {REST} AS rest FROM app)
 SELECT user_id, day, {", ".join(f"{sql6(f'avg(cents) {back(k)}')} AS r{k}" for k in (3, 5, 10))}, round(stddev_samp(n) {back(5)}, 4) AS sd5, {sql6(f'avg(cents) {S.format(*PAST)}')} AS std,
 CAST(CASE WHEN rest IS NOT NULL THEN least(rest, 30) END AS INTEGER) AS rest_days, CAST(rest IS NULL AS INTEGER) AS is_opener, CAST(coalesce(rest = 1, false) AS INTEGER) AS b2b,
 count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {7 * X.DAY - 1} PRECEDING AND 1 PRECEDING) AS rows_7d, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {14 * X.DAY - 1} PRECEDING AND 1 PRECEDING) AS rows_14d,
 row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS panel_rows, row_number() OVER (PARTITION BY user_id, season ORDER BY ts) - 1 AS season_rows, CAST(coalesce(sum(cents) {S.format(*PAST)}, 0) AS BIGINT) AS season_cents,
 CASE WHEN greatest(c, v, p) = 0 THEN 'U' WHEN c = greatest(c, v, p) THEN 'click' WHEN v = greatest(c, v, p) THEN 'view' ELSE 'purchase' END AS prior_mode, last_value(role IGNORE NULLS) {H.format('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS role_ff FROM x""",
)
def o01_features(spark, d):
    """W2-W14 from a panel that is published in buckets by entity, in order: neither exchange nor sort."""
    panel = appearances(spark, d).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    root = scratch.new_path(spark, "panel")
    sinks.publish_panel(panel, root, "user_id", "at", int(spark.conf.get("spark.sql.shuffle.partitions")))
    f = X.sorted_features(sinks.sorted_panel(spark, root), SPEC, "at")
    return f.select(
        *KEY, *(r6(F.col(f"cents_r{k}")).alias(f"r{k}") for k in (3, 5, 10)), F.round("n_sd5", 4).alias("sd5"), r6(F.col("cents_std")).alias("std"), "rest_days", "is_opener", F.col("is_back_to_back").alias("b2b"),
        "rows_7d", "rows_14d", "panel_rows", "season_rows", F.col("cents_season").alias("season_cents"), "prior_mode", "role_ff",
    )


@query(
    "j10_event_history",
    f"""WITH {outcome_cte()}, pos AS (SELECT user_id, day FROM outc WHERE y = 1)
 SELECT o.user_id, o.day, count(p.day) AS n_before, count(p.day) FILTER (WHERE p.day >= o.day - 10) AS n_recent, max(p.day) AS last_day
 FROM outc o LEFT JOIN pos p ON o.user_id = p.user_id AND p.day < o.day GROUP BY o.user_id, o.day""",
)
def j10(spark, d):
    o = outcomes(spark, d).select(*KEY, "y")
    return asof.history(o.select(*KEY), o.where("y = 1").select("user_id", F.col("day").alias("event_day")), ["user_id"], "day", "event_day", 10)


@query("j10_event_history_sliced", ORACLES["j10_event_history"])
def j10s(spark, d):
    o = outcomes(spark, d).select(*KEY, "y")
    return sliced.history(o.select(*KEY), o.where("y = 1").select("user_id", F.col("day").alias("event_day")), ["user_id"], "day", "event_day", 10)


LO, HI = sql_wilson("k", "n")


@query(
    "flagship_point_in_time_rates",
    f"""WITH {outcome_cte()}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS panel_rows,
 avg(cents) {back(5)} AS r5, {REST} AS rest FROM outc), h AS (SELECT f.*, (SELECT count(*) FROM outc p WHERE p.user_id = f.user_id AND p.y = 1 AND p.day < f.day) AS n_before FROM f),
 g AS (SELECT season, count(*) AS n, CAST(sum(y) AS BIGINT) AS k, avg(r5) AS r5, avg(CASE WHEN rest IS NOT NULL THEN least(rest, 30) END) AS rest, CAST(sum(n_before) AS BIGINT) AS events_before FROM h WHERE eligible AND panel_rows >= 5 GROUP BY season)
 SELECT season, n, k, {sql6('k::DOUBLE / n')} AS rate, {sql6(LO)} AS lo, {sql6(HI)} AS hi, round(r5, 3) AS mean_r5, {sql6('rest')} AS mean_rest, events_before FROM g""",
)
def flagship(spark, d):
    """Linkage, features in one pass over the whole history, event history, masks last, rates."""
    o = outcomes(spark, d)
    f = X.build_features(o, SPEC)
    h = asof.history(f, o.where("y = 1").select("user_id", F.col("day").alias("event_day")), ["user_id"], "day", "event_day", 10)
    kept = h.where("eligible and panel_rows >= 5")
    out = rates(kept, "y", ["season"]).drop("_")
    more = kept.groupBy("season").agg(F.round(F.avg("cents_r5"), 3).alias("mean_r5"), r6(F.avg("rest_days")).alias("mean_rest"), F.sum("n_before").alias("events_before"))
    return out.join(more, "season").select("season", "n", "k", r6(F.col("rate")).alias("rate"), r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "mean_r5", "mean_rest", "events_before")


@query("f02_calendar_gap", f"WITH {outcome_cte()} SELECT user_id, day, event_id, gap FROM linked")
def f02(spark, d):
    return outcomes(spark, d).where("event_id is not null").select(*KEY, "event_id", F.datediff("report_date", "day").alias("gap"))


@query(
    "f03_elapsed_days",
    f"WITH {E_CTE} SELECT l.event_id, a.day, CAST(floor((epoch_us(e.ts) - epoch_us(a.ts)) / 86400000000.0) AS INTEGER) AS elapsed FROM lab l JOIN ev e USING (event_id) JOIN app a ON a.user_id = l.user_id AND a.day = l.report_date - 1",
)
def f03(spark, d):
    from ..functions.scalar import elapsed_days
    from .views import events

    lab = labels(spark, d).join(events(spark, d).select("event_id", F.col("ts").alias("ets")), "event_id").withColumn("day", F.date_sub("report_date", 1))
    return lab.join(appearances(spark, d), ["user_id", "day"]).select("event_id", "day", elapsed_days(F.col("ets"), F.col("ts")).alias("elapsed"))


@query("p21_one_hot", on_panel(", ".join(f"CAST(coalesce(role = '{v}', false) AS INTEGER) AS role_{v}" for v in ROLES)))
def p21(spark, d):
    from ..functions.scalar import one_hot

    return appearances(spark, d).select(*KEY, *one_hot(F.col("role"), ROLES, "role_"))


@query("p22_one_hot_decode", on_panel("coalesce(role, 'U') AS role"))
def p22(spark, d):
    from ..functions.scalar import one_hot, one_hot_decode

    x = appearances(spark, d).select(*KEY, *one_hot(F.col("role"), ROLES, "role_"))
    return x.select(*KEY, one_hot_decode(ROLES, "role_", "U").alias("role"))
