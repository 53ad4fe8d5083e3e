"""Queries on scores: metrics, calibration, resampling, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import auc_error, direction, logit, r6, risk_ratio, wilson
from ..operators import metrics as M
from ..operators import replicates as V
from ..operators import resample as R
from ..operators.audit import one_row_per_entity
from ..sources import scratch
from .registry import query
from .views import E_CTE, O_CTE, S_CTE, appearances, scores, sql6, sql_wilson, table, trades


def cum(score: str = "p", by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, " if by else ""
    return f"""c0 AS (SELECT {keys}{score} AS s, count(*) AS n, CAST(sum(y) AS BIGINT) AS k FROM sc GROUP BY {keys}{score}),
 c AS (SELECT *, coalesce(sum(n) OVER ({part}ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS na, coalesce(sum(k) OVER ({part}ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ka FROM c0)"""


AUC = "sum((n - k) * (ka + k / 2.0)) / (sum(k)::DOUBLE * (sum(n) - sum(k))::DOUBLE)"
AP = "sum(k * (ka + k)::DOUBLE / (na + n)) / sum(k)"


@query("m01_roc_auc", f"WITH {S_CTE}, {cum()} SELECT {sql6(AUC)} AS auc, CAST(sum(k) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS n FROM c")
def m01(spark, d):
    return M.auc(scores(spark, d), "p", "y").select(r6(F.col("auc")).alias("auc"), "positives", "n")


@query("m02_average_precision", f"WITH {S_CTE}, {cum()} SELECT {sql6(AP)} AS ap FROM c")
def m02(spark, d):
    return M.average_precision(scores(spark, d), "p", "y").select(r6(F.col("ap")).alias("ap"))


@query("m03_lift", f"WITH {S_CTE}, {cum()} SELECT {sql6(f'({AP}) / (sum(k)::DOUBLE / sum(n))')} AS lift, {sql6('sum(k)::DOUBLE / sum(n)')} AS prevalence FROM c")
def m03(spark, d):
    s = scores(spark, d)
    base = s.agg(F.avg("y").alias("prevalence"))
    return M.average_precision(s, "p", "y").join(F.broadcast(base)).select(r6(F.col("ap") / F.col("prevalence")).alias("lift"), r6(F.col("prevalence")).alias("prevalence"))


@query(
    "m04_brier",
    f"WITH {S_CTE}, b AS (SELECT avg((y - p) ** 2) AS b, avg(y) AS m, avg(y * y) AS z FROM sc) SELECT {sql6('b')} AS brier, {sql6('m * (1 - m)')} AS null_brier, {sql6('1 - b / (m * (1 - m))')} AS skill, {sql6('z')} AS zero_brier FROM b",
)
def m04(spark, d):
    b = M.brier(scores(spark, d), "p", "y")
    return b.select(*(r6(F.col(c)).alias(c) for c in ("brier", "null_brier", "skill", "zero_brier")))


@query("m07_observed_expected", f"WITH {S_CTE} SELECT {sql6('sum(y)')} AS observed, {sql6('sum(p)')} AS expected, {sql6('sum(y) / sum(p)')} AS oe, CASE WHEN sum(y) > sum(p) THEN 'under-predicts' WHEN sum(y) < sum(p) THEN 'over-predicts' ELSE 'equal' END AS says FROM sc")
def m07(spark, d):
    b = M.brier(scores(spark, d), "p", "y")
    return b.select(r6(F.col("observed")).alias("observed"), r6(F.col("expected")).alias("expected"), r6(F.col("oe")).alias("oe"), direction(F.col("observed"), F.col("expected")).alias("says"))


THRESHOLDS = [i / 20 for i in range(1, 19)]
GRID = ", ".join(f"({t})" for t in THRESHOLDS)


def decision_sql() -> str:
    odds = "(t / (1 - t))"
    model, everyone = f"(k / r::DOUBLE - (n - k) / r::DOUBLE * {odds})", f"(pos / r::DOUBLE - (1 - pos / r::DOUBLE) * {odds})"
    return f"""WITH {S_CTE}, g AS (SELECT t::DOUBLE AS t FROM (VALUES {GRID}) v(t)), w AS (SELECT count(*) AS r, sum(y) AS pos FROM sc),
 x AS (SELECT t, (SELECT count(*) FROM sc WHERE p >= t) AS n, (SELECT coalesce(sum(y), 0) FROM sc WHERE p >= t) AS k, r, pos FROM g, w),
 z AS (SELECT t AS threshold, {model} AS nb, {everyone} AS ta, ({model} - {everyone}) / {odds} * 1000 AS red FROM x)"""


@query("m08_net_benefit", f"{decision_sql()} SELECT threshold, {sql6('nb')} AS net_benefit, {sql6('ta')} AS treat_all, round(red, 4) AS reduction_per_1000 FROM z")
def m08(spark, d):
    x = M.net_benefit(scores(spark, d), "p", "y", THRESHOLDS)
    return x.select("threshold", r6(F.col("net_benefit")).alias("net_benefit"), r6(F.col("treat_all")).alias("treat_all"), F.round("reduction_per_1000", 4).alias("reduction_per_1000"))


@query("m09_useful_range", f"{decision_sql()} SELECT min(threshold) FILTER (WHERE useful) AS first_useful, max(threshold) FILTER (WHERE useful) AS last_useful, {sql6('max(gain)')} AS peak_gain, arg_max(threshold, gain) AS peak_at FROM (SELECT threshold, nb > greatest(ta, 0) + 1e-12 AS useful, nb - greatest(ta, 0) AS gain FROM z)")
def m09(spark, d):
    best = F.greatest("treat_all", F.lit(0.0))
    x = M.net_benefit(scores(spark, d), "p", "y", THRESHOLDS).withColumn("gain", F.col("net_benefit") - best)
    useful = F.col("net_benefit") > best + 1e-12
    return x.agg(F.min(F.when(useful, F.col("threshold"))).alias("first_useful"), F.max(F.when(useful, F.col("threshold"))).alias("last_useful"), r6(F.max("gain")).alias("peak_gain"), F.max_by("threshold", "gain").alias("peak_at"))


@query("m10_distinct_scores", f"WITH {S_CTE} SELECT count(DISTINCT p) AS raw_scores, count(DISTINCT round(p, 1)) AS rounded_scores FROM sc")
def m10(spark, d):
    return scores(spark, d).agg(F.count_distinct("p").alias("raw_scores"), F.count_distinct(F.round("p", 1)).alias("rounded_scores"))


@query("m11_season_stability", f"WITH {S_CTE}, {cum('p', 'season')} SELECT season, {sql6(f'CASE WHEN sum(k) > 0 AND sum(k) < sum(n) THEN {AUC} END')} AS auc, {sql6(f'CASE WHEN sum(k) > 0 THEN {AP} END')} AS ap FROM c GROUP BY season")
def m11(spark, d):
    s = scores(spark, d)
    return M.auc(s, "p", "y", ["season"]).join(M.average_precision(s, "p", "y", ["season"]), "season").select("season", r6(F.col("auc")).alias("auc"), r6(F.col("ap")).alias("ap"))


def auc_of(score: str) -> str:
    return f"(SELECT {AUC} FROM (WITH {cum(score)} SELECT * FROM c))"


@query("m12_paired_difference", f"WITH {S_CTE} SELECT {sql6(auc_of('p') + ' - ' + auc_of('q'))} AS delta")
def m12(spark, d):
    s = scores(spark, d)
    return M.auc(s, "p", "y").select(F.col("auc").alias("a")).join(F.broadcast(M.auc(s, "q", "y").select(F.col("auc").alias("b")))).select(r6(F.col("a") - F.col("b")).alias("delta"))


BUDGETS = [0.01, 0.02, 0.05, 0.1, 0.2]
BUDGET_SQL = f"""WITH {S_CTE}, {cum()}, w AS (SELECT sum(n) AS r, sum(k) AS pos FROM c), b AS (SELECT b::DOUBLE AS budget, greatest(1, round_even(b::DOUBLE * r::DOUBLE, 0))::BIGINT AS flagged, r, pos FROM (VALUES (0.01), (0.02), (0.05), (0.1), (0.2)) v(b), w),
 x AS (SELECT b.*, c.*, ka + (flagged - na) * k::DOUBLE / n AS hits FROM b JOIN c ON na < flagged AND na + n >= flagged)"""


@query("o02_alert_budget", f"{BUDGET_SQL} SELECT budget, flagged, {sql6('hits / flagged')} AS precision, {sql6('hits / pos')} AS recall, {sql6('(hits / flagged) / (pos::DOUBLE / r)')} AS lift, {sql6('1 / nullif(hits / flagged, 0)')} AS nns FROM x")
def o02(spark, d):
    b = M.alert_budget(scores(spark, d), "p", "y", BUDGETS)
    return b.select("budget", "flagged", *(r6(F.col(c)).alias(c) for c in ("precision", "recall", "lift", "nns")))


@query("o03_tied_boundary", f"{BUDGET_SQL} SELECT budget, {sql6('s')} AS threshold, CAST(ka AS BIGINT) AS hits_above, n AS tied, k AS hits_tied, {sql6('hits')} AS expected_hits FROM x")
def o03(spark, d):
    b = M.alert_budget(scores(spark, d), "p", "y", BUDGETS)
    return b.select("budget", r6(F.col("threshold")).alias("threshold"), "hits_above", "tied", "hits_tied", r6(F.col("expected_hits")).alias("expected_hits"))


@query("o06_arg_max", f"WITH {S_CTE}, {cum('p', 'season')}, a AS (SELECT season, {AP} AS ap FROM c GROUP BY season) SELECT arg_max(season, ap) AS best_season FROM a")
def o06(spark, d):
    return M.average_precision(scores(spark, d), "p", "y", ["season"]).agg(F.max_by("season", "ap").alias("best_season"))


@query("w22_running_tallies", f"WITH {S_CTE}, {cum()} SELECT {sql6('s')} AS p, n, k, CAST(na AS BIGINT) AS n_above, CAST(ka AS BIGINT) AS k_above FROM c")
def w22(spark, d):
    return M.cumulative(scores(spark, d), "p", "y").select(r6(F.col("p")).alias("p"), "n", "k", "n_above", "k_above")


LO, HI = sql_wilson("k", "n")


@query("f12_wilson", f"WITH {S_CTE}, g AS (SELECT cluster, count(*) AS n, CAST(sum(y) AS BIGINT) AS k FROM sc GROUP BY cluster) SELECT cluster, n, k, {sql6(LO)} AS lo, {sql6(HI)} AS hi FROM g")
def f12(spark, d):
    g = scores(spark, d).groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return g.select("cluster", "n", "k", r6(lo).alias("lo"), r6(hi).alias("hi"))


RR = "CASE WHEN k1 > 0 AND k0 > 0 THEN (k1::DOUBLE / n1) / (k0::DOUBLE / n0) END"
SE = "sqrt(1.0 / k1 - 1.0 / n1 + 1.0 / k0 - 1.0 / n0)"


@query("f13_risk_ratio", f"WITH {S_CTE}, g AS (SELECT season, count(*) FILTER (WHERE q > 0.4) AS n1, CAST(coalesce(sum(y) FILTER (WHERE q > 0.4), 0) AS BIGINT) AS k1, count(*) FILTER (WHERE NOT q > 0.4) AS n0, CAST(coalesce(sum(y) FILTER (WHERE NOT q > 0.4), 0) AS BIGINT) AS k0 FROM sc GROUP BY season) SELECT season, n1, k1, n0, k0, {sql6(RR)} AS rr, {sql6(f'CASE WHEN k1 > 0 AND k0 > 0 THEN exp(ln({RR}) - 1.96 * {SE}) END')} AS lo, {sql6(f'CASE WHEN k1 > 0 AND k0 > 0 THEN exp(ln({RR}) + 1.96 * {SE}) END')} AS hi FROM g")
def f13(spark, d):
    y, hot = F.col("y").cast("long"), F.col("q") > 0.4
    n = lambda c: F.count(F.when(c, 1))
    k = lambda c: F.coalesce(F.sum(F.when(c, y)), F.lit(0))
    g = scores(spark, d).groupBy("season").agg(n(hot).alias("n1"), k(hot).alias("k1"), n(~hot).alias("n0"), k(~hot).alias("k0"))
    rr, lo, hi = risk_ratio(F.col("k1"), F.col("n1"), F.col("k0"), F.col("n0"))
    return g.select("season", "n1", "k1", "n0", "k0", r6(rr).alias("rr"), r6(lo).alias("lo"), r6(hi).alias("hi"))


HM = "sqrt((a * (1 - a) + (p - 1) * (a / (2 - a) - a * a) + (m - 1) * (2 * a * a / (1 + a) - a * a)) / (p * m))"


@query("f14_auc_error", f"WITH {S_CTE}, {cum()}, x AS (SELECT {AUC} AS a, sum(k)::DOUBLE AS p, (sum(n) - sum(k))::DOUBLE AS m FROM c), z AS (SELECT a, {HM} AS se, {HM.replace('a * a', '0.25').replace('(1 - a)', '0.5').replace('(2 - a)', '1.5').replace('(1 + a)', '1.5').replace('(a ', '(0.5 ').replace('- a)', '- 0.5)')} AS se0 FROM x) SELECT {sql6('se')} AS se, {sql6('0.5 - 1.96 * se0')} AS band_lo, {sql6('0.5 + 1.96 * se0')} AS band_hi, abs(a - 0.5) <= 1.96 * se0 AS inside FROM z")
def f14(spark, d):
    a = M.auc(scores(spark, d), "p", "y").withColumn("negatives", F.col("n") - F.col("positives"))
    se = auc_error(F.col("auc"), F.col("positives"), F.col("negatives"))
    se0 = auc_error(F.lit(0.5), F.col("positives"), F.col("negatives"))
    return a.select(r6(se).alias("se"), r6(0.5 - 1.96 * se0).alias("band_lo"), r6(0.5 + 1.96 * se0).alias("band_hi"), (F.abs(F.col("auc") - 0.5) <= 1.96 * se0).alias("inside"))


@query("f11_logit", f"WITH {S_CTE} SELECT l_orderkey, l_linenumber, {sql6('ln(p / (1 - p))')} AS logit_p FROM sc")
def f11(spark, d):
    return scores(spark, d).select("l_orderkey", "l_linenumber", r6(logit(F.col("p"))).alias("logit_p"))


REPS = 1000
DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"
BOOT = f"""WITH {S_CTE}, kl AS (SELECT cluster, row_number() OVER (ORDER BY md5(CAST(cluster AS VARCHAR))) - 1 AS i FROM (SELECT DISTINCT cluster FROM sc)), sz AS (SELECT count(*) AS m FROM kl),
 dr AS (SELECT rep, {DRAW.format("'7:' || rep || ':' || slot")} % m AS i FROM sz, range({REPS}) r(rep), LATERAL (SELECT unnest(range(m)) AS slot)),
 wt AS (SELECT rep, cluster, count(*) AS w FROM dr JOIN kl USING (i) GROUP BY rep, cluster)"""


def weights(spark, d, seed: int = 7):
    return R.cluster_weights(scores(spark, d).select("cluster").distinct(), "cluster", REPS, seed)


@query("r01_bootstrap_weights", f"{BOOT} SELECT rep, cluster, w FROM wt")
def r01w(spark, d):
    return weights(spark, d)


@query("r01_cluster_bootstrap_rate", f"{BOOT}, g AS (SELECT cluster, count(*) AS n, sum(y) AS k FROM sc GROUP BY cluster), v AS (SELECT rep, sum(w * k)::DOUBLE / sum(w * n)::DOUBLE AS v FROM wt JOIN g USING (cluster) GROUP BY rep) SELECT {sql6('quantile_cont(v, 0.025)')} AS lo, {sql6('quantile_cont(v, 0.975)')} AS hi, count(v) AS replicates FROM v")
def r01(spark, d):
    g = scores(spark, d).groupBy("cluster").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    sums = V.replicate_sums(V.weight_vectors(weights(spark, d), "cluster"), g, "cluster", ["n", "k"])
    v = sums.select("rep", (F.col("k") / F.col("n")).alias("v"))
    return R.interval(v, "v").select(r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "replicates")


def boot_auc(score: str, name: str) -> str:
    return f"""{name}0 AS (SELECT rep, {score} AS s, sum(w * n0) AS n, sum(w * k0) AS k FROM (SELECT cluster, {score}, count(*) AS n0, sum(y) AS k0 FROM sc GROUP BY cluster, {score}) g JOIN wt USING (cluster) GROUP BY rep, {score}),
 {name}1 AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY rep ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ka FROM {name}0),
 {name} AS (SELECT rep, sum((n - k) * (ka + k / 2.0))::DOUBLE / (sum(k)::DOUBLE * (sum(n) - sum(k))::DOUBLE) AS auc FROM {name}1 GROUP BY rep)"""


def replicate_auc(spark, d, *names: str) -> list:
    """AUCs of each replicate, of one draw for all scores."""
    drawn = scratch.written(weights(spark, d), "weights")
    return [V.replicate_auc(scores(spark, d), s, "y", "cluster", drawn, REPS) for s in names]


@query("r01_cluster_bootstrap_auc", f"{BOOT}, {boot_auc('p', 'a')} SELECT {sql6('quantile_cont(auc, 0.025)')} AS lo, {sql6('quantile_cont(auc, 0.975)')} AS hi, count(auc) AS replicates FROM a")
def r01a(spark, d):
    return R.interval(replicate_auc(spark, d, "p")[0], "auc").select(r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "replicates")


@query("r02_paired_bootstrap", f"{BOOT}, {boot_auc('p', 'a')}, {boot_auc('q', 'b')}, z AS (SELECT a.auc - b.auc AS delta FROM a JOIN b USING (rep)) SELECT {sql6('quantile_cont(delta, 0.025)')} AS lo, {sql6('quantile_cont(delta, 0.975)')} AS hi, count(delta) AS replicates FROM z")
def r02(spark, d):
    p, q = replicate_auc(spark, d, "p", "q")
    both = p.join(q.withColumnRenamed("auc", "other"), "rep").withColumn("delta", F.col("auc") - F.col("other"))
    return R.interval(both, "delta").select(r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "replicates")


@query("a18_replicate_percentiles", f"WITH {S_CTE}, v AS (SELECT cluster, avg(y) AS v FROM sc GROUP BY cluster) SELECT {sql6('quantile_cont(v, 0.025)')} AS lo, {sql6('quantile_cont(v, 0.975)')} AS hi, count(v) AS replicates FROM v")
def a18(spark, d):
    v = scores(spark, d).groupBy("cluster").agg(F.avg("y").alias("v"))
    return R.interval(v, "v").select(r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "replicates")


PERM = """x AS (SELECT user_id, day, k, row_number() OVER (ORDER BY md5(user_id || ':' || CAST(day AS VARCHAR)), user_id, day) AS i, row_number() OVER (ORDER BY md5('5:' || user_id || ':' || CAST(day AS VARCHAR)), user_id, day) AS j FROM app)"""


@query("r04_label_permutation", f"WITH {E_CTE}, {PERM} SELECT a.user_id, a.day, b.k FROM x a JOIN x b ON a.i = b.j")
def r04(spark, d):
    return R.permuted(appearances(spark, d).select("user_id", "day", "k"), "k", 5, "user_id", "day").select("user_id", "day", "k")


@query("r05_stratified_split", f"WITH {S_CTE}, x AS (SELECT l_orderkey, l_linenumber, y, row_number() OVER (PARTITION BY y ORDER BY md5('3:' || l_orderkey || ':' || l_linenumber), l_orderkey, l_linenumber) AS r, count(*) OVER (PARTITION BY y) AS n FROM sc) SELECT l_orderkey, l_linenumber, y, r <= round_even(n * 0.25::DOUBLE, 0) AS is_test FROM x")
def r05(spark, d):
    return R.stratified_split(scores(spark, d).select("l_orderkey", "l_linenumber", "y"), "y", 0.25, 3, "l_orderkey", "l_linenumber")


@query("r06_donor_row", f"WITH {E_CTE}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('9:' || user_id || ':' || CAST(day AS VARCHAR))) AS r FROM app), h AS (SELECT user_id, day, cents, row_number() OVER (ORDER BY md5(CAST(user_id AS VARCHAR))) AS i FROM x WHERE r = 1), m AS (SELECT count(*) AS n FROM h) SELECT a.user_id, a.day, a.cents AS old_cents, b.cents AS new_cents FROM h a, m JOIN h b ON b.i = a.i % n + 1")
def r06(spark, d):
    hit = one_row_per_entity(appearances(spark, d), "user_id", "day", 9).where("hit").select("user_id", "day", "cents")
    h = R.numbered_by_md5(hit, "i", "user_id").join(F.broadcast(hit.agg(F.count("*").alias("m"))))
    donor = h.select(F.col("i").alias("j"), F.col("cents").alias("new_cents"))
    return h.join(donor, F.col("j") == F.col("i") % F.col("m") + 1).select("user_id", "day", F.col("cents").alias("old_cents"), "new_cents")


@query("r07_record_shuffle", f"WITH {E_CTE}, l AS (SELECT event_id, category, row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS i, row_number() OVER (ORDER BY md5('13:' || event_id), event_id) AS j FROM lab) SELECT a.event_id, CASE WHEN {DRAW.format("'b:' || a.event_id")} % 10 = 0 THEN NULL ELSE b.category END AS category FROM l a JOIN l b ON a.i = b.j")
def r07(spark, d):
    from ..functions.scalar import draw
    from .views import labels

    moved = R.permuted(labels(spark, d).select("event_id", "category"), "category", 13, "event_id")
    return moved.select("event_id", F.when(draw(F.lit("b"), F.col("event_id")) % 10 != 0, F.col("category")).alias("category"))


@query("l01_median_impute", f"WITH {E_CTE}, m AS (SELECT quantile_cont(k, 0.5) AS med FROM app WHERE season < 3 AND k % 4 <> 0) SELECT user_id, day, CASE WHEN k % 4 <> 0 THEN k::DOUBLE ELSE med END AS k FROM app, m")
def l01(spark, d):
    a = appearances(spark, d).withColumn("k", F.when(F.col("k") % 4 != 0, F.col("k")))
    m = M.medians(a.where("season < 3"), "k").withColumnRenamed("median", "med")
    return a.join(F.broadcast(m)).select("user_id", "day", F.coalesce(F.col("k").cast("double"), "med").alias("k"))


@query("l02_standardise", f"WITH {E_CTE}, m AS (SELECT avg(n) AS mu, stddev_pop(n) AS sd FROM app WHERE season < 3) SELECT user_id, day, {sql6('(n - mu) / sd')} AS z FROM app, m")
def l02(spark, d):
    a = appearances(spark, d)
    m = a.where("season < 3").agg(F.avg("n").alias("mu"), F.stddev_pop("n").alias("sd"))
    return a.join(F.broadcast(m)).select("user_id", "day", r6((F.col("n") - F.col("mu")) / F.col("sd")).alias("z"))
