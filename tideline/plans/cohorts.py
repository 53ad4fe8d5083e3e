"""Queries on aggregates and cohort analyses."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scalar import differs, direction, r6, rate, right_closed, season_label
from ..operators import features as X
from ..operators.quality import row_digest
from ..operators.rates import distinct_bitmaps, distinct_counts, rates, rates_all_bins, ratio_by
from ..operators import metrics as M
from ..sources import scratch
from ..sources.ingest import union_all
from .linkage import BREAKS, J8, breaks, missed_days
from .registry import query
from .views import BINS, CATEGORIES, E_CTE, O_CTE, SPEC, appearances, labels, outcome_cte, outcomes, sql6, sql_wilson, table, trades

LO, HI = sql_wilson("k", "n")
RATE = f"{sql6('k::DOUBLE / nullif(n, 0)')} AS rate, {sql6(LO)} AS lo, {sql6(HI)} AS hi"
REST = "date_diff('day', lag(day) OVER (PARTITION BY user_id, season ORDER BY ts), day)"
BIN = "CASE WHEN rest > 0 AND rest <= 1 THEN '1' WHEN rest > 1 AND rest <= 2 THEN '2' WHEN rest > 2 AND rest <= 3 THEN '3' WHEN rest > 3 AND rest <= 7 THEN '4-7' WHEN rest > 7 AND rest <= 1000 THEN '8+' END"
R_CTE = outcome_cte() + f", rs0 AS (SELECT *, {REST} AS rest FROM outc), rs AS (SELECT *, {BIN} AS bin FROM rs0)"


def rounded(df):
    return df.select(*(r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def rested(spark, d):
    o = outcomes(spark, d).withColumn("rest", X.rest_days(SPEC))
    return o.withColumn("bin", right_closed(F.col("rest"), *BINS))


@query("a01_season_rates", f"WITH {outcome_cte()} SELECT season, count(*) AS n, CAST(sum(y) AS BIGINT) AS k, count(DISTINCT user_id) AS entities, {sql6('avg(y)')} AS rate FROM outc WHERE eligible GROUP BY season")
def a01(spark, d):
    g = outcomes(spark, d).where("eligible").groupBy("season")
    return g.agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("k"), F.count_distinct("user_id").alias("entities"), r6(F.avg("y")).alias("rate"))


@query("a02_rate_by_bin_all_bins", f"WITH {R_CTE}, b(bin) AS (VALUES ('1'), ('2'), ('3'), ('4-7'), ('8+')), g AS (SELECT b.bin, count(rs.user_id) AS n, CAST(coalesce(sum(y), 0) AS BIGINT) AS k FROM b LEFT JOIN rs ON rs.bin = b.bin AND eligible GROUP BY b.bin) SELECT bin, n, k, {RATE} FROM g")
def a02(spark, d):
    return rounded(rates_all_bins(rested(spark, d).where("eligible"), "y", "bin", BINS[1]))


@query("a03_gradient_with_openers", f"WITH {R_CTE}, g AS (SELECT coalesce(bin, 'opener') AS bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS k FROM rs WHERE eligible GROUP BY 1) SELECT bin, n, k, {RATE} FROM g")
def a03(spark, d):
    r = rested(spark, d).where("eligible")
    openers = r.where("bin is null").withColumn("bin", F.lit("opener"))
    return rounded(rates(r.where("bin is not null"), "y", ["bin"]).unionByName(rates(openers, "y", ["bin"])))


@query("a04_exact_distinct", "SELECT l_shipmode_like, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS suppliers FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_like, * FROM lineitem) GROUP BY 1")
def a04(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode_like"))
    return g.agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_suppkey").alias("suppliers"))


@query(
    "a04_distinct_rollup",
    """SELECT l_returnflag, l_linestatus, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
)
def a04_rollup(spark, d):
    """Exact distinct orders by flag and status, by flag, and in all, from one shuffle of the rows."""
    keys = ["l_returnflag", "l_linestatus"]
    maps = scratch.written(distinct_bitmaps(table(spark, d, "lineitem"), keys, "l_orderkey"), "bitmaps")
    levels = [distinct_counts(maps, keys[:k], "orders") for k in (2, 1, 0)]
    return union_all(levels).select(*keys, "orders")


@query("a05_value_shares", f"WITH {E_CTE} SELECT category, count(*) AS n, {sql6('count(*)::DOUBLE / sum(count(*)) OVER ()')} AS share FROM lab GROUP BY category")
def a05(spark, d):
    g = labels(spark, d).groupBy("category").agg(F.count("*").alias("n"))
    return g.select("category", "n", r6(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))).alias("share"))


@query("a06_contingency", f"WITH {E_CTE} SELECT dayname(report_date) AS weekday, {', '.join(f'''count(*) FILTER (WHERE category = '{c}') AS {c}''' for c in CATEGORIES)} FROM lab GROUP BY 1")
def a06(spark, d):
    rows = labels(spark, d).withColumn("weekday", F.date_format("report_date", "EEEE"))
    return rows.groupBy("weekday").pivot("category", CATEGORIES).count().na.fill(0)


@query("a07_in_both_columns", f"WITH {E_CTE} SELECT user_id, count(*) FILTER (WHERE category = 'alpha') AS alpha, count(*) FILTER (WHERE category = 'beta') AS beta FROM lab GROUP BY user_id HAVING alpha > 0 AND beta > 0")
def a07(spark, d):
    g = labels(spark, d).groupBy("user_id").pivot("category", ["alpha", "beta"]).count()
    return g.where("alpha > 0 and beta > 0")


@query("a08_conflicting_attribute", f"WITH {O_CTE} SELECT cust, count(DISTINCT grp) AS n_groups FROM tr GROUP BY cust HAVING count(DISTINCT grp) > 1")
def a08(spark, d):
    return trades(spark, d).groupBy("cust").agg(F.count_distinct("grp").alias("n_groups")).where("n_groups > 1")


@query("a09_event_grain", f"WITH {E_CTE} SELECT user_id, report_date, arg_min(category, event_id) AS category FROM lab GROUP BY user_id, report_date")
def a09(spark, d):
    x = labels(spark, d).withColumn("r", F.row_number().over(W.partitionBy("user_id", "report_date").orderBy("event_id")))
    return x.where("r = 1").select("user_id", "report_date", "category")


@query("a10_season_opener", f"WITH {E_CTE} SELECT season, min(day) AS opener FROM app GROUP BY season")
def a10(spark, d):
    return appearances(spark, d).groupBy("season").agg(F.min("day").alias("opener"))


@query("a11_median_time", f"WITH {E_CTE} SELECT season, {sql6('quantile_cont(epoch_us(ts) / 86400000000.0, 0.5)')} AS median_day FROM app GROUP BY season")
def a11(spark, d):
    days = appearances(spark, d).select("season", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86400000000.0)).alias("at"))
    return M.medians(days, "at", ["season"]).select("season", r6(F.col("median")).alias("median_day"))


@query("a12_class_weight", f"WITH {outcome_cte()} SELECT {sql6('sum(1 - y)::DOUBLE / sum(y)')} AS pos_weight FROM outc WHERE eligible")
def a12(spark, d):
    return outcomes(spark, d).where("eligible").agg(r6(F.try_divide(F.sum(1 - F.col("y")), F.sum("y"))).alias("pos_weight"))


@query("a13_conditional_means", f"WITH {outcome_cte()} SELECT {sql6('avg(cents) FILTER (WHERE y = 1)')} AS mean_pos, {sql6('avg(cents) FILTER (WHERE y = 0)')} AS mean_neg FROM outc WHERE eligible")
def a13(spark, d):
    m = lambda k: r6(F.avg(F.when(F.col("y") == k, F.col("cents"))))
    return outcomes(spark, d).where("eligible").agg(m(1).alias("mean_pos"), m(0).alias("mean_neg"))


@query("a14_label_correlation", f"WITH {outcome_cte()} SELECT 'cents' AS feature, round(corr(cents, y), 6) AS r FROM outc UNION ALL SELECT 'n', round(corr(n, y), 6) FROM outc UNION ALL SELECT 'k', round(corr(k, y), 6) FROM outc")
def a14(spark, d):
    o = outcomes(spark, d)
    one = o.agg(*(F.corr(c, "y").alias(c) for c in SPEC.measures))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.round(c, 6).alias("r")) for c in SPEC.measures))).alias("x")).select("x.*")


@query("a15_missingness", f"WITH {outcome_cte()} SELECT * FROM (SELECT 'role' AS feature, {sql6('avg((role IS NULL)::INT)')} AS missing FROM outc UNION ALL SELECT 'event_id', {sql6('avg((event_id IS NULL)::INT)')} FROM outc UNION ALL SELECT 'gap', {sql6('avg((gap IS NULL)::INT)')} FROM outc UNION ALL SELECT 'k', {sql6('avg((k IS NULL)::INT)')} FROM outc) ORDER BY missing DESC, feature LIMIT 3")
def a15(spark, d):
    cols = ["role", "event_id", "gap", "k"]
    one = outcomes(spark, d).agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), r6(F.col(c)).alias("missing")) for c in cols))).alias("x")).select("x.*")
    return rows.orderBy(F.desc("missing"), "feature").limit(3)


@query("a16_increase_given_state", f"WITH {E_CTE}, x AS (SELECT cents, lag(cents) OVER (PARTITION BY user_id ORDER BY ts) AS prev, CASE WHEN n > 1 THEN 'busy' ELSE 'quiet' END AS state FROM app) SELECT state, {sql6('avg((cents > prev)::INT)')} AS p_increase FROM x WHERE prev IS NOT NULL GROUP BY state")
def a16(spark, d):
    x = appearances(spark, d).select("cents", F.lag("cents").over(SPEC.history()).alias("prev"), F.when(F.col("n") > 1, "busy").otherwise("quiet").alias("state"))
    return x.where("prev is not null").groupBy("state").agg(r6(F.avg((F.col("cents") > F.col("prev")).cast("int"))).alias("p_increase"))


@query("a17_cell_digest", "SELECT year(l_shipdate)::INT AS season, count(*) AS n, CAST(sum(('0x' || substr(md5(l_orderkey || ':' || l_linenumber), 1, 8))::BIGINT) AS VARCHAR) || ':' || CAST(bit_xor(('0x' || substr(md5(l_orderkey || ':' || l_linenumber), 1, 8))::BIGINT) AS VARCHAR) AS digest FROM lineitem WHERE l_discount = 0 AND l_quantity > 45 GROUP BY 1")
def a17(spark, d):
    x = table(spark, d, "lineitem").where("l_discount = 0 and l_quantity > 45").select(F.year("l_shipdate").cast("int").alias("season"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"))
    return x.groupBy("season").agg(F.count("*").alias("n"), row_digest(F.col("id")).alias("digest"))


@query("a19_entity_mean", f"WITH {E_CTE} SELECT user_id, day, {sql6('avg(cents) OVER (PARTITION BY user_id)')} AS entity_mean FROM app")
def a19(spark, d):
    return appearances(spark, d).select("user_id", "day", r6(F.avg("cents").over(W.partitionBy("user_id"))).alias("entity_mean"))


@query("a20_category_variability", f"WITH {E_CTE} SELECT user_id, count(DISTINCT role) AS n_roles FROM app GROUP BY user_id")
def a20(spark, d):
    return appearances(spark, d).groupBy("user_id").agg(F.count_distinct("role").alias("n_roles"))


@query("a21_unknown_share", f"WITH {E_CTE} SELECT CAST(week(report_date) AS VARCHAR) AS block, {sql6('''avg((category = 'other')::INT)''')} AS unknown FROM lab GROUP BY 1 UNION ALL SELECT CASE WHEN report_date < DATE '2024-01-16' THEN 'train' ELSE 'test' END, {sql6('''avg((category = 'other')::INT)''')} FROM lab GROUP BY 1")
def a21(spark, d):
    x = labels(spark, d).withColumn("u", (F.col("category") == "other").cast("int"))
    a = x.groupBy(F.weekofyear("report_date").cast("string").alias("block")).agg(r6(F.avg("u")).alias("unknown"))
    return a.unionByName(x.groupBy(F.when(F.col("report_date") < "2024-01-16", "train").otherwise("test").alias("block")).agg(r6(F.avg("u")).alias("unknown")))


@query("a22_balance", f"WITH {outcome_cte()} SELECT count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS positives, count(*) FILTER (WHERE user_id IN (SELECT user_id FROM outc WHERE y = 1)) AS rows_of_positive_entities FROM outc")
def a22(spark, d):
    o = outcomes(spark, d)
    ever = o.where("y = 1").select("user_id").distinct()
    return o.agg(F.count("*").alias("n_rows"), F.sum(F.col("y").cast("long")).alias("positives")).join(F.broadcast(o.join(ever, "user_id", "left_semi").agg(F.count("*").alias("rows_of_positive_entities"))))


@query("a23_missing_key_share", f"WITH {E_CTE} SELECT season, {sql6('avg((role IS NULL)::INT)')} AS missing, avg((role IS NULL)::INT) > 0.999 AS whole_season FROM app GROUP BY season")
def a23(spark, d):
    m = F.avg(F.col("role").isNull().cast("int"))
    return appearances(spark, d).groupBy("season").agg(r6(m).alias("missing"), (m > 0.999).alias("whole_season"))


@query("a24_inflation", f"WITH {outcome_cte()} SELECT {sql6('count(*)::DOUBLE / count(DISTINCT (user_id, report_date))')} AS rows_per_event FROM att WHERE event_id IS NOT NULL")
def a24(spark, d):
    return outcomes(spark, d).where("event_id is not null").agg(r6(F.count("*") / F.count_distinct(F.struct("user_id", "report_date"))).alias("rows_per_event"))


@query("e01_rate_rows", f"WITH {outcome_cte()}, g AS (SELECT season, count(*) AS n, CAST(sum(y) AS BIGINT) AS k FROM outc WHERE eligible GROUP BY season) SELECT season, n, k, {RATE} FROM g")
def e01(spark, d):
    return rounded(rates(outcomes(spark, d).where("eligible"), "y", ["season"]))


GAPBIN = "CASE WHEN rest > 0 AND rest <= 30 THEN 'a' WHEN rest > 30 AND rest <= 90 THEN 'b' WHEN rest > 90 AND rest <= 1000 THEN 'c' END"
D_CTE = J8 + f", z0 AS (SELECT x.*, tr.y, date_diff('day', prev_day, x.day) AS rest FROM x JOIN tr ON tr.cust = x.cust AND tr.day = x.day), z AS (SELECT *, {GAPBIN} AS bin, missed = 0 AS exo FROM z0)"


def decomposed(spark, d):
    m = missed_days(spark, d).withColumn("rest", F.datediff("day", "prev_day"))
    return m.withColumns({"bin": right_closed(F.col("rest"), [0, 30, 90, 1000], ["a", "b", "c"]), "exo": F.col("missed") == 0})


RRS = "CASE WHEN k1 > 0 AND k0 > 0 THEN (k1::DOUBLE / n1) / (k0::DOUBLE / n0) END"
SE = "sqrt(1.0 / k1 - 1.0 / n1 + 1.0 / k0 - 1.0 / n0)"
RR_COLS = f"n1, k1, n0, k0, {sql6(RRS)} AS rr, {sql6(f'CASE WHEN k1 > 0 AND k0 > 0 THEN exp(ln({RRS}) - 1.96 * {SE}) END')} AS lo, {sql6(f'CASE WHEN k1 > 0 AND k0 > 0 THEN exp(ln({RRS}) + 1.96 * {SE}) END')} AS hi"
TWO = "count(*) FILTER (WHERE {c}) AS n1, CAST(coalesce(sum(y) FILTER (WHERE {c}), 0) AS BIGINT) AS k1, count(*) FILTER (WHERE NOT {c}) AS n0, CAST(coalesce(sum(y) FILTER (WHERE NOT {c}), 0) AS BIGINT) AS k0"


@query("e02_cause_vs_length", f"WITH {D_CTE[5:]}, g AS (SELECT bin, {TWO.format(c='exo')} FROM z WHERE bin IS NOT NULL AND exo IS NOT NULL GROUP BY bin) SELECT bin, {RR_COLS} FROM g")
def e02(spark, d):
    return rounded(ratio_by(decomposed(spark, d).where("bin is not null"), "y", F.col("exo"), ["bin"]))


@query("e02_pooled", f"WITH {D_CTE[5:]}, g AS (SELECT {TWO.format(c='exo')} FROM z WHERE rest >= 3 AND exo IS NOT NULL) SELECT {RR_COLS} FROM g")
def e02p(spark, d):
    return rounded(ratio_by(decomposed(spark, d).where("rest >= 3"), "y", F.col("exo"), []))


@query("e03_calendar_break", f"WITH {O_CTE}, {BREAKS}, x AS (SELECT cust, grp, season, day, y, lag(day) OVER (PARTITION BY cust, season ORDER BY day) AS prev_day FROM tr), f AS (SELECT x.*, before, row_number() OVER (PARTITION BY cust, x.grp, x.season ORDER BY day) AS rn FROM x JOIN br ON br.grp = x.grp AND br.season = x.season WHERE day >= resume), gg AS (SELECT CASE WHEN rn = 1 AND prev_day <= before THEN 'first after break' WHEN rn <= 3 THEN 'next' ELSE 'later' END AS stratum, count(*) AS n, CAST(sum(y) AS BIGINT) AS k FROM f GROUP BY 1) SELECT stratum, n, k, {RATE} FROM gg")
def e03(spark, d):
    x = trades(spark, d).select("cust", "grp", "season", "day", "y", F.lag("day").over(W.partitionBy("cust", "season").orderBy("day")).alias("prev_day"))
    f = x.join(F.broadcast(breaks(spark, d)), ["grp", "season"]).where("day >= resume")
    f = f.withColumn("rn", F.row_number().over(W.partitionBy("cust", "grp", "season").orderBy("day")))
    stratum = F.when((F.col("rn") == 1) & (F.col("prev_day") <= F.col("before")), "first after break").when(F.col("rn") <= 3, "next").otherwise("later")
    return rounded(rates(f.withColumn("stratum", stratum), "y", ["stratum"]))


OPEN = f"""WITH {O_CTE}, o AS (SELECT grp, season, min(day) AS opener FROM tr GROUP BY grp, season), x AS (SELECT tr.*, tr.day = opener AS is_open, min(tr.day) OVER (PARTITION BY cust, season) = tr.day AS own_first FROM tr JOIN o USING (grp, season)),
 c AS (SELECT 'all' AS cohort, * FROM x UNION ALL SELECT 'recent', * FROM x WHERE season >= 1998 UNION ALL SELECT 'early', * FROM x WHERE season < 1998)"""


def opening(spark, d):
    t = trades(spark, d)
    o = t.groupBy("grp", "season").agg(F.min("day").alias("opener"))
    own = F.min("day").over(W.partitionBy("cust", "season")) == F.col("day")
    x = t.join(o, ["grp", "season"]).select("*", (F.col("day") == F.col("opener")).alias("is_open"), own.alias("own_first"))
    cohort = F.array(F.lit("all"), F.when(F.col("season") >= 1998, "recent").otherwise("early"))
    return x.select("*", F.explode(cohort).alias("cohort"))


@query("e04_openers", f"{OPEN}, g AS (SELECT cohort, {TWO.format(c='own_first')} FROM c GROUP BY cohort) SELECT cohort, {RR_COLS} FROM g")
def e04(spark, d):
    return rounded(ratio_by(opening(spark, d), "y", F.col("own_first"), ["cohort"]))


@query("e04_late_starts", f"{OPEN}, g AS (SELECT cohort, CASE WHEN is_open THEN 'with group' ELSE 'late' END AS start, count(*) AS n, CAST(sum(y) AS BIGINT) AS k FROM c WHERE own_first GROUP BY 1, 2) SELECT cohort, start, n, k, {RATE} FROM g")
def e04l(spark, d):
    x = opening(spark, d).where("own_first").withColumn("start", F.when(F.col("is_open"), "with group").otherwise("late"))
    return rounded(rates(x, "y", ["cohort", "start"]))


@query("e05_summary_vs_reference", f"WITH {R_CTE}, g AS (SELECT coalesce(bin, 'opener') AS stratum, count(*) AS n, CAST(sum(y) AS BIGINT) AS k FROM rs WHERE eligible GROUP BY 1), r AS (SELECT n AS n0, k AS k0 FROM g WHERE stratum = '1') SELECT stratum, n, k, {sql6('(k::DOUBLE / n) / nullif(k0::DOUBLE / n0, 0)')} AS rr FROM g, r")
def e05(spark, d):
    g = rates(rested(spark, d).where("eligible").withColumn("stratum", F.coalesce("bin", F.lit("opener"))), "y", ["stratum"])
    ref = g.where("stratum = '1'").select(F.col("rate").alias("r0"))
    return g.join(F.broadcast(ref)).select("stratum", "n", "k", r6(F.try_divide("rate", "r0")).alias("rr"))


@query("e06_curves_by_cohort", f"WITH {R_CTE}, c AS (SELECT 'all' AS cohort, * FROM rs WHERE eligible UNION ALL SELECT 'late', * FROM rs WHERE eligible AND season >= 2 UNION ALL SELECT 'busy', * FROM rs WHERE eligible AND n > 1), g AS (SELECT cohort, bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS k FROM c WHERE bin IS NOT NULL GROUP BY cohort, bin) SELECT cohort, bin, n, k, {RATE} FROM g")
def e06(spark, d):
    r = rested(spark, d).where("eligible and bin is not null")
    cohorts = F.filter(F.array(F.lit("all"), F.when(F.col("season") >= 2, "late"), F.when(F.col("n") > 1, "busy")), lambda x: x.isNotNull())
    return rounded(rates(r.drop("k").select("*", F.explode(cohorts).alias("cohort")), "y", ["cohort", "bin"]))


@query("e07_category_by_band", f"WITH {R_CTE}, g AS (SELECT coalesce(role, 'U') AS role, bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS k FROM rs WHERE eligible AND bin IS NOT NULL GROUP BY 1, 2) SELECT role, bin, n, k, {RATE} FROM g")
def e07(spark, d):
    return rounded(rates(rested(spark, d).where("eligible and bin is not null").withColumn("role", F.coalesce("role", F.lit("U"))), "y", ["role", "bin"]))


@query("e08_rows_vs_events", f"WITH {outcome_cte()} SELECT count(*) AS row_unit, count(DISTINCT (user_id, report_date)) AS event_unit FROM att WHERE event_id IS NOT NULL")
def e08(spark, d):
    return outcomes(spark, d).where("event_id is not null").agg(F.count("*").alias("row_unit"), F.count_distinct(F.struct("user_id", "report_date")).alias("event_unit"))


@query("e09_unknown_drift", f"WITH {E_CTE}, g AS (SELECT CAST(week(report_date) AS INTEGER) AS wk, avg((category = 'other')::INT) AS u, count(*) AS n FROM lab GROUP BY 1) SELECT wk, n, {sql6('u')} AS unknown, {sql6('u - lag(u) OVER (ORDER BY wk)')} AS change FROM g")
def e09(spark, d):
    g = labels(spark, d).groupBy(F.weekofyear("report_date").alias("wk")).agg(F.count("*").alias("n"), F.avg((F.col("category") == "other").cast("int")).alias("u"))
    return g.select("wk", "n", r6(F.col("u")).alias("unknown"), r6(F.col("u") - F.lag("u").over(W.partitionBy(F.lit(0)).orderBy("wk"))).alias("change"))


EDGE = "[^A-Za-z]"  # word edges that do not depend on what an engine calls a letter
RULES = [(label, f"(?i)(^|{EDGE})({words})({EDGE}|$)") for label, words in (("french", "les|des|une|dans|pour"), ("german", "der|das|und|nicht"), ("spanish", "los|del|por|una"), ("english", "the|and|with|that"))]
RULE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{label}'" for label, p in RULES) + " ELSE 'none' END"


@query("f06_ordered_classifier", f"SELECT doc_id, {RULE_SQL} AS kind FROM documents")
def f06(spark, d):
    return table(spark, d, "documents").select("doc_id", text.first_match(F.col("text"), RULES).alias("kind"))


@query("e10_descriptor_agreement", f"WITH x AS (SELECT doc_id, lang, {RULE_SQL} AS kind FROM documents) SELECT lang, kind, count(*) AS n, count(toxic) AS labelled, CAST(coalesce(sum(toxic), 0) AS BIGINT) AS toxic FROM x LEFT JOIN labels USING (doc_id) GROUP BY lang, kind")
def e10(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", text.first_match(F.col("text"), RULES).alias("kind")).join(table(spark, d, "labels"), "doc_id", "left")
    return x.groupBy("lang", "kind").agg(F.count("*").alias("n"), F.count("toxic").alias("labelled"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0)).alias("toxic"))


@query("e11_worst_case_shift", f"WITH {outcome_cte()}, x AS (SELECT sum(y) AS p, count(*) FILTER (WHERE category = 'other') AS k FROM outc) SELECT CAST(p AS BIGINT) AS positives, k AS unknown, {sql6('0.7 * k / (p + k)')} AS max_shift FROM x")
def e11(spark, d):
    x = outcomes(spark, d).agg(F.sum(F.col("y").cast("long")).alias("positives"), F.count(F.when(F.col("category") == "other", 1)).alias("unknown"))
    return x.select("*", r6(0.7 * F.col("unknown") / (F.col("positives") + F.col("unknown"))).alias("max_shift"))


@query("e12_index_row_shift", f"WITH {outcome_cte()}, x AS (SELECT y, eligible, cents - avg(cents) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS shift FROM outc) SELECT y, count(shift) AS n, round(avg(shift), 4) AS mean_shift FROM x WHERE eligible GROUP BY y")
def e12(spark, d):
    x = outcomes(spark, d).select("y", "eligible", (F.col("cents") - X.lagged_mean("cents", 5, SPEC)).alias("shift"))
    return x.where("eligible").groupBy("y").agg(F.count("shift").alias("n"), F.round(F.avg("shift"), 4).alias("mean_shift"))


@query("e13_gated_stratum", f"WITH {outcome_cte()}, g AS (SELECT season, count(*) AS n, CAST(sum(y) AS BIGINT) AS k FROM outc WHERE eligible GROUP BY season) SELECT season, n, k, CASE WHEN k >= 150 THEN 'fit' ELSE 'report only' END AS gate, {sql6('CASE WHEN k >= 150 THEN k::DOUBLE / n END')} AS rate FROM g")
def e13(spark, d):
    g = rates(outcomes(spark, d).where("eligible"), "y", ["season"])
    enough = F.col("k") >= 150
    return g.select("season", "n", "k", F.when(enough, "fit").otherwise("report only").alias("gate"), r6(F.when(enough, F.col("rate"))).alias("rate"))


@query("e14_rest_gradient", f"WITH {R_CTE}, g AS (SELECT CAST(rest AS INTEGER) AS rest, count(*) AS n, CAST(sum(y) AS BIGINT) AS k FROM rs WHERE eligible AND rest BETWEEN 1 AND 4 GROUP BY rest) SELECT rest, n, k, {RATE} FROM g")
def e14(spark, d):
    return rounded(rates(rested(spark, d).where("eligible and rest between 1 and 4"), "y", ["rest"]))


@query("f17_direction_words", f"WITH {outcome_cte()}, g AS (SELECT season, sum(y) AS o, count(*) * 0.35 AS e FROM outc WHERE eligible GROUP BY season) SELECT season, CASE WHEN o > e THEN 'under-predicts' WHEN o < e THEN 'over-predicts' ELSE 'equal' END AS says FROM g")
def f17(spark, d):
    g = outcomes(spark, d).where("eligible").groupBy("season").agg(F.sum("y").alias("o"), (F.count("*") * 0.35).alias("e"))
    return g.select("season", direction(F.col("o"), F.col("e")).alias("says"))


@query("f18_season_label", f"WITH {O_CTE} SELECT season, season || '-' || lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0') AS label, count(*) AS n FROM tr GROUP BY season")
def f18(spark, d):
    return trades(spark, d).groupBy("season", season_label(F.col("season")).alias("label")).agg(F.count("*").alias("n"))


@query("f16_exact_inequality", f"WITH {E_CTE} SELECT user_id, day, role IS DISTINCT FROM lag(role) OVER (PARTITION BY user_id ORDER BY ts) AS changed FROM app")
def f16(spark, d):
    return appearances(spark, d).select("user_id", "day", differs(F.col("role"), F.lag("role").over(SPEC.history())).alias("changed"))


@query("p14_restricted_cohort", f"WITH {R_CTE}, g AS (SELECT season, count(*) AS n, CAST(sum(y) AS BIGINT) AS k FROM rs WHERE eligible AND rest <= 2 GROUP BY season) SELECT season, n, k, {RATE} FROM g")
def p14(spark, d):
    return rounded(rates(rested(spark, d).where("eligible and rest <= 2"), "y", ["season"]))


@query("p17_ambiguous_attribution", f"WITH {O_CTE}, p AS (SELECT *, lag(day) OVER (PARTITION BY cust, season ORDER BY day) AS prev_day FROM tr), x AS (SELECT p.*, (q.grp IS NOT NULL AND p.grp IS DISTINCT FROM q.grp) AS switched FROM p LEFT JOIN tr q ON q.cust = p.cust AND q.day = p.prev_day) SELECT season, count(*) AS n, {sql6('avg(y)')} AS rate FROM x WHERE NOT switched AND prev_day IS NOT NULL GROUP BY season")
def p17(spark, d):
    from .linkage import j11

    x = j11(spark, d).join(trades(spark, d).select("cust", "day", "y", "season", F.lag("day").over(W.partitionBy("cust", "season").orderBy("day")).alias("prev_day")), ["cust", "day"])
    return x.where("not switched and prev_day is not null").groupBy("season").agg(F.count("*").alias("n"), r6(F.avg("y")).alias("rate"))


@query("p15_no_recent_event_cohort", f"WITH {outcome_cte()}, x AS (SELECT o.*, (SELECT count(*) FROM outc p WHERE p.user_id = o.user_id AND p.y = 1 AND p.day < o.day AND p.day >= o.day - 10) AS recent FROM outc o), g AS (SELECT season, count(*) AS n, CAST(sum(y) AS BIGINT) AS k FROM x WHERE eligible AND recent = 0 GROUP BY season) SELECT season, n, k, {RATE} FROM g")
def p15(spark, d):
    from ..operators import asof

    o = outcomes(spark, d)
    h = asof.history(o, o.where("y = 1").select("user_id", F.col("day").alias("event_day")), ["user_id"], "day", "event_day", 10)
    return rounded(rates(h.where("eligible and n_recent = 0").drop("k"), "y", ["season"]))


@query("p16_high_ascertainment", f"WITH {O_CTE}, g AS (SELECT season, count(*) AS n, CAST(sum(y) AS BIGINT) AS k FROM tr WHERE season >= 1998 GROUP BY season) SELECT season, n, k, {RATE} FROM g")
def p16(spark, d):
    return rounded(rates(trades(spark, d).where("season >= 1998"), "y", ["season"]))
