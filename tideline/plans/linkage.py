"""Queries on joins: linkage, as-of, schedules, dimensions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scalar import differs
from ..operators import asof, dims, link, sliced
from .registry import ORACLES, query
from .views import E_CTE, O_CTE, appearances, labels, outcome_cte, outcomes, table, trades

ROW = ["user_id", "day"]


@query("j01_left_join_wrong_key", "SELECT o_orderkey, n_name FROM orders LEFT JOIN nation ON n_nationkey = o_custkey AND n_regionkey = o_orderkey % 5")
def j01(spark, d):
    o, n = table(spark, d, "orders"), table(spark, d, "nation")
    return o.join(n, (F.col("n_nationkey") == F.col("o_custkey")) & (F.col("n_regionkey") == F.col("o_orderkey") % 5), "left").select("o_orderkey", "n_name")


@query("j02_dimension_join", "SELECT o_orderkey, o_custkey, c_mktsegment, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j02(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return dims.join_dimension(table(spark, d, "orders"), c, ["o_custkey"]).select("o_orderkey", "o_custkey", "c_mktsegment", "c_nationkey")


@query("j03_entities_with_events", f"WITH {E_CTE} SELECT user_id, count(*) AS n_rows FROM app WHERE user_id IN (SELECT user_id FROM lab WHERE category = 'alpha') GROUP BY user_id")
def j03(spark, d):
    return link.known_entities(appearances(spark, d), labels(spark, d).where("category = 'alpha'"), "user_id").groupBy("user_id").agg(F.count("*").alias("n_rows"))


@query("j04_interval_join", f"WITH {outcome_cte()} SELECT user_id, day, event_id, report_date, gap FROM pairs")
def j04(spark, d):
    return link.within_days(appearances(spark, d).select(*ROW), labels(spark, d), "user_id", "day", "report_date").select("user_id", "day", "event_id", "report_date", "gap")


@query("j05_nearest_event", f"WITH {outcome_cte()} SELECT user_id, day, event_id, gap FROM linked")
def j05(spark, d):
    pairs = link.within_days(appearances(spark, d).select(*ROW), labels(spark, d), "user_id", "day", "report_date")
    return link.nearest(pairs, ROW, ["gap", "event_id"]).select("user_id", "day", "event_id", "gap")


@query("j06_attach_outcomes", f"WITH {outcome_cte()} SELECT user_id, day, cents, event_id, category, gap, is_index, y, eligible FROM outc")
def j06(spark, d):
    return outcomes(spark, d).select("user_id", "day", "cents", "event_id", "category", "gap", "is_index", "y", "eligible")


@query("j07_previous_day", f"WITH {E_CTE} SELECT a.user_id, a.day, max(b.day) AS prev_day FROM app a LEFT JOIN app b ON a.user_id = b.user_id AND a.season = b.season AND b.day < a.day GROUP BY a.user_id, a.season, a.day")
def j07(spark, d):
    a = appearances(spark, d).select(*ROW, "season")
    return asof.previous_day(a, a.select("user_id", "season", F.col("day").alias("d2")), ["user_id", "season"], "day", "d2").select(*ROW, "prev_day")


PREV = "lag(day) OVER (PARTITION BY cust, season ORDER BY day)"
J8 = f"""WITH {O_CTE}, p AS (SELECT *, {PREV} AS prev_day FROM tr), s AS (SELECT DISTINCT grp, day FROM tr),
 x AS (SELECT cust, day, prev_day, CASE WHEN prev_day IS NOT NULL THEN (SELECT count(*) FROM s WHERE s.grp = p.grp AND s.day > p.prev_day AND s.day < p.day) END AS missed FROM p)"""


def missed_days(spark, d):
    """Each (customer, day) with its previous day and the group's days in between."""
    t = trades(spark, d)
    p = t.withColumn("prev_day", F.lag("day").over(W.partitionBy("cust", "season").orderBy("day")))
    return asof.between_counts(p, t.select("grp", F.col("day").alias("gday")), ["grp"], "prev_day", "day", "gday", "missed")


@query("j08_range_count", f"{J8} SELECT cust, day, prev_day, missed FROM x")
def j08(spark, d):
    return missed_days(spark, d).select("cust", "day", "prev_day", "missed")


@query("j07_previous_day_sliced", ORACLES["j07_previous_day"])
def j07s(spark, d):
    """J7 where a group may hold a third of all rows; j08 likewise."""
    a = appearances(spark, d).select(*ROW, "season")
    return sliced.previous_day(a, a.select("user_id", "season", F.col("day").alias("d2")), ["user_id", "season"], "day", "d2").select(*ROW, "prev_day")


@query("j08_range_count_sliced", ORACLES["j08_range_count"])
def j08s(spark, d):
    t = trades(spark, d)
    p = t.withColumn("prev_day", F.lag("day").over(W.partitionBy("cust", "season").orderBy("day")))
    return sliced.between_counts(p, t.select("grp", F.col("day").alias("gday")), ["grp"], "prev_day", "day", "gday", "missed").select("cust", "day", "prev_day", "missed")


@query("j09_group_gap", f"WITH {O_CTE}, s AS (SELECT DISTINCT grp, day FROM tr) SELECT cust, tr.day, CAST(date_diff('day', (SELECT max(s.day) FROM s WHERE s.grp = tr.grp AND s.day < tr.day), tr.day) AS INTEGER) AS group_gap FROM tr")
def j09(spark, d):
    t = trades(spark, d)
    x = asof.previous_day(t, t.select("grp", F.col("day").alias("gday")).distinct(), ["grp"], "day", "gday")
    return x.select("cust", "day", F.datediff("day", "prev_day").alias("group_gap"))


@query(
    "j11_lookup_at_two_dates",
    f"WITH {O_CTE}, p AS (SELECT *, {PREV} AS prev_day FROM tr) SELECT p.cust, p.day, p.grp, q.grp AS prev_grp, (q.grp IS NOT NULL AND p.grp IS DISTINCT FROM q.grp) AS switched FROM p LEFT JOIN tr q ON q.cust = p.cust AND q.day = p.prev_day",
)
def j11(spark, d):
    t = trades(spark, d)
    roster = t.select("cust", F.col("day").alias("prev_day"), F.col("grp").alias("prev_grp"))
    p = t.withColumn("prev_day", F.lag("day").over(W.partitionBy("cust", "season").orderBy("day"))).join(roster, ["cust", "prev_day"], "left")
    return p.select("cust", "day", "grp", "prev_grp", (F.col("prev_grp").isNotNull() & differs(F.col("grp"), F.col("prev_grp"))).alias("switched"))


@query("j12_recovered_ids", "SELECT o_orderkey, c_nationkey AS nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def j12(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    n = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    rows = table(spark, d, "orders").join(c, "o_custkey").join(n, "c_nationkey").select("o_orderkey", "n_name", F.when(F.col("o_orderkey") % 7 != 0, F.col("c_nationkey")).alias("nationkey"))
    return dims.recovered_ids(rows, "nationkey", "n_name").select("o_orderkey", "nationkey")


@query("j13_one_to_one", "SELECT o_orderkey, o_totalprice, count(*) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def j13(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    have = table(spark, d, "orders").join(lines.select("o_orderkey"), "o_orderkey", "left_semi")
    return dims.join_one_to_one(have, lines.join(have.select("o_orderkey"), "o_orderkey", "left_semi"), ["o_orderkey"]).select("o_orderkey", "o_totalprice", "n_lines")


COVER = "w AS (SELECT user_id, day, season FROM app WHERE n > 1), h AS (SELECT user_id, day, season FROM app WHERE k % 2 = 0)"


@query(
    "j14_coverage",
    f"""WITH {E_CTE}, {COVER}, a AS (SELECT season, count(*) AS missing FROM w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.user_id = w.user_id AND h.day = w.day) GROUP BY season),
 b AS (SELECT season, count(*) AS extra FROM h WHERE NOT EXISTS (SELECT 1 FROM w WHERE h.user_id = w.user_id AND h.day = w.day) GROUP BY season)
 SELECT coalesce(a.season, b.season) AS season, coalesce(missing, 0) AS missing, coalesce(extra, 0) AS extra FROM a FULL JOIN b ON a.season = b.season""",
)
def j14(spark, d):
    a = appearances(spark, d)
    return dims.coverage(a.where("n > 1"), a.where("k % 2 = 0"), ROW, "season")


VARIANT = "CASE p_partkey % 4 WHEN 0 THEN 'x / ' || p_name WHEN 1 THEN '(old) ' || p_name WHEN 2 THEN ' ' || p_name || '. ' ELSE p_name END"


@query("j15_alias_resolution", f"WITH v AS (SELECT p_partkey, {VARIANT} AS written, p_name FROM part), u AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name) SELECT v.p_partkey, v.written, v.p_name AS canonical FROM v JOIN u ON u.p_name = v.p_name WHERE strpos(v.p_name, '.') = 0")
def j15(spark, d):
    p = table(spark, d, "part").where("instr(p_name, '.') = 0")
    written = p.select("p_partkey", F.expr(VARIANT).alias("written"))
    tries = written.select("p_partkey", "written", F.explode(text.name_variants(F.col("written"))).alias("v")).select("p_partkey", "written", "v.rank", F.col("v.text").alias("canonical"))
    hit = tries.join(p.select(F.col("p_name").alias("canonical")).distinct(), "canonical")
    first = hit.withColumn("_r", F.row_number().over(W.partitionBy("p_partkey").orderBy("rank", "canonical"))).where("_r = 1")
    return first.select("p_partkey", "written", "canonical")


@query(
    "j16_keyed_diff",
    f"WITH {E_CTE}, b AS (SELECT user_id, day, cents, role, CASE WHEN k % 5 = 0 THEN cents + 1 ELSE cents END AS cents2, CASE WHEN k % 3 = 0 THEN NULL ELSE role END AS role2 FROM app) SELECT 'cents' AS column_name, count(*) AS n_compared, CAST(count(*) FILTER (WHERE cents IS DISTINCT FROM cents2) AS BIGINT) AS n_diff FROM b UNION ALL SELECT 'role', count(*), CAST(count(*) FILTER (WHERE role IS DISTINCT FROM role2) AS BIGINT) FROM b",
)
def j16(spark, d):
    from ..operators.audit import compare

    a = appearances(spark, d).select(*ROW, "k", "cents", "role")
    b = a.select(*ROW, F.when(F.col("k") % 5 == 0, F.col("cents") + 1).otherwise(F.col("cents")).alias("cents"), F.when(F.col("k") % 3 != 0, F.col("role")).alias("role"))
    return compare(a.drop("k"), b, ROW, ["cents", "role"])


@query("j16_digest_tree_diff", ORACLES["j16_keyed_diff"])
def j16_tree(spark, d):
    """J16 by digests of entity and season: rows are joined only where these differ."""
    from ..operators.audit import compare

    a = appearances(spark, d).select(*ROW, "season", "k", "cents", "role")
    b = a.select(*ROW, "season", F.when(F.col("k") % 5 == 0, F.col("cents") + 1).otherwise(F.col("cents")).alias("cents"), F.when(F.col("k") % 3 != 0, F.col("role")).alias("role"))
    return compare(a.drop("k"), b, ROW, ["cents", "role"], within=["user_id", "season"])


@query("j17_attach_columns", f"WITH {E_CTE} SELECT a.user_id, a.day, a.cents, m.mean_k FROM app a LEFT JOIN (SELECT user_id, {'floor(avg(k) * 1e6 + 0.5) / 1e6'} AS mean_k FROM app GROUP BY user_id HAVING count(*) > 5) m ON a.user_id = m.user_id")
def j17(spark, d):
    a = appearances(spark, d)
    m = a.groupBy("user_id").agg((F.floor(F.avg("k") * 1e6 + 0.5) / 1e6).alias("mean_k"), F.count("*").alias("c")).where("c > 5").drop("c")
    return a.join(m, "user_id", "left").select("user_id", "day", "cents", "mean_k")


@query("j18_pair_semi_join_count", f"WITH {E_CTE} SELECT count(*) AS n_matched FROM lab WHERE EXISTS (SELECT 1 FROM app WHERE app.user_id = lab.user_id AND app.day = lab.report_date)")
def j18(spark, d):
    a = appearances(spark, d).select("user_id", F.col("day").alias("report_date"))
    return labels(spark, d).join(a, ["user_id", "report_date"], "left_semi").agg(F.count("*").alias("n_matched"))


@query("j19_group_opener", f"WITH {O_CTE}, o AS (SELECT grp, season, min(day) AS opener FROM tr GROUP BY grp, season) SELECT cust, day, (day = opener) AS is_group_opener FROM tr JOIN o USING (grp, season)")
def j19(spark, d):
    t = trades(spark, d)
    o = t.groupBy("grp", "season").agg(F.min("day").alias("opener"))
    return t.join(o, ["grp", "season"], "left").select("cust", "day", (F.col("day") == F.col("opener")).alias("is_group_opener"))


BREAKS = """dd AS (SELECT DISTINCT grp, season, day FROM tr), g AS (SELECT grp, season, day, lag(day) OVER (PARTITION BY grp, season ORDER BY day) AS before FROM dd),
 br AS (SELECT grp, season, day AS resume, before FROM (SELECT *, row_number() OVER (PARTITION BY grp, season ORDER BY date_diff('day', before, day) DESC, day DESC) AS rn FROM g
 WHERE date_diff('day', before, day) BETWEEN 4 AND 12 AND day BETWEEN make_date(year(day), 1, 20) AND make_date(year(day), 3, 15)) WHERE rn = 1)"""


def breaks(spark, d):
    """Each group's break in each season: the panel's groups keep calendars of their own."""
    return dims.calendar_breaks(trades(spark, d), ["grp", "season"], "day", (4, 12), (1, 20), (3, 15))


@query("w19_calendar_break", f"WITH {O_CTE}, {BREAKS} SELECT grp, season, resume, before FROM br")
def w19(spark, d):
    return breaks(spark, d)


@query("j20_first_after_break", f"WITH {O_CTE}, {BREAKS}, x AS (SELECT cust, grp, season, day, lag(day) OVER (PARTITION BY cust, season ORDER BY day) AS prev_day FROM tr), f AS (SELECT x.*, before, row_number() OVER (PARTITION BY cust, x.grp, x.season ORDER BY day) AS rn FROM x JOIN br ON br.grp = x.grp AND br.season = x.season WHERE day >= resume) SELECT cust, grp, season, day, prev_day FROM f WHERE rn = 1 AND prev_day <= before")
def j20(spark, d):
    x = trades(spark, d).select("cust", "grp", "season", "day", F.lag("day").over(W.partitionBy("cust", "season").orderBy("day")).alias("prev_day"))
    f = x.join(F.broadcast(breaks(spark, d)), ["grp", "season"]).where("day >= resume")  # a row for each group and season
    f = f.withColumn("rn", F.row_number().over(W.partitionBy("cust", "grp", "season").orderBy("day")))
    return f.where("rn = 1 and prev_day <= before").select("cust", "grp", "season", "day", "prev_day")
