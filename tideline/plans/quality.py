"""Queries on audits and data quality."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import differs, r6
from ..operators import asof
from ..operators import audit as A
from ..operators import features as X
from ..operators import quality as Q
from ..operators.watch import Watch
from ..sources import scratch
from .registry import ORACLES, query
from .views import CATEGORIES, E_CTE, O_CTE, SPEC, appearances, labels, outcome_cte, outcomes, sql6, table, trades

KEYS = ["user_id", "day"]
H = "OVER (PARTITION BY {p} ORDER BY ts ROWS BETWEEN {f} AND 1 PRECEDING)"


def builder(panel):
    """Five clean features, and three leaks: of the row itself, of the next, of all rows."""
    w = SPEC.history()
    return panel.select(
        *KEYS, X.lagged_mean("cents", 5, SPEC).alias("r5"), F.lag("cents").over(w).alias("lag1"), X.season_sum("cents", SPEC).alias("season_cents"),
        X.trailing_count(7, SPEC).alias("rows_7d"), X.ordinal(w).alias("panel_rows"), X.concurrent_mean("cents", 5, SPEC).alias("c5"), F.lead("cents").over(w).alias("next_cents"),
        F.avg("cents").over(W.partitionBy("user_id")).alias("career_mean"),
    )


COLUMNS = ["r5", "lag1", "season_cents", "rows_7d", "panel_rows", "c5", "next_cents", "career_mean"]


def built(cte: str, source: str, name: str) -> str:
    five = H.format(p="user_id", f="5 PRECEDING")
    return f"""{name} AS (SELECT *, avg(cents) {five} AS r5, lag(cents) OVER (PARTITION BY user_id ORDER BY ts) AS lag1, coalesce(sum(cents) {H.format(p="user_id, season", f="UNBOUNDED PRECEDING")}, 0) AS season_cents,
 count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 604799999999 PRECEDING AND 1 PRECEDING) AS rows_7d, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS panel_rows,
 avg(cents) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c5, lead(cents) OVER (PARTITION BY user_id ORDER BY ts) AS next_cents,
 avg(cents) OVER (PARTITION BY user_id) AS career_mean FROM {source})"""


def diffs(select: str, tail: str) -> str:
    return " UNION ALL ".join(f"SELECT {select}'{c}' AS column_name, count(*) AS n_compared, count(*) FILTER (WHERE a.{c} IS DISTINCT FROM b.{c}) AS n_diff {tail}" for c in COLUMNS)


CUTS = ["2024-01-08", "2024-01-15", "2024-01-19", "2024-01-24"]


def cut_sql() -> str:
    parts = [diffs(f"DATE '{c}' AS cutoff, ", f"FROM (WITH {built('', f'''(SELECT * FROM app WHERE day < DATE '{c}')''', 'x')} SELECT * FROM x) b JOIN full_ a USING (user_id, day)") for c in CUTS]
    return f"WITH {E_CTE}, {built('', 'app', 'full_')} " + " UNION ALL ".join(parts)


@query("q01_future_truncation", cut_sql())
def q01(spark, d):
    cuts = spark.createDataFrame([(c,) for c in CUTS], "c string").select(F.to_date("c").alias("cutoff"))
    panel = appearances(spark, d)
    out = A.future_truncation(builder, panel, "day", KEYS, COLUMNS, cuts, "user_id")
    return out.select("cutoff", "column_name", "n_compared", "n_diff")


HIT = "row_number() OVER (PARTITION BY user_id ORDER BY md5('4:' || user_id || ':' || CAST(ts AS VARCHAR)))"


@query(
    "q02_same_row_perturbation",
    f"WITH {E_CTE}, hit AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('4:' || user_id || ':' || CAST(day AS VARCHAR))) = 1 AS h FROM app), moved AS (SELECT * REPLACE (CASE WHEN h THEN cents + 7 ELSE cents END AS cents) FROM hit), {built('', 'app', 'fa')}, {built('', 'moved', 'fb')} "
    + diffs("", "FROM fa a JOIN fb b ON a.user_id = b.user_id AND a.day = b.day WHERE b.h"),
)
def q02(spark, d):
    return A.same_row_perturbation(builder, appearances(spark, d), {"cents": F.col("cents") + 7}, KEYS, COLUMNS, "user_id", "day", 4)


LABEL_COLUMNS = ["y", "eligible", "n_before", "r5", "free_rest"]
#: Planted leaks with the test that has to catch each.
PLANTED = {"c5": "B", "career_mean": "A", "next_cents": "A", "free_rest": "D"}


def label_builder(spark, d):
    """From label records to features: history of events, and one that must not follow labels."""
    app = appearances(spark, d)
    past = SPEC.history().rowsBetween(*X.PAST)
    free_rest = F.datediff("day", F.last(F.when(F.col("y") == 0, F.col("day")), ignorenulls=True).over(past))  # planted: reads labels

    def build(lab):
        o = outcomes(spark, d, app=app, lab=lab)
        h = asof.history(o, o.where("y = 1").select("user_id", F.col("day").alias("event_day")), ["user_id"], "day", "event_day", 10)
        return h.select(*KEYS, "y", "eligible", "n_before", X.lagged_mean("cents", 5, SPEC).alias("r5"), free_rest.alias("free_rest"))

    return build


def label_cte(new: str, tag: str) -> str:
    """The outcome tables under rewritten labels, with names ending in ``tag``."""
    base = outcome_cte()[len(E_CTE) + 2 :]
    for name in ("pairs", "linked", "att2", "att", "outc"):
        base = base.replace(f"{name} AS (", f"{name}{tag} AS (").replace(f"FROM {name} ", f"FROM {name}{tag} ").replace(f"FROM {name})", f"FROM {name}{tag})").replace(f"JOIN {name} ", f"JOIN {name}{tag} ")
    base = base.replace("JOIN lab ", f"JOIN lab{tag} ")
    return f"lab{tag} AS ({new}), {base}, f{tag} AS (SELECT o.user_id, o.day, y, eligible, (SELECT count(*) FROM outc{tag} p WHERE p.user_id = o.user_id AND p.y = 1 AND p.day < o.day) AS n_before, avg(cents) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS r5, date_diff('day', max(CASE WHEN y = 0 THEN day END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), day) AS free_rest FROM outc{tag} o)"


def label_diffs(tail: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_compared, count(*) FILTER (WHERE a.{c} IS DISTINCT FROM b.{c}) AS n_diff FROM f1 a JOIN f2 b USING (user_id, day) {tail}" for c in LABEL_COLUMNS)


FLIP = "CASE category WHEN 'alpha' THEN 'other' WHEN 'other' THEN 'alpha' ELSE category END"


@query("q03_future_label_rewrite", f"WITH {E_CTE}, {label_cte('SELECT * FROM lab', '1')}, {label_cte(f'''SELECT event_id, user_id, report_date, CASE WHEN report_date >= DATE '2024-01-18' THEN {FLIP} ELSE category END AS category FROM lab''', '2')} {label_diffs('''WHERE day < DATE '2024-01-15' ''')}")
def q03(spark, d):
    lab = labels(spark, d)
    new = lab.withColumn("category", F.expr(f"case when report_date >= date'2024-01-18' then {FLIP} else category end"))
    return A.label_rewrite(label_builder(spark, d), lab, new, KEYS, LABEL_COLUMNS, F.col("day") < "2024-01-15")


@query("q04_label_independence", f"WITH {E_CTE}, {label_cte('SELECT * FROM lab', '1')}, {label_cte(f'SELECT event_id, user_id, report_date, {FLIP} AS category FROM lab', '2')} {label_diffs('')}")
def q04(spark, d):
    lab = labels(spark, d)
    return A.label_rewrite(label_builder(spark, d), lab, lab.withColumn("category", F.expr(FLIP)), KEYS, LABEL_COLUMNS)


@query("q04_label_independence_by_digest", ORACLES["q04_label_independence"])
def q04_digest(spark, d):
    """Q4, joining only the entities whose digests differ."""
    lab = labels(spark, d)
    return A.label_rewrite(label_builder(spark, d), lab, lab.withColumn("category", F.expr(FLIP)), KEYS, LABEL_COLUMNS, within=["user_id"])


def all_tests(spark, d):
    """Tests A, B and D; history columns are labels' own and exempt from D."""
    a = q01(spark, d).groupBy("column_name").agg(F.sum("n_compared").alias("n_compared"), F.sum("n_diff").alias("n_diff")).select(F.lit("A").alias("test"), "*")
    rewritten = q04(spark, d).where("column_name in ('r5', 'free_rest')")
    return a.unionByName(q02(spark, d).select(F.lit("B").alias("test"), "*")).unionByName(rewritten.select(F.lit("D").alias("test"), "*"))


def tests_sql() -> str:
    from .registry import ORACLES

    b, c = ORACLES["q02_same_row_perturbation"], ORACLES["q04_label_independence"]
    return f"t AS (SELECT 'A' AS test, column_name, n_diff FROM ({cut_sql()}) UNION ALL SELECT 'B', column_name, n_diff FROM ({b}) UNION ALL SELECT 'D', column_name, n_diff FROM ({c}) WHERE column_name IN ('r5', 'free_rest'))"


EXPECTED = ", ".join(f"('{c}', '{t}')" for c, t in PLANTED.items())


@query("q05_planted_leaks", f"WITH {tests_sql()}, e(column_name, expected) AS (VALUES {EXPECTED}), x AS (SELECT column_name, test, sum(n_diff) AS n FROM t GROUP BY ALL) SELECT column_name, expected, string_agg(test, ',' ORDER BY test) AS tests, bool_or(test = expected) AS caught FROM x JOIN e USING (column_name) WHERE n > 0 GROUP BY column_name, expected")
def q05(spark, d):
    """Each planted leak, the test that must catch it, and those that did; the leak of labels is
    none of A's and B's business, so that it controls test D alone."""
    expected = spark.createDataFrame(list(PLANTED.items()), "column_name string, expected string")
    found = A.adjudicated(all_tests(spark, d)).where("failed > 0").join(F.broadcast(expected), "column_name")
    return found.select("column_name", "expected", "tests", F.array_contains(F.split("tests", ","), F.col("expected")).alias("caught"))


@query("q06_must_fail_control", f"WITH {tests_sql()} SELECT 'c5' AS column_name, CASE WHEN sum(n_diff) > 0 THEN 'caught' ELSE 'missed' END AS verdict FROM t WHERE column_name = 'c5'")
def q06(spark, d):
    return A.adjudicated(all_tests(spark, d), ["c5"]).where("column_name = 'c5'").select("column_name", "verdict")


@query("q07_adjudication", f"WITH {tests_sql()}, x AS (SELECT column_name, test, sum(n_diff) AS n FROM t GROUP BY ALL), z AS (SELECT column_name, count(*) FILTER (WHERE n > 0) AS failed, coalesce(string_agg(test, ',' ORDER BY test) FILTER (WHERE n > 0), '') AS tests FROM x GROUP BY column_name) SELECT column_name, failed, tests, CASE WHEN column_name IN ({', '.join(map(repr, PLANTED))}) THEN CASE WHEN failed > 0 THEN 'caught' ELSE 'missed' END WHEN failed > 0 THEN 'leak' ELSE 'clean' END AS verdict FROM z")
def q07(spark, d):
    return A.adjudicated(all_tests(spark, d), list(PLANTED))


PAIRS = [("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount")]
SWEEP = " UNION ALL ".join(f"SELECT '{a}/{b}' AS pair, CAST(year(l_shipdate) AS INTEGER) AS season, l_orderkey || ':' || l_linenumber AS id FROM lineitem WHERE {a} > 0 AND {b} = 0" for a, b in PAIRS)
H8 = "('0x' || substr(md5(id), 1, 8))::BIGINT"
SQL_DIGEST = f"CAST(sum({H8}) AS VARCHAR) || ':' || CAST(bit_xor({H8}) AS VARCHAR)"
CELLS = f"SELECT pair, season, count(*) AS n, {SQL_DIGEST} AS digest FROM ({SWEEP}) GROUP BY pair, season"


def lines(spark, d):
    return table(spark, d, "lineitem").withColumns({"season": F.year("l_shipdate").cast("int"), "id": F.concat_ws(":", "l_orderkey", "l_linenumber")})


def cells(spark, d):
    return Q.contradictions(lines(spark, d), PAIRS, ["season"], "id")


@query("q08_contradiction_sweep", CELLS)
def q08(spark, d):
    return cells(spark, d)


@query("q09_defect_ledger", f"WITH c AS ({CELLS}), l AS (SELECT pair, season, CASE WHEN season % 4 = 1 THEN n + 1 ELSE n END AS n, CASE WHEN season % 4 = 2 THEN 'x' ELSE digest END AS digest FROM c WHERE season % 4 <> 3) SELECT c.pair, c.season, CASE WHEN l.n IS NULL THEN 'unexpected' WHEN l.n <> c.n THEN 'count changed' WHEN l.digest <> c.digest THEN 'other rows' ELSE 'known' END AS state FROM c LEFT JOIN l USING (pair, season)")
def q09(spark, d):
    c = cells(spark, d)
    s = F.col("season") % 4
    ledger = c.where(s != 3).select("pair", "season", F.when(s == 1, F.col("n") + 1).otherwise(F.col("n")).alias("n"), F.when(s == 2, "x").otherwise(F.col("digest")).alias("digest"))
    return Q.against_ledger(c, ledger, ["pair", "season"])


STORED = f"{E_CTE}, x AS (SELECT a.user_id, a.day, a.k, CAST(date_diff('day', lag(day) OVER (PARTITION BY user_id, season ORDER BY ts), day) AS INTEGER) AS rest, (SELECT max(b.day) FROM app b WHERE b.user_id = a.user_id AND b.season = a.season AND b.day < a.day) AS prev FROM app a), s AS (SELECT *, CASE WHEN k = 7 THEN 99 ELSE rest END AS stored, CAST(date_diff('day', prev, day) AS INTEGER) AS recomputed FROM x)"


def reconstructed(spark, d):
    """A stored rest column (with planted faults) beside one rebuilt in another way."""
    a = appearances(spark, d)
    s = a.withColumn("stored", F.when(F.col("k") == 7, 99).otherwise(X.rest_days(SPEC)))
    r = asof.previous_day(s, a.select("user_id", "season", F.col("day").alias("d2")), ["user_id", "season"], "day", "d2")
    return r.withColumn("recomputed", F.datediff("day", "prev_day"))


@query("q10_reconstruction", f"WITH {STORED} SELECT count(*) AS n, count(*) FILTER (WHERE stored IS DISTINCT FROM recomputed) AS mismatches FROM s")
def q10(spark, d):
    return reconstructed(spark, d).agg(F.count("*").alias("n"), F.count(F.when(differs(F.col("stored"), F.col("recomputed")), 1)).alias("mismatches"))


@query("q11_false_openers", f"WITH {STORED} SELECT count(*) FILTER (WHERE stored IS NULL AND recomputed IS NOT NULL) AS false_openers, count(*) FILTER (WHERE stored IS NOT NULL AND recomputed IS NULL) AS missed_openers FROM s")
def q11(spark, d):
    s, r = F.col("stored"), F.col("recomputed")
    return reconstructed(spark, d).agg(F.count(F.when(s.isNull() & r.isNotNull(), 1)).alias("false_openers"), F.count(F.when(s.isNotNull() & r.isNull(), 1)).alias("missed_openers"))


ART = "art AS (SELECT cust, day, season, n FROM tr WHERE cust % 50 <> 3)"


@query("q12_artifact_coverage", f"WITH {O_CTE}, {ART} SELECT tr.season, count(*) AS missing, CAST(0 AS BIGINT) AS extra FROM tr LEFT JOIN art ON art.cust = tr.cust AND art.day = tr.day WHERE art.cust IS NULL GROUP BY tr.season")
def q12(spark, d):
    from ..operators.dims import coverage

    t = trades(spark, d)
    return coverage(t, t.where("cust % 50 <> 3"), ["cust", "day"], "season").select("season", "missing", F.col("extra").cast("long").alias("extra"))


@query("q13_cardinality_rule", "SELECT l_orderkey, count(*) AS n_lines, count(DISTINCT l_linenumber) AS n_numbers FROM lineitem GROUP BY l_orderkey HAVING count(*) <> 4 OR count(DISTINCT l_linenumber) <> count(*)")
def q13(spark, d):
    return Q.cardinality(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", 4).select("l_orderkey", F.col("n_rows").alias("n_lines"), F.col("n_distinct").alias("n_numbers"))


@query("q14_named_row", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 1")
def q14(spark, d):
    return table(spark, d, "orders").where("o_orderkey = 1").select("o_orderkey", "o_custkey", "o_orderstatus")


INV = f"WITH {outcome_cte()}, x AS (SELECT *, CAST(date_diff('day', lag(day) OVER (PARTITION BY user_id, season ORDER BY ts), day) AS INTEGER) AS rest, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pr, row_number() OVER (PARTITION BY user_id, season ORDER BY ts) - 1 AS sr FROM outc)"


@query("q15_builder_checks", f"{INV} SELECT 'season rows exceed panel rows' AS rule, count(*) FILTER (WHERE sr > pr) AS violations FROM x UNION ALL SELECT 'rest below one day', count(*) FILTER (WHERE rest < 1) FROM x UNION ALL SELECT 'rest beyond the season', count(*) FILTER (WHERE rest > 6) FROM x UNION ALL SELECT 'opener with earlier rows', count(*) FILTER (WHERE rest IS NULL AND sr > 0) FROM x")
def q15(spark, d):
    x = outcomes(spark, d).withColumns({"rest": X.rest_days(SPEC), "pr": X.ordinal(SPEC.history()), "sr": X.ordinal(SPEC.in_season())})
    return Q.violations(x, {
        "season rows exceed panel rows": F.col("sr") > F.col("pr"), "rest below one day": F.col("rest") < 1,
        "rest beyond the season": F.col("rest") > 6, "opener with earlier rows": F.col("rest").isNull() & (F.col("sr") > 0),
    })


@query("q16_hard_invariants", f"WITH {outcome_cte()} SELECT 'positive but not eligible' AS rule, count(*) FILTER (WHERE y = 1 AND NOT eligible) AS violations FROM outc UNION ALL SELECT 'positive without event', count(*) FILTER (WHERE y = 1 AND event_id IS NULL) FROM outc UNION ALL SELECT 'gap outside the window', count(*) FILTER (WHERE gap NOT BETWEEN 1 AND 3) FROM outc")
def q16(spark, d):
    return Q.violations(outcomes(spark, d), {"positive but not eligible": (F.col("y") == 1) & ~F.col("eligible"), "positive without event": (F.col("y") == 1) & F.col("event_id").isNull(), "gap outside the window": ~F.col("gap").between(1, 3)})


@query("q17_row_count_kept", f"WITH {outcome_cte()} SELECT (SELECT count(*) FROM app) AS before, (SELECT count(*) FROM outc) AS after, (SELECT count(*) FROM app) = (SELECT count(*) FROM outc) AS kept")
def q17(spark, d):
    return Q.same_count(appearances(spark, d), outcomes(spark, d))


@query("q17_count_kept_in_one_pass", ORACLES["q17_row_count_kept"])
def q17_watched(spark, d):
    """Q17 while the linked panel is written: both counts come with that job."""
    watch = Watch()
    out = outcomes(spark, d, app=watch.rows(scratch.written(appearances(spark, d), "panel"), "before"))
    scratch.written(watch.rows(out, "after"), "outcomes")
    n = watch.counts()
    return spark.createDataFrame([(n["before"], n["after"], n["before"] == n["after"])], "before long, after long, kept boolean")


@query("q18_unknown_values", f"WITH {E_CTE} SELECT DISTINCT category AS value, 'not declared' AS state FROM lab WHERE category NOT IN ('alpha', 'beta', 'gamma', 'ex1', 'never') UNION ALL SELECT 'never', 'not seen'")
def q18(spark, d):
    return Q.vocabulary(labels(spark, d), "category", [*(c for c in CATEGORIES if c not in ("ex2", "other")), "never"])


@query("q19_cohort_identities", f"WITH {outcome_cte()} SELECT count(*) AS total, count(*) FILTER (WHERE eligible) AS kept, count(*) FILTER (WHERE NOT eligible) AS reserved, count(*) = count(*) FILTER (WHERE eligible) + count(*) FILTER (WHERE NOT eligible) AS adds_up FROM outc")
def q19(spark, d):
    n = lambda c: F.count(F.when(c, 1))
    x = outcomes(spark, d).agg(F.count("*").alias("total"), n(F.col("eligible")).alias("kept"), n(~F.col("eligible")).alias("reserved"))
    return x.withColumn("adds_up", F.col("total") == F.col("kept") + F.col("reserved"))


@query("q20_anchor", f"WITH {E_CTE}, r AS (SELECT season, avg(cents) AS v FROM app GROUP BY season), s AS (SELECT season, CASE WHEN season = 2 THEN v * 1.01 ELSE v END AS v FROM r) SELECT season, abs(r.v - s.v) <= 1e-6 AS equal FROM r JOIN s USING (season)")
def q20(spark, d):
    r = appearances(spark, d).groupBy("season").agg(F.avg("cents").alias("v"))
    s = r.select("season", F.when(F.col("season") == 2, F.col("v") * 1.01).otherwise(F.col("v")).alias("v"))
    return Q.anchored(s, r, ["season"], "v", 1e-6)


@query("q21_fault_injection", f"WITH f AS (SELECT * REPLACE (CASE WHEN md5(l_orderkey || ':' || l_linenumber) < '01' THEN 0.0 ELSE l_tax END AS l_tax) FROM lineitem) SELECT CAST(year(l_shipdate) AS INTEGER) AS season, count(*) FILTER (WHERE l_quantity > 0 AND l_tax = 0) AS with_fault FROM f GROUP BY 1")
def q21(spark, d):
    f = Q.with_faults(lines(spark, d), "l_tax", 0.0, F.md5("id") < "01")
    return f.groupBy("season").agg(F.count(F.when((F.col("l_quantity") > 0) & (F.col("l_tax") == 0), 1)).alias("with_fault"))


@query("r06_effective_change", f"WITH {E_CTE}, h AS (SELECT user_id, cents, row_number() OVER (ORDER BY md5(CAST(user_id AS VARCHAR))) AS i, count(*) OVER () AS m FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('9:' || user_id || ':' || CAST(day AS VARCHAR))) AS r FROM app) WHERE r = 1) SELECT {sql6('avg((a.cents <> b.cents)::INT)')} AS changed FROM h a JOIN h b ON b.i = a.i % a.m + 1")
def r06e(spark, d):
    from .scoring import r06

    return r06(spark, d).agg(r6(F.avg((F.col("old_cents") != F.col("new_cents")).cast("int"))).alias("changed"))


@query("w_first_and_last_row", f"WITH {E_CTE} SELECT user_id, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM app GROUP BY user_id")
def first_last(spark, d):
    w = W.partitionBy("user_id")
    x = appearances(spark, d).select("user_id", "day", F.min("day").over(w).alias("first_day"), F.max("day").over(w).alias("last_day"), F.count("*").over(w).alias("n"))
    return x.where("day = first_day").select("user_id", "first_day", "last_day", "n")
