"""Queries on scans, projections, predicates, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.scalar import clip, finite, in_year_range, is_true, r6, right_closed, season_of, to_number
from ..operators import features as X
from ..operators.watch import Watch
from ..sources import ingest, scratch, sinks
from .registry import query
from .views import E_CTE, EXCLUDED, O_CTE, SPEC, appearances, events, labels, outcome_cte, outcomes, sql6, table, trades


@query("s04_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem")
def s04(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_quantity")


@query("s05_gated_projection", f"WITH {E_CTE} SELECT user_id, day, n FROM app")
def s05(spark, d):
    return ingest.gated(appearances(spark, d).select("user_id", "day", "n", "cents"), ["cents"])


@query(
    "s02_malformed_lines_apart",
    """SELECT CASE WHEN o_orderkey % 5 < 3 THEN 'good' ELSE 'bad' END AS side, count(*) AS lines, CAST(sum(CASE WHEN o_orderkey % 5 < 3 THEN o_custkey END) AS BIGINT) AS custkeys FROM orders GROUP BY 1""",
)
def s02(spark, d):
    """Orders as CSV whose lines are short or mistyped for some keys: every line is on one side."""
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    line = F.when(F.col("o_orderkey") % 5 == 3, key).when(F.col("o_orderkey") % 5 == 4, F.concat_ws(",", key, F.lit("no number"))).otherwise(F.concat_ws(",", key, cust))
    path = scratch.new_path(spark, "lines")
    table(spark, d, "orders").select(line.alias("o_orderkey,o_custkey")).write.option("header", True).option("quote", "\u0000").option("escapeQuotes", False).option("quoteAll", False).option("sep", "\u0001").csv(path)
    good, bad = ingest.read_csv_lenient(spark, path, T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType())]))
    sides = good.agg(F.lit("good").alias("side"), F.count("*").alias("lines"), F.sum("o_custkey").alias("custkeys"))
    return sides.unionByName(bad.agg(F.lit("bad").alias("side"), F.count("*").alias("lines"), F.lit(None).cast("long").alias("custkeys")))


@query("s06_files_of_different_headers", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 3 < 2")
def s06(spark, d):
    """Orders in files of swapped and further columns, one of them left out by its name."""
    path, o = scratch.new_path(spark, "files"), table(spark, d, "orders")
    o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_custkey").write.option("header", True).csv(f"{path}/a")
    o.where("o_orderkey % 3 = 1").select("o_custkey", "o_orderstatus", "o_orderkey").write.option("header", True).option("compression", "gzip").csv(f"{path}/b")
    o.where("o_orderkey % 3 = 2").select("o_orderkey").write.option("header", True).csv(f"{path}/c")
    long_ = [T.StructField(c, T.LongType()) for c in ("o_orderkey", "o_custkey")]
    return ingest.read_csvs(spark, f"{path}/[ab]/*", r"\.crc$", T.StructType(long_)).select("o_orderkey", "o_custkey", "o_orderstatus")


@query(
    "s12_stored_variants",
    f"""WITH {E_CTE}, v AS (SELECT w AS match_window, a.user_id, a.day, l.event_id FROM app a JOIN lab l ON a.user_id = l.user_id, (VALUES (1), (2), (3)) x(w) WHERE date_diff('day', a.day, l.report_date) BETWEEN 1 AND w)
 SELECT match_window, user_id, day, event_id FROM v WHERE match_window = 1 OR match_window = 2 AND event_id % 2 = 0""",
)
def s12_stored(spark, d):
    """One dataset for each window, written as partitions; window 2 is then rewritten alone, and 1 and 2 are read."""
    from ..operators.link import within_days

    path = scratch.new_path(spark, "variants")
    pairs = within_days(appearances(spark, d).select("user_id", "day"), labels(spark, d), "user_id", "day", "report_date")
    variants = pairs.select("user_id", "day", "event_id", F.explode(F.sequence(F.col("gap"), F.lit(3))).alias("match_window"))
    sinks.write_variants(variants, path, ["match_window"])
    sinks.write_variants(variants.where("match_window = 2 and event_id % 2 = 0"), path, ["match_window"])
    return spark.read.parquet(path).where("match_window in (1, 2)").select("match_window", "user_id", "day", "event_id")


@query("s12_window_variants", f"WITH {E_CTE} " + " UNION ALL ".join(f"SELECT {w} AS match_window, count(*) AS n_pairs FROM app a JOIN lab l ON a.user_id = l.user_id AND date_diff('day', a.day, l.report_date) BETWEEN 1 AND {w}" for w in (1, 2, 3)))
def s12(spark, d):
    from ..operators.link import within_days

    pairs = within_days(appearances(spark, d).select("user_id", "day"), labels(spark, d), "user_id", "day", "report_date")
    return pairs.select(F.explode(F.sequence(F.col("gap"), F.lit(3))).alias("match_window")).groupBy("match_window").agg(F.count("*").alias("n_pairs"))


@query("p01_season", "SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) >= 10 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS INTEGER) AS season FROM orders")
def p01(spark, d):
    return table(spark, d, "orders").select("o_orderkey", season_of(F.col("o_orderdate")).cast("int").alias("season"))


@query("p02_scope", "SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def p02(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("click", "view", "purchase")).select("event_id", "user_id")


@query("p03_active_exposure", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0 AND l_discount IS NOT NULL")
def p03(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_discount").isNotNull() & (F.col("l_discount") > 0)).select("l_orderkey", "l_linenumber")


@query("p04_labelled_span", f"WITH {O_CTE} SELECT count(*) FILTER (WHERE season BETWEEN 1996 AND 1999) AS kept, count(*) FILTER (WHERE NOT season BETWEEN 1996 AND 1999) AS dropped FROM tr")
def p04(spark, d):
    inside = F.col("season").between(1996, 1999)
    return trades(spark, d).agg(F.count(F.when(inside, 1)).alias("kept"), F.count(F.when(~inside, 1)).alias("dropped"))


@query("p04_counted_filter", f"WITH {O_CTE} SELECT season, count(*) AS n, (SELECT count(*) FROM tr WHERE NOT season BETWEEN 1996 AND 1999) AS dropped FROM tr WHERE season BETWEEN 1996 AND 1999 GROUP BY season")
def p04_counted(spark, d):
    """Rows of the span by season, written in one job; how many rows were dropped is known when it has ended."""
    watch = Watch()
    kept = watch.filtered(trades(spark, d), "span", F.col("season").between(1996, 1999))
    by_season = scratch.written(kept.groupBy("season").agg(F.count("*").alias("n")), "span")
    return by_season.withColumn("dropped", F.lit(watch.counts()["span.dropped"]).cast("long"))


@query("p05_drop_null_keys", f"WITH {E_CTE} SELECT user_id, day, role FROM app WHERE role IS NOT NULL")
def p05(spark, d):
    return appearances(spark, d).na.drop(subset=["role"]).select("user_id", "day", "role")


@query("p06_lower_date_bound", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1998-10-01'")
def p06(spark, d):
    return table(spark, d, "orders").where("o_orderdate >= date'1998-10-01'").select("o_orderkey")


@query("p07_competing_outcome", f"WITH {outcome_cte()} SELECT user_id, day, y FROM outc WHERE coalesce(category, '') <> 'gamma'")
def p07(spark, d):
    return outcomes(spark, d).where(~is_true(F.col("category") == "gamma")).select("user_id", "day", "y")


@query("p09_excluded_with_exception", f"WITH {outcome_cte()} SELECT user_id, day, coalesce(category IN ('ex1', 'ex2'), false) AND NOT coalesce(k > 50, false) AS excluded FROM outc")
def p09(spark, d):
    return outcomes(spark, d).select("user_id", "day", (is_true(F.col("category").isin(*EXCLUDED)) & ~is_true(F.col("k") > 50)).alias("excluded"))


@query("p10_eligibility_mask", f"WITH {outcome_cte()} SELECT user_id, day, eligible FROM outc")
def p10(spark, d):
    return outcomes(spark, d).select("user_id", "day", "eligible")


@query("p11_minimum_history", f"WITH {outcome_cte()}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS panel_rows FROM outc) SELECT user_id, day, panel_rows FROM x WHERE eligible AND panel_rows >= 5")
def p11(spark, d):
    x = outcomes(spark, d).withColumn("panel_rows", X.ordinal(SPEC.history()))
    return x.where("eligible and panel_rows >= 5").select("user_id", "day", "panel_rows")


@query("p12_complete_cases", f"WITH {outcome_cte()} SELECT user_id, day, role, gap FROM outc WHERE role IS NOT NULL AND gap IS NOT NULL")
def p12(spark, d):
    return outcomes(spark, d).na.drop(subset=["role", "gap"]).select("user_id", "day", "role", "gap")


@query("p13_temporal_split", f"WITH {O_CTE} SELECT CASE WHEN season <= 1997 THEN 'train' WHEN season = 1998 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM tr GROUP BY 1")
def p13(spark, d):
    s = F.col("season")
    return trades(spark, d).groupBy(F.when(s <= 1997, "train").when(s == 1998, "val").otherwise("test").alias("split")).agg(F.count("*").alias("n"))


@query("p19_infinities_to_null", f"WITH {E_CTE} SELECT user_id, day, {sql6('cents / nullif(k - 1, 0)::DOUBLE')} AS ratio FROM app")
def p19(spark, d):
    ratio = F.when(F.col("k") == 1, F.lit(float("inf"))).otherwise(F.try_divide("cents", F.col("k") - 1))
    return appearances(spark, d).select("user_id", "day", r6(finite(ratio)).alias("ratio"))


@query("p20_coerce_numeric", "SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS size FROM part")
def p20(spark, d):
    raw = F.when(F.col("p_partkey") % 3 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", to_number(raw).alias("size"))


@query("p23_right_closed_bins", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 'low' WHEN l_quantity > 10 AND l_quantity <= 30 THEN 'mid' WHEN l_quantity > 30 AND l_quantity <= 45 THEN 'high' END AS bin FROM lineitem")
def p23(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", right_closed(F.col("l_quantity"), [0, 10, 30, 45], ["low", "mid", "high"]).alias("bin"))


@query("p24_clip", f"WITH {outcome_cte()} SELECT user_id, day, CAST(CASE WHEN gap IS NOT NULL THEN least(gap, 2) END AS INTEGER) AS gap FROM outc")
def p24(spark, d):
    return outcomes(spark, d).select("user_id", "day", clip(F.col("gap"), high=2).alias("gap"))


@query("p25_missing_indicators", f"WITH {outcome_cte()} SELECT user_id, day, CAST(role IS NULL AS INTEGER) AS role_missing, CAST(gap IS NULL AS INTEGER) AS gap_missing FROM outc")
def p25(spark, d):
    return outcomes(spark, d).select("user_id", "day", *(F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in ("role", "gap")))


@query("p26_default_fill", f"WITH {outcome_cte()} SELECT user_id, day, coalesce(gap, 3650) AS gap, coalesce(role, 'U') AS role FROM outc")
def p26(spark, d):
    return outcomes(spark, d).na.fill({"gap": 3650, "role": "U"}).select("user_id", "day", "gap", "role")


@query("p27_cohort_z_score", f"WITH {E_CTE}, m AS (SELECT avg(cents) AS mu, stddev_samp(cents) AS sd FROM app) SELECT user_id, day, round((cents - mu) / sd, 4) AS z FROM app, m")
def p27(spark, d):
    a = appearances(spark, d)
    m = a.agg(F.avg("cents").alias("mu"), F.stddev_samp("cents").alias("sd"))
    return a.join(F.broadcast(m)).select("user_id", "day", F.round((F.col("cents") - F.col("mu")) / F.col("sd"), 4).alias("z"))


@query("p28_cluster_key", f"WITH {E_CTE} SELECT user_id || '_' || season AS cluster, count(*) AS n FROM app GROUP BY 1")
def p28(spark, d):
    return appearances(spark, d).groupBy(F.concat_ws("_", "user_id", "season").alias("cluster")).agg(F.count("*").alias("n"))


@query("p29_null_propagating_concat", f"WITH {E_CTE} SELECT user_id, day, 'u' || user_id || ' ' || role AS label FROM app")
def p29(spark, d):
    return appearances(spark, d).select("user_id", "day", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(" "), F.col("role")).alias("label"))


@query("p30_derived_flag", f"WITH {outcome_cte()} SELECT user_id, day, CAST(event_id IS NOT NULL AS INTEGER) AS has_event FROM outc")
def p30(spark, d):
    return outcomes(spark, d).select("user_id", "day", F.col("event_id").isNotNull().cast("int").alias("has_event"))


@query("p31_one_vs_rest_targets", f"WITH {outcome_cte()} SELECT user_id, day, " + ", ".join(f"CAST(coalesce(tissue = {k}, false) AND y = 1 AS INTEGER) AS y{k}" for k in (1, 2, 3)) + " FROM outc")
def p31(spark, d):
    return outcomes(spark, d).select("user_id", "day", *((is_true(F.col("tissue") == k) & (F.col("y") == 1)).cast("int").alias(f"y{k}") for k in (1, 2, 3)))


@query("o04_first_offenders", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_discount = 0 ORDER BY l_quantity DESC, l_orderkey, l_linenumber LIMIT 10")
def o04(spark, d):
    x = table(spark, d, "lineitem").where("l_discount = 0").select("l_orderkey", "l_linenumber", "l_quantity")
    return x.orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber").limit(10)  # a top-k report


@query("o05_top_correlations", f"WITH {outcome_cte()} SELECT * FROM (SELECT 'cents' AS feature, round(corr(cents, y), 6) AS r FROM outc UNION ALL SELECT 'n', round(corr(n, y), 6) FROM outc UNION ALL SELECT 'k', round(corr(k, y), 6) FROM outc) ORDER BY abs(r) DESC LIMIT 2")
def o05(spark, d):
    from .cohorts import a14

    return a14(spark, d).orderBy(F.desc(F.abs("r"))).limit(2)


@query("u01_union", "SELECT 'c' AS side, c_nationkey AS nationkey, count(*) AS n FROM customer GROUP BY 1, 2 UNION ALL SELECT 's', s_nationkey, count(*) FROM supplier GROUP BY 1, 2")
def u01(spark, d):
    c = table(spark, d, "customer").select(F.lit("c").alias("side"), F.col("c_nationkey").alias("nationkey"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.lit("s").alias("side"))
    return ingest.union_all([c, s]).groupBy("side", "nationkey").agg(F.count("*").alias("n"))


@query("u02_intersect_except", f"WITH {E_CTE}, a AS (SELECT user_id FROM app WHERE k > 90), b AS (SELECT user_id FROM lab WHERE category = 'alpha') SELECT 'both' AS part, user_id FROM (SELECT user_id FROM a INTERSECT SELECT user_id FROM b) UNION ALL SELECT 'only_a', user_id FROM (SELECT user_id FROM a EXCEPT SELECT user_id FROM b)")
def u02(spark, d):
    a = appearances(spark, d).where("k > 90").select("user_id")
    b = labels(spark, d).where("category = 'alpha'").select("user_id")
    return a.intersect(b).select(F.lit("both").alias("part"), "user_id").unionByName(a.subtract(b).select(F.lit("only_a").alias("part"), "user_id"))


@query("u03_symmetric_difference", f"WITH {E_CTE}, a AS (SELECT DISTINCT user_id, day FROM ev WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id, day FROM ev WHERE event_type = 'view') SELECT user_id, day FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))")
def u03(spark, d):
    ev = events(spark, d)
    a, b = (ev.where(F.col("event_type") == t).select("user_id", "day").distinct() for t in ("click", "view"))
    return a.join(b, ["user_id", "day"], "left_anti").unionByName(b.join(a, ["user_id", "day"], "left_anti"))


@query("u04_index_intersection", f"WITH {E_CTE} SELECT user_id, day FROM app WHERE EXISTS (SELECT 1 FROM lab WHERE lab.user_id = app.user_id AND lab.report_date = app.day)")
def u04(spark, d):
    return appearances(spark, d).select("user_id", "day").join(labels(spark, d).select("user_id", F.col("report_date").alias("day")), ["user_id", "day"], "left_semi")


@query("u05_distinct_projection", f"WITH {O_CTE} SELECT DISTINCT grp, day FROM tr")
def u05(spark, d):
    return trades(spark, d).select("grp", "day").distinct()


@query("f01_lenient_time", "SELECT o_orderkey, TRY_CAST(CASE o_orderkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP)::DATE AS day FROM orders")
def f01(spark, d):
    from ..functions.scalar import to_time

    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, "unknown").when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "orders").select("o_orderkey", F.to_date(to_time(raw)).alias("day"))


@query("f04_strict_category", "SELECT o_orderkey, coalesce(regexp_matches(o_orderpriority, '(?i)urgent'), false) OR (lower(trim(o_orderstatus)) IN ('p') AND NOT coalesce(o_orderpriority IN ('5-LOW', '2-HIGH'), false)) AS strict FROM orders")
def f04(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.strict_category(F.col("o_orderstatus"), F.col("o_orderpriority"), "(?i)urgent", ["p"], ["5-LOW", "2-HIGH"]).alias("strict"))


@query("f05_tripwire_vocabulary", "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE regexp_matches(o_orderpriority, '(?i)(urgent|high|spec)') AND o_orderpriority NOT IN ('1-URGENT')")
def f05(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").where(p.rlike("(?i)(urgent|high|spec)") & ~p.isin("1-URGENT")).select(p.alias("value")).distinct()


@query("f07_category_map", f"WITH {E_CTE} SELECT event_id, CASE category WHEN 'alpha' THEN 1 WHEN 'beta' THEN 2 WHEN 'gamma' THEN 3 END AS code FROM lab")
def f07(spark, d):
    from .views import TISSUE

    return labels(spark, d).select("event_id", F.coalesce(*(F.when(F.col("category") == c, F.lit(n)) for c, n in TISSUE.items())).alias("code"))


@query("f08_strip_prefix", "SELECT p_partkey, regexp_replace(CASE WHEN p_partkey % 2 = 0 THEN 'Left ' ELSE 'Right ' END || p_name, '^(Left|Right) ', '') AS name FROM part")
def f08(spark, d):
    side = F.when(F.col("p_partkey") % 2 == 0, "Left ").otherwise("Right ")
    return table(spark, d, "part").select("p_partkey", text.strip_prefix(F.concat(side, F.col("p_name")), ["Left", "Right"]).alias("name"))


@query("f09_name_variants", "SELECT p_partkey, count(*) AS n_variants FROM (SELECT p_partkey, unnest([trim(p_type), trim(regexp_replace(p_type, '^.*\\)', '')), replace(trim(p_type), '.', '')] || [trim(x) FOR x IN string_split(p_type, ' / ')]) AS v FROM part) GROUP BY p_partkey")
def f09(spark, d):
    return table(spark, d, "part").select("p_partkey", F.size(text.name_variants(F.col("p_type"))).cast("long").alias("n_variants"))


@query("f10_leading_year", "SELECT o_orderkey, CAST(substr(strftime(o_orderdate, '%Y-%m'), 1, 4) AS INTEGER) AS year FROM orders")
def f10(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.substring(F.date_format("o_orderdate", "yyyy-MM"), 1, 4).cast("int").alias("year"))


@query("f15_month_day_range", "SELECT o_orderkey, CAST(o_orderdate AS DATE) BETWEEN make_date(year(o_orderdate), 1, 20) AND make_date(year(o_orderdate), 3, 15) AS inside FROM orders")
def f15(spark, d):
    return table(spark, d, "orders").select("o_orderkey", in_year_range(F.to_date("o_orderdate"), (1, 20), (3, 15)).alias("inside"))


@query("p18_residual_features", "SELECT count(*) AS n, " + ", ".join(f"{sql6(f'avg({c})')} AS {c}" for c in ("l_discount", "l_tax")) + " FROM lineitem")
def p18(spark, d):
    block = ["l_quantity", "l_discount", "l_tax"]
    rest = [c for c in block if c not in {"l_quantity"}]
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), *(r6(F.avg(c)).alias(c) for c in rest))


@query("s10_tidy_results", f"WITH {E_CTE}, g AS (SELECT season, avg(cents) AS mean_cents, avg(n) AS mean_n FROM app GROUP BY season) SELECT season, 'mean_cents' AS metric, {sql6('mean_cents')} AS value FROM g UNION ALL SELECT season, 'mean_n', {sql6('mean_n')} FROM g")
def s10(spark, d):
    from ..sources.sinks import tidy

    g = appearances(spark, d).groupBy("season").agg(F.avg("cents").alias("mean_cents"), F.avg("n").alias("mean_n"))
    return tidy(g, ["season"]).select("season", "metric", r6(F.col("value")).alias("value"))
