"""The given tables in the shape of panels, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import is_true, season_of
from ..operators import link
from ..operators.features import PanelSpec

ROLES = ("click", "view", "purchase")
TISSUE = {"alpha": 1, "beta": 2, "gamma": 3}
EXCLUDED = ("ex1", "ex2")
CATEGORIES = ["alpha", "beta", "gamma", "ex1", "ex2", "other"]
SPEC = PanelSpec("user_id", "ts", "day", "season", ("cents", "n", "k"), "role", ROLES)
BINS = ([0, 1, 2, 3, 7, 1000], ["1", "2", "3", "4-7", "8+"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", F.to_date("ts").alias("day"),
        F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1).cast("int").alias("k"), F.round(F.col("value") * 100).cast("long").alias("c"),
    )


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (user, day) that has anything but errors; label-free."""
    rows = events(spark, sf_dir).where("event_type <> 'error'").groupBy("user_id", "day")
    rows = rows.agg(F.min("ts").alias("ts"), F.sum("c").alias("cents"), F.count("*").alias("n"), F.max("k").alias("k"), F.min_by("event_type", "ts").alias("first_type"))
    season = F.floor(F.datediff("day", F.lit("2024-01-01").cast("date")) / 7).cast("int").alias("season")
    return rows.select("*", season, F.when(F.col("first_type").isin(*ROLES), F.col("first_type")).alias("role"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("event_type = 'error'")
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), F.col("k") % 6 + 1)
    return rows.select("event_id", "user_id", F.col("day").alias("report_date"), category.alias("category"))


def outcomes(spark: SparkSession, sf_dir: str, window: int = 3, app: DataFrame | None = None, lab: DataFrame | None = None) -> DataFrame:
    """Appearances with their linked event, label, index row and eligibility."""
    app = appearances(spark, sf_dir) if app is None else app
    lab = labels(spark, sf_dir) if lab is None else lab
    pairs = link.within_days(app.select("user_id", "day"), lab, "user_id", "day", "report_date", 1, window)
    linked = link.nearest(pairs, ["user_id", "day"], ["gap", "event_id"])
    rows = link.attach(app, linked, ["user_id", "day"])
    tissue = F.coalesce(*(F.when(F.col("category") == c, F.lit(n)) for c, n in TISSUE.items()))
    rows = rows.withColumn("tissue", tissue).withColumn("is_index", link.index_rows(rows, ["user_id", "report_date"], [F.col("gap"), F.col("day").desc()]))
    out = is_true(F.col("category").isin(*EXCLUDED)) | (F.col("event_id").isNotNull() & (~F.col("is_index") | F.col("tissue").isNull()))
    return rows.withColumns({"y": (F.col("is_index") & F.col("tissue").isNotNull()).cast("int"), "eligible": ~out})


E_CTE = """ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(ts AS DATE) AS day, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER) AS k,
 CAST(round(value*100) AS BIGINT) AS c FROM events),
app0 AS (SELECT user_id, day, min(ts) AS ts, CAST(sum(c) AS BIGINT) AS cents, count(*) AS n, max(k) AS k, arg_min(event_type, ts) AS first_type FROM ev WHERE event_type <> 'error' GROUP BY user_id, day),
app AS (SELECT *, CAST(floor(date_diff('day', DATE '2024-01-01', day) / 7.0) AS INTEGER) AS season, CASE WHEN first_type IN ('click','view','purchase') THEN first_type END AS role FROM app0),
lab AS (SELECT event_id, user_id, day AS report_date, ['alpha','beta','gamma','ex1','ex2','other'][k % 6 + 1] AS category FROM ev WHERE event_type = 'error')"""


def outcome_cte(window: int = 3) -> str:
    return E_CTE + f""",
pairs AS (SELECT a.user_id, a.day, l.event_id, l.report_date, l.category, CAST(date_diff('day', a.day, l.report_date) AS INTEGER) AS gap
 FROM app a JOIN lab l ON a.user_id = l.user_id AND date_diff('day', a.day, l.report_date) BETWEEN 1 AND {window}),
linked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY gap, event_id) AS rn FROM pairs) WHERE rn = 1),
att AS (SELECT a.*, l.event_id, l.report_date, l.category, l.gap, CASE l.category WHEN 'alpha' THEN 1 WHEN 'beta' THEN 2 WHEN 'gamma' THEN 3 END AS tissue
 FROM app a LEFT JOIN linked l ON a.user_id = l.user_id AND a.day = l.day),
att2 AS (SELECT *, (event_id IS NOT NULL AND row_number() OVER (PARTITION BY user_id, report_date ORDER BY gap, day DESC) = 1) AS is_index FROM att),
outc AS (SELECT *, CAST(is_index AND tissue IS NOT NULL AS INTEGER) AS y,
 NOT (coalesce(category IN ('ex1','ex2'), false) OR (event_id IS NOT NULL AND (NOT is_index OR tissue IS NULL))) AS eligible FROM att2)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (customer, day) of orders: the panel with groups (nations)."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    day = F.to_date("o_orderdate").alias("day")
    rows = orders.select(F.col("o_custkey").alias("cust"), day, "o_orderpriority", "o_orderkey").join(customer.select(F.col("c_custkey").alias("cust"), "c_nationkey"), "cust")
    # a deterministic switch of group for some customers, by year
    group = F.when((F.col("cust") % 10 == 0) & (F.year("day") % 2 == 0), (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey")).cast("int")
    rows = rows.withColumn("grp", group).groupBy("cust", "day")
    rows = rows.agg(F.min("grp").alias("grp"), F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("y"), F.count("*").alias("n"))
    return rows.withColumn("season", season_of(F.col("day")).cast("int"))


O_CTE = """tr0 AS (SELECT o_custkey AS cust, CAST(o_orderdate AS DATE) AS day, o_orderpriority,
 CAST(CASE WHEN o_custkey % 10 = 0 AND year(CAST(o_orderdate AS DATE)) % 2 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS INTEGER) AS grp
 FROM orders JOIN customer ON o_custkey = c_custkey),
tr AS (SELECT cust, day, min(grp) AS grp, max(CAST(o_orderpriority = '1-URGENT' AS INTEGER)) AS y, count(*) AS n,
 CAST(CASE WHEN month(day) >= 10 THEN year(day) ELSE year(day) - 1 END AS INTEGER) AS season FROM tr0 GROUP BY cust, day)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and two scores for each line item."""
    li = table(spark, sf_dir, "lineitem")
    p = F.least(F.greatest(F.round(F.col("l_quantity") + 100 * F.col("l_discount") + F.col("l_linenumber")) / 70, F.lit(0.01)), F.lit(0.99))
    q = F.least(F.greatest(F.round(F.col("l_tax") * 100 + F.col("l_linenumber")) / 20, F.lit(0.01)), F.lit(0.99))
    return li.select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("cluster"), F.year("l_shipdate").cast("int").alias("season"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"), p.alias("p"), q.alias("q"),
    )


S_CTE = """sc AS (SELECT l_orderkey, l_linenumber, l_suppkey AS cluster, CAST(year(l_shipdate) AS INTEGER) AS season, CAST(l_returnflag = 'R' AS INTEGER) AS y,
 least(greatest(round(l_quantity + 100 * l_discount + l_linenumber) / 70, 0.01::DOUBLE), 0.99::DOUBLE) AS p,
 least(greatest(round(l_tax * 100 + l_linenumber) / 20, 0.01::DOUBLE), 0.99::DOUBLE) AS q FROM lineitem)"""


def sql6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def sql_wilson(k: str, n: str, z: float = 1.96) -> tuple[str, str]:
    p, nn = f"({k}::DOUBLE / nullif({n}, 0))", f"nullif({n}, 0)::DOUBLE"
    mid = f"({p} + {z * z / 2} / {nn}) / (1 + {z * z} / {nn})"
    half = f"{z} * sqrt({p} * (1 - {p}) / {nn} + {z * z / 4} / ({nn} * {nn})) / (1 + {z * z} / {nn})"
    return f"({mid} - {half})", f"({mid} + {half})"
