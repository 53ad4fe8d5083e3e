"""Hand-built panels with answers worked out by hand."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tideline.functions import scalar as S
from tideline.operators import asof, audit, dims, link
from tideline.operators import features as X
from tideline.operators.features import PanelSpec

SPEC = PanelSpec("e", "ts", "day", "season", ("m",), "role", ("C", "F", "G"))


def panel(spark, rows):
    """rows: (entity, 'yyyy-mm-dd', measure, role)"""
    made = [(e, datetime.fromisoformat(f"{d} 19:00:00"), date.fromisoformat(d), float(m) if m is not None else None, role) for e, d, m, role in rows]
    df = spark.createDataFrame(made, "e int, ts timestamp, day date, m double, role string")
    return df.withColumn("season", S.season_of(F.col("day")).cast("int"))


def ordered(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("e", "day").collect()]


def test_excluded_row_is_still_history(spark):
    app = panel(spark, [(1, "2021-01-01", 1, None), (1, "2021-01-03", 1, None), (1, "2021-01-05", 1, None)])
    ev = spark.createDataFrame([(1, 1, date(2021, 1, 6))], "e int, event_id int, event_day date")
    pairs = link.nearest(link.within_days(app.select("e", "day"), ev, "e", "day", "event_day"), ["e", "day"], ["gap"])
    rows = link.attach(app, pairs, ["e", "day"])
    rows = rows.withColumn("is_index", link.index_rows(rows, ["e", "event_day"], [F.col("gap"), F.col("day").desc()]))
    rows = rows.select("*", X.rest_days(SPEC).alias("rest"), X.trailing_count(7, SPEC).alias("n7"))
    assert ordered(rows, "gap", "is_index", "rest", "n7") == [(None, False, None, 0), (3, False, 2, 1), (1, True, 2, 2)]


@pytest.mark.parametrize(("window", "gaps"), [(3, [1, 2, 3]), (2, [1, 2])])
def test_calendar_window(spark, window, gaps):
    app = panel(spark, [(k, "2021-01-02", 1, None) for k in range(5)])
    ev = spark.createDataFrame([(k, k, date(2021, 1, 2 + k)) for k in range(5)], "e int, event_id int, event_day date")
    got = link.within_days(app, ev, "e", "day", "event_day", 1, window)
    assert sorted(r["gap"] for r in got.collect()) == gaps


def test_floored_and_calendar_days_differ(spark):
    df = spark.createDataFrame([(datetime(2021, 1, 2, 19), datetime(2021, 1, 4))], "a timestamp, b timestamp")
    assert df.select(S.day_gap(F.col("b"), F.col("a")), S.elapsed_days(F.col("b"), F.col("a"))).first()[:] == (2, 1)


def test_season_boundary(spark):
    df = panel(spark, [(1, "2021-03-01", 40, None), (1, "2021-10-22", 20, None), (1, "2021-10-25", 10, None)])
    out = df.select("*", X.season_sum("m", SPEC).alias("s"), X.season_mean("m", SPEC).alias("std"), X.rest_days(SPEC).alias("rest"), X.ordinal(SPEC.in_season()).alias("g"), X.lagged_mean("m", 3, SPEC).alias("r3"))
    assert ordered(out, "s", "std", "rest", "g", "r3") == [(0.0, None, None, 0, None), (0.0, None, None, 0, 40.0), (20.0, 20.0, 3, 1, 30.0)]


def test_event_history_bounds(spark):
    ev = spark.createDataFrame([(1, date(2021, 4, 8))], "e int, event_day date")
    rows = spark.createDataFrame([(1, date(2021, 4, 8)), (1, date(2022, 4, 8)), (1, date(2022, 4, 9)), (2, date(2022, 4, 9))], "e int, day date")
    got = asof.history(rows, ev, ["e"], "day", "event_day", 365)
    assert ordered(got, "n_before", "n_recent", "last_day") == [(0, 0, None), (1, 1, date(2021, 4, 8)), (1, 0, date(2021, 4, 8)), (0, 0, None)]


def test_prior_mode(spark):
    roles = [None, "G", "G", "C", "C", "C", "C"]
    df = panel(spark, [(1, f"2021-01-{k + 1:02d}", 1, r) for k, r in enumerate(roles)])
    assert [r for (r,) in ordered(df.select("*", X.prior_mode(SPEC).alias("mode")), "mode")] == ["U", "U", "G", "G", "G", "C", "C"]


def test_concurrent_and_lagged(spark):
    df = panel(spark, [(1, f"2021-01-{k:02d}", 10 * k, None) for k in range(1, 9)])
    out = ordered(df.select("*", X.concurrent_mean("m", 5, SPEC).alias("c5"), X.lagged_mean("m", 5, SPEC).alias("r5")), "c5", "r5")
    assert [c for c, _ in out] == [10, 15, 20, 25, 30, 40, 50, 60]
    assert [r for _, r in out] == [None, 10, 15, 20, 25, 30, 40, 50]


def test_one_exchange_for_all_features(spark):
    df = panel(spark, [(1, "2021-01-01", 1, "C"), (2, "2021-01-02", 2, "G")])
    plan = X.build_features(df, SPEC)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_label_filter_stays_above_windows(spark):
    df = panel(spark, [(1, "2021-01-01", 1, "C"), (1, "2021-01-02", 2, "G")]).withColumn("eligible", F.col("m") > 1)
    plan = X.build_features(df, SPEC).where("eligible")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Filter") < plan.index("Window")


def test_recovered_ids(spark):
    schema = "id int, name string"
    assert [r["id"] for r in dims.recovered_ids(spark.createDataFrame([(1, "a"), (None, "a"), (2, "b")], schema), "id", "name").orderBy("id").collect()] == [1, 1, 2]
    for rows in ([(1, "a"), (2, "a"), (None, "a")], [(1, "a"), (None, "z")], [(1, "a"), (None, None)]):
        with pytest.raises(ValueError):
            dims.recovered_ids(spark.createDataFrame(rows, schema), "id", "name")


def test_joins_are_checked(spark):
    a, twice = spark.createDataFrame([(1, 2)], "k int, v int"), spark.createDataFrame([(1, 3), (1, 4)], "k int, w int")
    with pytest.raises(ValueError):
        dims.join_dimension(a, twice, ["k"])
    with pytest.raises(ValueError):
        dims.join_one_to_one(a, twice, ["k"])


def test_planted_leaks_are_caught_and_clean_features_pass(spark):
    df = panel(spark, [(e, f"2021-01-{k:02d}", e * k, None) for e in (1, 2, 3) for k in range(1, 12)])
    cuts = spark.createDataFrame([(date(2021, 1, 5),), (date(2021, 1, 9),)], "cutoff date")

    def build(p):
        w = SPEC.history()
        return p.select("e", "day", X.lagged_mean("m", 3, SPEC).alias("ok"), F.lead("m").over(w).alias("future"), F.col("m").alias("own"))

    cols = ["ok", "future", "own"]
    a = audit.future_truncation(build, df, "day", ["e", "day"], cols, cuts, "e").groupBy("column_name").agg(F.sum("n_compared").alias("n_compared"), F.sum("n_diff").alias("n_diff"))
    b = audit.same_row_perturbation(build, df, {"m": F.col("m") + 1}, ["e", "day"], cols, "e", "day")
    assert {r["column_name"]: r["n_diff"] > 0 for r in a.collect()} == {"ok": False, "future": True, "own": False}
    assert {r["column_name"]: r["n_diff"] > 0 for r in b.collect()} == {"ok": False, "future": False, "own": True}
    both = a.withColumn("test", F.lit("A")).unionByName(b.withColumn("test", F.lit("B")))
    assert {r["column_name"]: r["verdict"] for r in audit.adjudicated(both, ["own"]).collect()} == {"ok": "clean", "future": "leak", "own": "caught"}


def test_null_traps(spark):
    df = spark.createDataFrame([(float("nan"), None), (float("inf"), 40.0), (2.0, 3.0)], "a double, b double")
    got = df.select(S.finite(F.col("a")), S.clip(F.col("b"), high=30.0), S.right_closed(F.col("b"), [0, 3, 40], ["x", "y"])).collect()
    assert [tuple(r) for r in got] == [(None, None, None), (None, 30.0, "y"), (2.0, 3.0, "x")]
