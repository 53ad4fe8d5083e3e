"""Sorted panels, two-level scans, counts in the same pass, digests, bitmaps, replicate vectors."""

import gzip
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators import asof, audit, features, metrics, rates, replicates, resample, sliced
from tideline.operators.fit import replicate_fits
from tideline.operators.watch import Watch, attach_counted
from tideline.sources import ingest, sinks

SPEC = features.PanelSpec("e", "ts", "day", "season", ("m", "x"), "role", ("G", "F", "C"))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def panel_rows(n: int, hot: float = 0.33, seed: int = 1) -> list[tuple]:
    """One row at most for each entity and hour; entity 0 has a share of all rows."""
    r, seen = random.Random(seed), set()
    rows = []
    while len(rows) < n:
        e = 0 if r.random() < hot else r.randrange(1, 60)
        ts = datetime(2021, 1, 1) + timedelta(hours=r.randrange(24 * 400))
        if (e, ts) not in seen:
            seen.add((e, ts))
            role = r.choice(["G", "F", "C", None])
            rows.append((e, ts, ts.date(), ts.year * 2 + (ts.month > 6), r.choice([None, r.randrange(100)]), r.random(), role))
    return rows


PANEL = "e int, ts timestamp, day date, season int, m int, x double, role string"


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(panel_rows(3000), PANEL).withColumn("at", F.unix_micros("ts")).cache()


# --- S2, S6, S12 ----------------------------------------------------------------------------

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])


def test_each_line_is_good_or_bad(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\nbad,line\n2,y\n3,z,extra\n4\n5,\n")
    good, bad = ingest.read_csv_lenient(spark, str(tmp_path / "a.csv"), SCHEMA)
    for view in (good, good.select("id"), good.select("name"), good.where("id > 0").select("name"), good.groupBy("id", "name").count()):
        assert view.count() == 3
    assert sorted(r["name"] or "" for r in good.select("name").collect()) == ["", "x", "y"]
    assert {r[0] for r in bad.collect()} == {"bad,line", "3,z,extra", "4"} and bad.count() == 3
    assert good.agg(F.count("*")).first()[0] + bad.agg(F.count("*")).first()[0] == 6


def test_files_are_read_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n")
    (tmp_path / "b.csv").write_text("name, id\nz,9\n")
    (tmp_path / "d.csv").write_text('"id","more",name\n7,m,q\n')
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "old_f.csv").write_text("id,name\n100,no\n")
    with gzip.open(tmp_path / "g.csv.gz", "wt") as out:
        out.write("more,id\nw,3\n")
    got = ingest.read_csvs(spark, str(tmp_path / "*.csv*"), "^old_", SCHEMA)
    assert dict(got.dtypes) == {"id": "int", "name": "string", "more": "string"}
    assert sorted((r["id"], r["name"], r["more"]) for r in got.collect()) == [(1, "x", None), (3, None, "w"), (7, "q", "m"), (9, "z", None)]
    (tmp_path / "twice.csv").write_text("id,id\n1,2\n")
    with pytest.raises(ValueError):
        ingest.read_csvs(spark, str(tmp_path / "t*.csv"))
    with pytest.raises(FileNotFoundError):
        ingest.read_csvs(spark, str(tmp_path / "none*.csv"))


def test_variants_are_partitions(spark, tmp_path):
    path = str(tmp_path / "v")
    df = spark.range(300).select("id", (F.col("id") % 3 + 1).cast("int").alias("match_window"))
    sinks.write_variants(df, path, ["match_window"])
    sinks.write_variants(df.where("match_window = 2 and id < 10"), path, ["match_window"])
    counts = {r["match_window"]: r["count"] for r in spark.read.parquet(path).groupBy("match_window").count().collect()}
    assert counts == {1: 100, 2: 3, 3: 100}
    one = spark.read.parquet(path).where("match_window = 2")
    assert "PartitionFilters: [isnotnull(match_window" in plan_of(one)
    wanted = spark.createDataFrame([(3, "yes"), (1, "no")], "match_window int, use string").where("use = 'yes'")
    wanted.write.parquet(str(tmp_path / "w"))
    joined = spark.read.parquet(path).join(spark.read.parquet(str(tmp_path / "w")).where("use = 'yes'"), "match_window")
    assert "dynamicpruning" in plan_of(joined).lower() and joined.count() == 100


# --- O1 -------------------------------------------------------------------------------------


def test_sorted_panel_needs_no_exchange_and_no_sort(spark, panel, tmp_path):
    root = str(tmp_path / "p")
    sinks.publish_panel(panel.where("e < 5"), root, "e", "at", 3)
    sinks.publish_panel(panel, root, "e", "at", 5)
    stored = sinks.sorted_panel(spark, root)  # the latest version
    got = features.sorted_features(stored, SPEC, "at")
    plan = plan_of(got)
    assert "Exchange" not in plan and "Sort" not in plan and plan.count("FileScan") == 1
    want = features.build_features(panel, SPEC)
    names = [c for c in want.columns if c in got.columns]
    assert {"m_r3", "m_sd5", "x_std", "x_acr", "rest_days", "rows_14d", "season_rows", "prior_mode"} <= set(names)
    a, b = ({(r["e"], r["at"]): r for r in df.select(*names).collect()} for df in (got, want))
    assert a.keys() == b.keys() and len(a) == 3000
    for key, row in a.items():
        for c in names:
            assert row[c] == b[key][c] or row[c] == pytest.approx(b[key][c], rel=1e-9, abs=1e-9), (key, c)
    assert {r["e"] for r in sinks.sorted_panel(spark, root).where("role_ff is null" if "role_ff" in stored.columns else "true").select("e").distinct().collect()} == set(range(60))


def test_fills_and_flags_of_a_sorted_panel(spark, panel, tmp_path):
    sinks.publish_panel(panel, str(tmp_path / "p"), "e", "at", 4)
    got = features.sorted_features(sinks.sorted_panel(spark, str(tmp_path / "p")), SPEC, "at")
    w = SPEC.history()
    want = panel.select("e", "at", features.forward_fill("role", SPEC).alias("role_ff"), features.lagged_flag(F.col("role").isNotNull(), SPEC).alias("had_role"), F.coalesce(features.season_sum("m", SPEC)).alias("m_season"), F.lag("m").over(w))
    assert got.select("e", "at", "role_ff", "had_role", "m_season").exceptAll(want.select("e", "at", "role_ff", "had_role", "m_season")).count() == 0


def test_places_of_the_whole_order(spark, panel):
    got = sinks.in_order(panel.select("e", "ts", "m"), ["e", "ts"])
    rows = got.orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(1, 3001))
    assert [(r["e"], r["ts"]) for r in rows] == sorted((r["e"], r["ts"]) for r in panel.select("e", "ts").collect())
    assert sinks.in_order(panel.select("e", "ts").limit(0), ["e", "ts"]).count() == 0


# --- two-level scans ------------------------------------------------------------------------


def test_sliced_scans_equal_windows(spark, panel):
    p = panel.withColumn("e", F.when(F.col("e") != 7, F.col("e")))  # a null group too
    w = W.partitionBy("e", "season").orderBy("ts")
    got = sliced.season_totals(p, ["e", "season"], "ts", "m", 16)
    past = w.rowsBetween(*features.PAST)
    want = p.select("*", F.coalesce(F.sum("m").over(past), F.lit(0)).alias("season_sum"), F.avg("m").over(past).alias("season_mean"))
    unlike = lambda a, b: a.select(*b.columns).exceptAll(b).count()
    single = p.where("e is not null")
    assert unlike(got.where("e is not null"), want.where("e is not null")) == 0 and got.count() == 3000
    filled = sliced.forward_filled(single, ["e"], "ts", "role", "ff", 16)
    assert unlike(filled, single.select("*", features.forward_fill("role", SPEC).alias("ff"))) == 0
    assert sliced.season_totals(p.limit(0), ["e"], "ts", "m").count() == 0


def test_sliced_as_of_equals_windows(spark, panel):
    rows = panel.select("e", "season", "day").withColumn("before", F.date_sub("day", 20)).distinct()
    rows = rows.unionByName(spark.createDataFrame([(0, 1, None, None), (None, 1, date(2021, 5, 5), date(2021, 4, 4))], rows.schema))
    events = panel.where("m > 50").select("e", F.col("day").alias("d2"))
    unlike = lambda a, b: a.select(*b.columns).exceptAll(b).count() + b.exceptAll(a.select(*b.columns)).count()
    assert unlike(sliced.previous_day(rows, events, ["e"], "day", "d2", slices=9), asof.previous_day(rows, events, ["e"], "day", "d2").select(*rows.columns, "prev_day")) == 0
    known = rows.where("day is not null")
    assert unlike(sliced.history(known, events, ["e"], "day", "d2", 30, slices=9), asof.history(known, events, ["e"], "day", "d2", 30).select(*rows.columns, "n_before", "n_recent", "last_day")) == 0
    assert unlike(sliced.between_counts(rows, events, ["e"], "before", "day", "d2", slices=9), asof.between_counts(rows, events, ["e"], "before", "day", "d2").select(*rows.columns, "n_between")) == 0


@pytest.mark.parametrize("cuts", [[], [3], [1, 2, 5, 8, 9]])
def test_slice_numbers(spark, cuts):
    got = spark.range(-2, 12).select("id", sliced.slice_number(F.col("id"), cuts).alias("s")).collect()
    assert all(r["s"] == sum(c < r["id"] for c in cuts) for r in got)


def test_a_third_of_all_rows_in_one_entity_is_many_tasks(spark):
    n = 60_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997).cast("int").alias("e"), F.col("id").alias("at"), F.lit(1).alias("m"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.shuffle.partitions", 32)
        sizes = lambda x: sorted(r["n"] for r in x.groupBy(F.spark_partition_id().alias("p")).agg(F.count("s").alias("n")).collect())
        cut = sizes(sliced.running(df, ["e"], "at", {"s": sliced.Running("sum", F.col("m"))}))
        plain = sizes(df.select("e", F.sum("m").over(W.partitionBy("e").orderBy("at")).alias("s")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert cut[-1] < 5 * cut[len(cut) // 2] and plain[-1] > 5 * plain[len(plain) // 2]


# --- counts in the same pass ----------------------------------------------------------------


def test_counts_come_with_the_job(spark, tmp_path):
    watch = Watch()
    kept = watch.filtered(spark.range(100).withColumn("v", F.when(F.col("id") < 90, F.col("id"))), "span", F.col("v") < 30)
    more = spark.range(0, 100, 2).withColumn("w", F.lit(1))
    out = attach_counted(kept, more, ["id"], watch)
    spark.sparkContext.setJobGroup("counted", "")
    out.write.parquet(str(tmp_path / "out"))
    spark.sparkContext.setJobGroup("other", "")
    with_counts = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    assert watch.counts() == {"span": 100, "span.kept": 30, "span.dropped": 70, "attach.before": 30, "attach.after": 30}
    watch.same("attach.before", "attach.after")
    with pytest.raises(ValueError):
        watch.same("span", "attach.after")
    with pytest.raises(ValueError):
        watch.rows(kept, "span")
    spark.sparkContext.setJobGroup("plain", "")
    spark.range(100).withColumn("v", F.col("id")).where("v < 30").join(more, "id", "left").write.parquet(str(tmp_path / "plain"))
    spark.sparkContext.setJobGroup("other", "")
    assert with_counts == len(spark.sparkContext.statusTracker().getJobIdsForGroup("plain"))


def test_a_join_that_repeats_rows_is_seen(spark, tmp_path):
    watch = Watch()
    attach_counted(spark.range(4), spark.createDataFrame([(1, 2), (1, 3)], "id long, v int"), ["id"], watch).write.parquet(str(tmp_path / "o"))
    with pytest.raises(ValueError):
        watch.same("attach.before", "attach.after")


# --- digests and bitmaps --------------------------------------------------------------------


def test_only_differing_groups_are_joined(spark, panel):
    keys, columns = ["e", "ts"], ["m", "x", "role"]
    moved = panel.withColumn("m", F.when((F.col("e") == 5) & (F.col("season") == 4042), F.coalesce("m", F.lit(0)) + 1).otherwise(F.col("m")))
    for other in (moved, panel, panel.where("e <> 9"), panel.withColumn("role", F.lit(None).cast("string"))):
        a = audit.compare(panel, other, keys, columns).orderBy("column_name").collect()
        b = audit.compare(panel, other, keys, columns, within=["e", "season"]).orderBy("column_name").collect()
        assert a == b
    equal, left, right = audit._differing(panel, moved, keys, columns, ["e", "season"])
    touched = panel.where("e = 5 and season = 4042").count()
    assert left.count() == right.count() == touched > 0 and equal.first()[0] == 3000 - touched


def test_bitmaps_merge_to_exact_counts(spark):
    df = spark.range(200_000).select((F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b"), F.when(F.col("id") % 5 > 0, F.pmod(F.hash("id"), F.lit(90_000))).alias("n"))
    maps = rates.distinct_bitmaps(df, ["a", "b"], "n").cache()
    for by in (["a", "b"], ["a"], ["b"], []):
        got = sorted(map(tuple, rates.distinct_counts(maps, by, "c").collect()))
        assert got == sorted(map(tuple, (df.groupBy(*by) if by else df).agg(F.count_distinct("n").alias("c")).collect()))
    assert rates.distinct_counts(rates.distinct_bitmaps(df.limit(0), ["a"], "n"), [], "c").first()[0] == 0


# --- replicates -----------------------------------------------------------------------------


@pytest.mark.parametrize(("cells", "at_once"), [(1 << 24, 1 << 21), (300, 40)])
def test_replicate_auc_against_repeated_rows(spark, monkeypatch, cells, at_once):
    monkeypatch.setattr(replicates, "CELLS", cells)  # also in several blocks of replicates
    monkeypatch.setattr(replicates, "AT_ONCE", at_once)  # and with ties cut apart
    r = np.random.default_rng(5)
    rows = [(int(r.integers(0, 40)), float(r.integers(0, 25)) / 7, int(r.random() < 0.3)) for _ in range(900)] + [(3, None, 1), (4, 0.5, None), (None, 1.0, 1)]
    df = spark.createDataFrame(rows, "g int, s double, y int")
    weights = resample.cluster_weights(df.where("g is not null").select("g").distinct(), "g", 30, 3)
    drawn = {(x["rep"], x["g"]): x["w"] for x in weights.collect()}
    got = {x["rep"]: x["auc"] for x in replicates.replicate_auc(df, "s", "y", "g", weights, 30).collect()}
    known = [x for x in rows if None not in x]
    for rep in range(30):
        w = np.array([drawn.get((rep, g), 0) for g, _, _ in known], float)
        s, y = np.array([x[1] for x in known]), np.array([x[2] for x in known])
        pos, neg = np.flatnonzero(y), np.flatnonzero(1 - y)
        over = (s[pos][:, None] > s[neg]) + 0.5 * (s[pos][:, None] == s[neg])
        assert got[rep] == pytest.approx((w[pos][:, None] * w[neg] * over).sum() / (w[pos].sum() * w[neg].sum()), rel=1e-12)


def test_a_two_level_scan_works_its_input_out_once(spark):  # J8
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(200).selectExpr("id % 3 as g", "id as t").mapInArrow(counted, "g long, t long")
    twice = df
    for name in ("a", "b"):
        twice = sliced.running(twice, ["g"], "t", {name: sliced.Running("count", F.col("t"))}, 8)
    assert twice.count() == 200 and seen.value == 200


def test_weights_of_few_scores_do_not_pass_the_driver(spark, monkeypatch):  # R1, R2
    r = np.random.default_rng(6)
    df = spark.createDataFrame([(int(r.integers(0, 40)), float(r.integers(0, 25)) / 7, int(r.random() < 0.3)) for _ in range(900)], "g int, s double, y int")
    weights = resample.cluster_weights(df.select("g").distinct(), "g", 30, 3)
    area = lambda: {x["rep"]: x["auc"] for x in replicates.replicate_auc(df, "s", "y", "g", weights, 30).collect()}
    monkeypatch.setattr(replicates, "AT_ONCE", 100)
    by_blocks = area()
    monkeypatch.setattr(replicates, "AT_ONCE", 750)
    monkeypatch.setattr(replicates, "_matrix", None)  # collects weights
    assert len(by_blocks) == 30 and area() == pytest.approx(by_blocks, rel=1e-12)


def test_replicate_sums_send_a_row_for_each_replicate(spark):
    g = spark.range(500).select(F.col("id").alias("c"), (F.col("id") % 9 + 1).alias("n"), (F.col("id") % 4).alias("k"))
    weights = resample.cluster_weights(g.select("c"), "c", 20, 1)
    sums = replicates.replicate_sums(replicates.weight_vectors(weights, "c"), g, "c", ["n", "k"])
    want = weights.join(g, "c").groupBy("rep").agg(F.sum(F.col("w") * F.col("n")).alias("n"), F.sum(F.col("w") * F.col("k")).alias("k"))
    assert sorted(map(tuple, sums.select("rep", "n", "k").collect())) == sorted(map(tuple, want.select("rep", "n", "k").collect()))
    assert "partial_sum" in plan_of(sums).split("Exchange ")[1]  # added up below the last exchange, before anything is sent


def test_cut_clusters_give_the_same_fits(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(g, float(a), int(r.random() < 1 / (1 + np.exp(-(a - 0.5 + 0.3 * (g % 3)))))) for g in range(12) for a in r.normal(size=300 if g == 0 else 20)]
    df = spark.createDataFrame(rows, "g int, a double, y int")
    weights = resample.cluster_weights(df.select("g").distinct(), "g", 4, 2).cache()
    whole = replicate_fits(df, weights, ["a"], "y", "g", rounds=8)
    monkeypatch.setattr(replicates, "CHUNK", 60)
    monkeypatch.setattr(replicates, "AT_ONCE", 500)
    cut = replicate_fits(df, weights, ["a"], "y", "g", rounds=8)
    assert len(whole) == len(cut) == 4
    for (rep, beta, _), (rep2, beta2, _) in zip(whole, cut, strict=True):
        assert rep == rep2 and np.allclose(beta, beta2, atol=1e-9)


# --- sums of metrics used above -------------------------------------------------------------


def test_auc_of_all_equal_scores_is_a_half(spark):
    df = spark.createDataFrame([(1.0, k % 2) for k in range(10)], "s double, y int")
    assert metrics.auc(df, "s", "y").first()["auc"] == 0.5
