"""Fits against dense algebra, exact medians and totals, and the model queries' own promises."""

import datetime as dt
import os

import numpy as np
import pytest

from tideline.operators import dims, fit, metrics
from tideline.operators.watch import Watch
from tideline.plans import models

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


def panel(seed: int = 1, clusters: int = 30):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(clusters):
        own = r.normal(0, 0.8)
        for _ in range(r.integers(1, 12)):
            a, b = r.normal(), r.normal() + own
            rows.append((c, float(a), float(b), int(r.random() < 1 / (1 + np.exp(0.5 - 0.8 * a - own)))))
    return rows


@pytest.fixture(scope="module")
def rows():
    return panel()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "g int, a double, b double, y int").cache()


def dense(rows, terms=("a", "b")):
    g = np.array([r[0] for r in rows])
    x = np.column_stack([np.ones(len(rows)), *(np.array([r[{"a": 1, "b": 2}[t]] for r in rows]) for t in terms)])
    return g, x, np.array([r[3] for r in rows], float)


def newton(x, y, offset=0.0):
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ b + offset)))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    return b, 1 / (1 + np.exp(-(x @ b + offset)))


def test_logistic_glm_and_its_robust_errors(frame, rows):  # L14
    g, x, y = dense(rows)
    b, p = newton(x, y)
    got = fit.logistic_glm(frame, ["a", "b"], "y", "g")
    bread = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
    u = np.stack([(x * (y - p)[:, None])[g == k].sum(0) for k in np.unique(g)])
    m = len(u)
    assert got.converged and np.allclose(got.beta, b, atol=1e-7) and np.allclose(got.se, np.sqrt(np.diag(bread)), atol=1e-7)
    assert np.allclose(got.robust_se, np.sqrt(np.diag(bread @ (u.T @ u) @ bread) * m / (m - 1)), atol=1e-7)
    assert abs(got.loglik - (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()) < 1e-7


def test_likelihood_ratio_with_two_terms(frame, rows):  # L16
    _, x, y = dense(rows)
    logs = []
    for columns in ([0], [0, 1, 2]):
        _, p = newton(x[:, columns], y)
        logs.append((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
    stat, p, df = fit.likelihood_ratio(fit.logistic_glm(frame, [], "y"), fit.logistic_glm(frame, ["a", "b"], "y"))
    assert df == 2 and abs(stat - 2 * (logs[1] - logs[0])) < 1e-6 and abs(p - np.exp(-stat / 2)) < 1e-12


def test_calibration_slope_and_intercept(spark):  # M5, M6
    r = np.random.default_rng(4)
    p = np.clip(r.random(400), 0.02, 0.98)
    y = (r.random(400) < 1 / (1 + np.exp(-(0.3 + 0.7 * np.log(p / (1 - p)))))).astype(float)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int")
    logit = np.log(p / (1 - p))
    slope, _ = newton(np.column_stack([np.ones(400), logit]), y)
    assert np.allclose(fit.calibration_slope(df, "p", "y").beta, slope, atol=1e-6)
    large, _ = newton(np.ones((400, 1)), y, logit)
    assert np.allclose(fit.calibration_in_the_large(df, "p", "y").beta, large, atol=1e-6)


def test_regularised_logistic_is_at_its_optimum(spark, frame, rows):  # L3
    _, x, y = dense(rows)
    model = fit.fit_logistic(frame, ["a", "b"])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    b = np.array([model.intercept, *model.coefficients])
    p = 1 / (1 + np.exp(-(x @ b)))
    gradient = 0.1 * x.T @ (w * (p - y)) + np.array([0, *b[1:]])
    assert np.abs(gradient).max() < 0.01 * np.abs(0.1 * x.T @ (w * (0.5 - y))).max()


def gee(g, x, y, rounds=60):
    """Dense exchangeable estimating equations."""
    b, alpha, p = newton(x, y)[0], 0.0, x.shape[1]
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-(x @ b)))
        s = np.sqrt(mu * (1 - mu))
        r = (y - mu) / s
        phi = (r * r).sum() / (len(y) - p)
        pairs = sum(r[g == k].sum() ** 2 - (r[g == k] ** 2).sum() for k in np.unique(g))
        size = sum((g == k).sum() * ((g == k).sum() - 1) for k in np.unique(g))
        alpha = float(np.clip(pairs / phi / max(1.0, size - 2 * p), -0.05, 0.95))
        info, u, meat = np.zeros((p, p)), np.zeros(p), np.zeros((p, p))
        for k in np.unique(g):
            d = x[g == k] * s[g == k][:, None]
            inverse = np.linalg.inv((1 - alpha) * np.eye(len(d)) + alpha)
            own = d.T @ inverse @ r[g == k]
            info += d.T @ inverse @ d
            u += own
            meat += np.outer(own, own)
        b = b + np.linalg.solve(info, u)
    bread = np.linalg.inv(info)
    return b, alpha, np.sqrt(np.diag(bread @ meat @ bread))


def test_exchangeable_against_dense_equations(frame, rows):  # L15
    b, alpha, se = gee(*dense(rows))
    got, correlation = fit.exchangeable_logistic(frame, ["a", "b"], "y", "g", rounds=60)
    assert np.allclose(got.beta, b, atol=1e-5) and abs(correlation - alpha) < 1e-4 and np.allclose(got.robust_se, se, atol=1e-4)


def test_replicates_against_dense_equations(spark, frame, rows):  # R3
    r = np.random.default_rng(9)
    picks = {k: r.integers(0, 30, 30) for k in range(3)}
    weights = spark.createDataFrame([(k, int(c), int((p == c).sum())) for k, p in picks.items() for c in np.unique(p)], "rep long, g int, w long")
    for rep, beta, ok in fit.replicate_fits(frame, weights, ["a"], "y", "g", rounds=60):
        drawn = [(i, *row[1:]) for i, c in enumerate(picks[rep]) for row in rows if row[0] == c]
        assert ok and np.allclose(beta, gee(*dense(drawn, ("a",)))[0], atol=1e-4)


def test_medians_are_exact(spark):
    r = np.random.default_rng(2)
    values = {"odd": r.normal(0, 1e6, 501), "even": r.normal(0, 1e-6, 400), "ties": r.integers(0, 3, 300).astype(float), "one": np.array([5.0])}
    df = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x] + [("odd", None), ("none", None)], "g string, v double")
    got = {x["g"]: x["median"] for x in metrics.medians(df, "v", ["g"]).collect()}
    assert got == {k: float(np.median(x)) for k, x in values.items()}
    whole = np.concatenate(list(values.values()))
    assert metrics.medians(df, "v").first()[0] == float(np.median(whole))
    table = fit.imputed(df, ["v"], "g = 'even'").where("g = 'none'").first()
    assert table["v"] == float(np.median(values["even"]))
    assert metrics.medians(df.limit(0), "v", ["g"]).count() == 0


@pytest.mark.parametrize(("low", "high"), [(0, 1), (-5000, 7000), (1e-9, 2e-9)])
def test_auc_of_scores_of_any_range(spark, low, high):
    r = np.random.default_rng(3)
    s = np.round(r.uniform(low, high, 1500), 14)
    s[:300] = s[0]
    y = (r.random(1500) < 0.2).astype(int)
    got = metrics.auc(spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "s double, y int"), "s", "y").first()
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
    assert abs(got["auc"] - want) < 1e-12


def test_calendar_breaks(spark):
    day = lambda *x: dt.date(2021, *x)
    plain = [day(1, 18), day(1, 19), day(1, 22), day(2, 1), day(2, 2), day(2, 6), day(2, 20), day(3, 1), day(3, 10), day(4, 2), day(4, 12)]
    ties = [day(1, 10), day(1, 30), day(2, 3), day(2, 7), day(2, 8)]
    df = spark.createDataFrame([(1, x) for x in plain] + [(1, plain[0])] + [(2, x) for x in ties] + [(3, day(2, 1))], "season int, day date")
    got = {x["season"]: (x["resume"], x["before"]) for x in dims.calendar_breaks(df, ["season"], "day", (4, 12), (1, 20), (3, 15)).collect()}
    # ten days to 1 February; the gap of 14 is no break, that of April is too late; of equal ones the later
    assert got == {1: (day(2, 1), day(1, 22)), 2: (day(2, 7), day(2, 3))}


@given
def test_ablation_grid(spark, monkeypatch):  # L8
    monkeypatch.setattr(models, "ALGORITHMS", ("logistic",))
    grid = models.l08(spark, SF).toPandas()
    assert len(grid) == 5 and len(set(grid["verdict"])) == 1 and set(grid["verdict"]) <= {"holds", "attenuated"}
    assert (grid[grid["features"] == "full"]["loss"].abs() < 1e-12).all()


@given
@pytest.mark.parametrize("name", models.ALGORITHMS)
def test_scores_are_read_after_the_model_table_is_gone(spark, monkeypatch, name):  # L3, L4, L5
    monkeypatch.setattr(models.fitted, "__defaults__", ({"forest": {"trees": 3, "depth": 3}, "boosting": {"rounds": 1, "depth": 2, "rate": 0.2}}, 7))
    out = models.one_model(spark, SF, name)
    assert out.columns == ["user_id", "day", "y", "p"]
    assert out.count() == models.parts(models.model_table(spark, SF))[2].count() > 0


@given
def test_leak_by_split(spark):  # L13
    leak = models.l13(spark, SF).toPandas()
    assert len(leak) == 4 and (leak.groupby("split")["n_test"].nunique() == 1).all()
    for _, r in leak.iterrows():
        assert r["n_train"] + r["n_test"] + (r["reserved"] if r["split"] == "temporal" else 0) == r["cohort"]


@given
def test_gate_of_rare_strata(spark, monkeypatch):  # L11
    monkeypatch.setattr(models, "GRID", {"forest": {"trees": 5, "depth": 3}, "boosting": {"rounds": 1, "depth": 2, "rate": 0.2}})
    monkeypatch.setattr(models, "SEEDS", [1])
    t = models.model_table(spark, SF)
    events = sorted(r[0] or 0 for r in (models.parts(models.of_class(t, k))[2].agg({"y": "sum"}).first() for k in (1, 2, 3)))
    monkeypatch.setattr(models, "LEAST_EVENTS", max(events[1] + 1, 2))  # one stratum at most passes
    for r in models.l11(spark, SF).collect():
        assert (r["gate"] == "fit") == (r["k"] >= models.LEAST_EVENTS) == (r["auc"] is not None)
        assert r["shortfall"] == max(0, models.LEAST_EVENTS - r["k"])


# --- what the fits find -----------------------------------------------------------------------


def planted(spark, n: int, seed: int, signal: float, permuted: bool = False):
    """Two covariates, the label follows the first one and its product with the second; ``permuted``: it follows nothing."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2))
    y = (r.random(n) < 1 / (1 + np.exp(2 - signal * (x[:, 0] + x[:, 0] * x[:, 1])))).astype(int)
    y = r.permutation(y) if permuted else y
    return spark.createDataFrame([(k, float(a), float(b), int(c), int(c) * int(1 + k % 3)) for k, ((a, b), c) in enumerate(zip(x, y, strict=True))], "user_id int, a double, b double, y int, tissue int")


SIZES = {"forest": {"trees": 20, "depth": 5}, "boosting": {"rounds": 15, "depth": 3, "rate": 0.2}}


def area(model, test) -> float:
    return metrics.auc(fit.scored(model, test, ["a", "b"]), "p", "y").first()["auc"]


@pytest.mark.parametrize("name", models.ALGORITHMS)
def test_a_planted_signal_is_found_and_a_permuted_one_is_not(spark, name):  # L4, L5, L17, L18, R8
    train, test = planted(spark, 1500, 1, 2.0).cache(), planted(spark, 1500, 2, 2.0).cache()
    shuffled, other = (planted(spark, 1500, k, 2.0, permuted=True).cache() for k in (3, 4))
    positives = test.where("y = 1").count()
    error = float(test.select(models.auc_error(models.F.lit(0.5), models.F.lit(positives), models.F.lit(1500 - positives))).first()[0])
    found = [area(models.fitted(name, train, ["a", "b"], SIZES, s), test) for s in (1, 2)]
    assert min(found) > 0.75 and abs(found[0] - found[1]) < 0.05  # seeds of a sweep agree
    assert abs(area(models.fitted(name, shuffled, ["a", "b"], SIZES), other) - 0.5) < 4 * error
    alone = metrics.auc(fit.scored(models.fitted(name, train, ["b"], SIZES), test, ["b"]), "p", "y").first()["auc"]
    assert found[0] - alone > 0.15  # the block that holds the signal is missed


@pytest.mark.parametrize("name", models.ALGORITHMS)
def test_models_score_in_a_session_that_has_observed(spark, name):  # L8, L17, R8
    seen = Watch()
    assert seen.rows(spark.range(7), "all").count() == 7 and seen.counts() == {"all": 7}
    t = planted(spark, 300, 7, 2.0)
    assert fit.scored(models.fitted(name, t, ["a", "b"], SIZES), t, ["a", "b"]).where("p between 0 and 1").count() == 300


def test_regressions_at_once_equal_single_ones(spark, frame):  # L9, L10, L13
    rare = models.F.when(models.F.col("g") % 2 == 0, models.F.col("y")).otherwise(0)
    fits = {"all": (["a", "b"], models.F.col("y"), models.F.lit(True)), "some": (["b"], rare, models.F.col("g") < 20), "none": (["a"], models.F.lit(0), models.F.lit(True))}
    got = fit.fit_logistics(frame, fits)
    for name in ("all", "some"):
        columns, label, rows = fits[name]
        one = fit.fit_logistic(frame.where(rows).withColumn("y", label), columns)
        assert np.allclose(got[name].coefficients, one.coefficients, atol=1e-9) and abs(got[name].intercept - one.intercept) < 1e-9
    assert list(got["none"].coefficients) == [0.0] and fit.scored(got["none"], frame, ["a"]).where("p = 0").count() == frame.count()
    with pytest.raises(ValueError, match="no rows"):
        fit.fit_logistic(frame.limit(0), ["a"])


def test_a_ranking_is_both_measures(spark):
    r = np.random.default_rng(8)
    df = spark.createDataFrame([(int(k % 3), float(np.round(a, 2)), int(b)) for k, (a, b) in enumerate(zip(r.random(300), r.random(300) < 0.3, strict=True))], "g int, p double, y int")
    one = {x["g"]: x for x in metrics.ranking(df, "p", "y", ["g"]).collect()}
    area = {x["g"]: x for x in metrics.auc(df, "p", "y", ["g"]).collect()}
    ap = {x["g"]: x["ap"] for x in metrics.average_precision(df, "p", "y", ["g"]).collect()}
    for g in range(3):
        assert (one[g]["auc"], one[g]["positives"], one[g]["n"]) == (area[g]["auc"], area[g]["positives"], area[g]["n"]) and one[g]["ap"] == pytest.approx(ap[g], abs=1e-12)


@given
def test_a_grid_of_regressions_shares_its_passes(spark, monkeypatch):  # L9
    passes, sums = [], fit._class_sums
    monkeypatch.setattr(fit, "_class_sums", lambda used, fits: passes.append(len(fits)) or sums(used, fits))
    built, raw = [], models.raw_table
    monkeypatch.setattr(models, "raw_table", lambda *a: built.append(a) or raw(*a))
    grid = models.l09(spark, SF).collect()
    assert len(grid) == 10 and passes[0] == 10 and len(passes) <= 15 and len(built) == 1
    t = models.model_table(spark, SF)
    one = models.evaluated(fit.scored(fit.fit_logistic(t.where(models.TRAIN), models.ALL), t.where("season >= 3"), models.ALL)).first()
    whole = next(r for r in grid if (r["cohort"], r["features"]) == ("all", "full"))
    assert whole["n"] == one["n"] and whole["auc"] == pytest.approx(one["auc"], abs=1e-6)


def pooled(s, y):
    """Pool adjacent violators: the isotonic values at the sorted distinct scores."""
    at = np.unique(s)
    blocks = []
    for v in at:
        blocks.append([y[s == v].mean(), int((s == v).sum()), 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return at, np.concatenate([[b[0]] * b[2] for b in blocks])


def test_isotonic_equals_pooled_neighbours(spark):  # L6
    r = np.random.default_rng(4)
    s = np.round(r.random(200), 2)
    y = (r.random(200) < s * s).astype(float)
    val = spark.createDataFrame([(float(a), float(b)) for a, b in zip(s, y, strict=True)], "p double, y double")
    got = {x["p"]: x["p_cal"] for x in fit.recalibrated(val, val.select("p"), "p", "y").collect()}
    for v, want in zip(*pooled(s, y), strict=True):
        assert got[v] == pytest.approx(want, abs=1e-9)


def test_selection_takes_the_best_on_validation(spark):  # L7, L9
    t = planted(spark, 900, 5, 2.0)
    rows = models.union(models.evaluated(fit.scored(fit.fit_logistic(t.where("user_id < 500"), x), t.where("user_id >= 500"), x), features=n) for n, x in {"both": ["a", "b"], "one": ["b"]}.items())
    one = {r["features"]: r for r in rows.collect()}
    assert one["both"]["auc"] > one["one"]["auc"] and one["both"]["n"] == one["one"]["n"] == 400
    assert rows.agg(models.F.max_by("features", "ap")).first()[0] == "both"


@given
def test_selection_scores_the_test_seasons_once(spark, monkeypatch):  # L7
    monkeypatch.setattr(models.fitted, "__defaults__", ({"forest": {"trees": 5, "depth": 3}, "boosting": {"rounds": 2, "depth": 2, "rate": 0.2}}, 7))
    out = models.l07(spark, SF).collect()
    t = models.model_table(spark, SF)
    train, val, test = models.parts(t)
    assert [(r["part"], r["model"]) for r in out[:4]] == [("val", n) for n in (*models.ALGORITHMS, "parsimonious boosting")]
    assert len(out) == 5 and out[4]["part"] == "test" and {r["n"] for r in out[:4]} == {val.count()} and out[4]["n"] == test.count() > 0
    assert out[4]["model"] == max(out[:4], key=lambda r: r["ap"])["model"]
    one = models.evaluated(fit.scored(fit.fit_logistic(train, models.ALL), val, models.ALL)).first()
    assert out[0]["auc"] == pytest.approx(one["auc"], abs=1e-9) and out[0]["ap"] == pytest.approx(one["ap"], abs=1e-9)


@given
def test_selection_of_equals_takes_the_first(spark, monkeypatch):  # L7
    # a validation season without events tells no candidate from another
    t = models.model_table(spark, SF).withColumn("y", models.F.expr("if(season = 2, 0, y)")).cache()
    monkeypatch.setattr(models, "modelled", lambda *a: models.held(t))
    monkeypatch.setattr(models, "fitted", lambda name, train, columns, *a: fit.fit_logistic(train, columns))
    out = models.l07(spark, SF).collect()
    assert {(r["positives"], r["ap"]) for r in out[:4]} == {(0, None)} and out[4]["model"] == "logistic" and out[4]["ap"] > 0


def test_one_class_against_the_rest(spark):  # L10
    t = planted(spark, 300, 6, 2.0)
    rows = {k: {r["user_id"] for r in models.of_class(t, k).where("y = 1").collect()} for k in (1, 2, 3)}
    assert not (rows[1] & rows[2]) and sum(map(len, rows.values())) == t.where("y = 1").count()
    assert rows[2] == {r["user_id"] for r in t.where("tissue = 2").collect()}


@given
def test_windows_refit_their_own_labels(spark):  # L12
    got = {w: models.model_table(spark, SF, w).agg(models.F.count("*"), models.F.sum("y")).first() for w in (1, 3)}
    assert 0 < got[1][1] <= got[3][1]  # a wider window links no fewer events


def test_a_round_of_refits_adds_up_few_tables_of_rows_and_replicates():
    # against the sums of each cluster written out; cut clusters come as rows of their own
    import tracemalloc

    import pyarrow as pa

    from tideline.operators import replicates

    r = np.random.default_rng(4)
    reps, p, sizes = 500, 3, r.integers(1, 9, 60)
    pairs = [(j, k) for j in range(p) for k in range(j, p)]
    x = [np.hstack([(r.random((n, 1)) < 0.3), np.ones((n, 1)), r.normal(size=(n, p - 1))]) for n in sizes]
    w = r.poisson(1, (len(sizes), reps))
    drawn = [[{"rep": int(k), "w": int(c[k])} for k in np.flatnonzero(c)] for c in w]
    beta, alpha = r.normal(size=(reps, p)) / 3, r.uniform(0, 0.3, reps)
    cut = np.arange(len(sizes)) % 20 == 7
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.struct([("rep", pa.int32()), ("w", pa.int32())]))]
    columns = [np.arange(len(sizes)), np.where(cut, 2, 1), [c.ravel().tolist() for c in x], drawn]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["cluster", "parts", "values", "weights"])
    tracemalloc.start()
    got = list(replicates._round_sums(p, pairs, np.arange(reps), beta, alpha)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 1 + cut.sum()
    expected = np.zeros((reps, 4 + p + len(pairs)))
    for own, by in zip([c for c, k in zip(x, cut, strict=True) if not k], w[~cut], strict=True):
        y, z, m = own[:, :1], own[:, 1:], len(own)
        mu = 1 / (1 + np.exp(-z @ beta.T))
        s = np.sqrt(mu * (1 - mu))
        e = (y - mu) / s
        c = alpha / (1 + (m - 1) * alpha)
        t = z.T @ s
        score = [(z[:, j] @ (y - mu) - c * t[j] * e.sum(0)) / (1 - alpha) for j in range(p)]
        info = [((z[:, j] * z[:, k]) @ (s * s) - c * t[j] * t[k]) / (1 - alpha) for j, k in pairs]
        squares = (e * e).sum(0)
        expected += by[:, None] * np.stack([e.sum(0) ** 2 - squares, np.full(reps, m * (m - 1)), squares, np.full(reps, m), *score, *info], 1)
    assert np.allclose(np.array(got[-1]["v"].to_pylist()), expected, rtol=1e-9, atol=1e-9)
    assert peak < 14 * 8 * reps * sizes.sum()  # fewer tables than the sums have columns
