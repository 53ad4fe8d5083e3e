"""Queries that fit models. No SQL gives these: tests hold the fits against dense algebra.

Sizes of forests and boosting are those of ``FULL``, but for boosting in a grid of fits (``GRID``,
see the README). Reports are a few rows, worked out while the model table is there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import auc_error
from ..operators import asof
from ..operators import features as X
from ..operators import fit as L
from ..operators import metrics as M
from ..operators import resample as R
from ..sources import scratch
from .registry import query
from .views import SPEC, outcomes, scores

WORKLOAD = ["cents_r5", "cents_std", "n_r5", "k_r5"]
SCHEDULE = ["rest_days", "rows_7d", "panel_rows", "season_rows"]
HISTORY = ["n_before", "n_recent"]
ALL = WORKLOAD + SCHEDULE + HISTORY
LEAK = ["cents", "n"]
TRAIN = "season <= 1"
LEAST_EVENTS = 25
FULL = {"forest": {"trees": 400, "depth": 10}, "boosting": {"rounds": 400, "depth": 4, "rate": 0.05}}
GRID = {"forest": FULL["forest"], "boosting": {"rounds": 15, "depth": 3, "rate": 0.2}}
SEEDS = range(1, 6)
AT_ONCE = 4  # fits of a grid that run at the same time
REFITS = 500
MEASURES = "auc double, ap double, positives long, n long"
NOTHING = (None, None, None, 0)  # measures of no rows


def raw_table(spark, d, window: int = 3) -> DataFrame:
    """Eligible rows with history and features."""
    o = outcomes(spark, d, window)
    f = asof.history(X.build_features(o, SPEC), o.where("y = 1").select("user_id", F.col("day").alias("event_day")), ["user_id"], "day", "event_day", 10)
    return f.where("eligible and panel_rows >= 3").select("user_id", "day", "season", "y", "tissue", *ALL, *LEAK)


def scaled(t: DataFrame) -> DataFrame:
    """Imputed and scaled on the training seasons; reads ``t`` three times."""
    return L.standardised(L.imputed(t, [*ALL, *LEAK], TRAIN), [*ALL, *LEAK], TRAIN)


def model_table(spark, d, window: int = 3) -> DataFrame:
    return scaled(raw_table(spark, d, window))


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` written once for the time of some fits: a lost executor costs them nothing but a read."""
    path = scratch.new_path(df.sparkSession, "model")
    df.write.parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        scratch.dropped(df.sparkSession, path)


@contextmanager
def modelled(spark, d, window: int = 3, then: Callable[[DataFrame], DataFrame] = lambda t: t) -> Iterator[DataFrame]:
    """``then`` of the model table, held; features are worked out once, medians and deviations read them."""
    with held(raw_table(spark, d, window)) as raw, held(then(scaled(raw))) as t:
        yield t


def at_once(spark, jobs: dict[str, Callable]) -> dict:
    """The results of ``jobs`` by name, ``AT_ONCE`` at a time, each in a scheduler pool of its own. A fit is many small
    jobs one after the other; under ``spark.scheduler.mode=FAIR`` those of other fits fill the time between."""

    def run(name: str, job: Callable):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit {name}")
        try:
            return job()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(AT_ONCE) as pool:
        waiting = {n: pool.submit(run, n, j) for n, j in jobs.items()}
        return {n: w.result() for n, w in waiting.items()}


def report(df: DataFrame) -> DataFrame:
    """The few rows of ``df``, worked out now."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def parts(t: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return t.where(TRAIN), t.where("season = 2"), t.where("season >= 3")


def evaluated(df: DataFrame, /, **keys) -> DataFrame:
    """One row: keys, auc, ap, positives, n."""
    return M.ranking(df, "p", "y").select(*(F.lit(v).alias(k) for k, v in keys.items()), "auc", "ap", "positives", "n")


def judged(model, test: DataFrame, columns: list[str], /, **keys) -> DataFrame:
    """``evaluated`` for the scores of ``model``, which are worked out once."""
    with held(L.scored(model, test, columns).select("y", "p")) as s:
        return report(evaluated(s, **keys))


@contextmanager
def regressions(t: DataFrame, cells: dict[str, tuple[list[str], Column, Column, Column]], *keep: Column) -> Iterator[DataFrame]:
    """Scores of the test rows of all cells (covariates, label, training rows, test rows) by regressions that are fitted at
    once: cell, y, p and ``keep``."""
    fits = L.fit_logistics(t, {n: cell[:3] for n, cell in cells.items()})
    each = (F.when(test, F.struct(F.lit(n).alias("cell"), y.cast("int").alias("y"), fits[n].probability().alias("p"))) for n, (_, y, _, test) in cells.items())
    with held(t.select(*keep, F.explode(F.array(*each)).alias("_s")).where("_s is not null").select("*", "_s.*").drop("_s")) as s:
        yield s


def by_cell(s: DataFrame) -> dict[str, tuple]:
    """auc, ap, positives and n of each cell of ``regressions``."""
    return {r["cell"]: (r["auc"], r["ap"], r["positives"], r["n"]) for r in M.ranking(s, "p", "y", ["cell"]).collect()}


def union(frames) -> DataFrame:
    """One report of those in ``frames``."""
    out = None
    for f in frames:
        out = report(f) if out is None else report(out.unionByName(f))
    return out


def fitted(name: str, train: DataFrame, columns: list[str], size: dict = FULL, seed: int = 7):
    if name == "logistic":
        return L.fit_logistic(train, columns)
    if name == "forest":
        return L.fit_forest(train, columns, **size["forest"], seed=seed)
    return L.fit_boosting(train, columns, **size["boosting"], seed=seed)


ALGORITHMS = ("logistic", "forest", "boosting")


def terms(spark, *rows) -> DataFrame:
    return spark.createDataFrame([(name, *r) for name, f in rows for r in f.rows()], f"model string, {L.TERMS}")


@query("m05_calibration_slope")
def m05(spark, d):
    with held(scores(spark, d)) as s:
        return terms(spark, ("slope", L.calibration_slope(s, "p", "y", "cluster")))


@query("m06_calibration_in_the_large")
def m06(spark, d):
    with held(scores(spark, d)) as s:
        return terms(spark, ("in the large", L.calibration_in_the_large(s, "p", "y")))


def one_model(spark, d, name: str) -> DataFrame:
    """Test rows with the score of a model of full size, written: the table that they are made from is gone afterwards."""
    with modelled(spark, d) as t:
        model = fitted(name, t.where(TRAIN), ALL)
        return scratch.written(L.scored(model, parts(t)[2], ALL).select("user_id", "day", "y", "p"), "scored")


@query("l03_logistic")
def l03(spark, d):
    return one_model(spark, d, "logistic")


@query("l04_forest")
def l04(spark, d):
    return one_model(spark, d, "forest")


@query("l05_boosting")
def l05(spark, d):
    return one_model(spark, d, "boosting")


@query("l06_isotonic")
def l06(spark, d):
    """Recalibration on the validation season, with the number of distinct scores it leaves."""
    with modelled(spark, d) as t:
        train, val, test = parts(t)
        model = L.fit_logistic(train, ALL)
        out = L.recalibrated(L.scored(model, val, ALL), L.scored(model, test, ALL))
        raw, cal = M.brier(out, "p", "y").select(F.col("brier").alias("raw_brier")), M.brier(out, "p_cal", "y").select(F.col("brier").alias("brier"))
        return report(raw.join(cal).join(out.agg(F.count_distinct("p").alias("raw_scores"), F.count_distinct("p_cal").alias("scores"))))


@query("l07_selection")
def l07(spark, d):
    """Four candidates by average precision on the validation season; the best, the first of equal ones, meets
    the test seasons once."""
    with modelled(spark, d) as t:
        train, val, test = parts(t)
        few = [*SCHEDULE, *HISTORY]
        tried = {n: (n, ALL) for n in ALGORITHMS} | {"parsimonious boosting": ("boosting", few)}
        fits = at_once(spark, {n: partial(fitted, a, train, c) for n, (a, c) in tried.items()})
        candidates = {n: (c, fits[n]) for n, (_, c) in tried.items()}
        on_val = union(judged(m, val, c, model=n) for n, (c, m) in candidates.items())
        best = max(on_val.collect(), key=lambda r: r["ap"] or 0.0)["model"]
        columns, model = candidates[best]
        final = judged(model, test, columns, model=best)
        return report(on_val.select(F.lit("val").alias("part"), "*").unionByName(final.select(F.lit("test").alias("part"), "*")))


SETS = {"full": ALL, "no_history": WORKLOAD + SCHEDULE, "schedule": SCHEDULE, "workload": WORKLOAD, "history": HISTORY}


@query("l08_ablation")
def l08(spark, d):
    """Five feature sets under three algorithms; whether "workload adds nothing to the schedule"
    holds, by algorithm."""
    with modelled(spark, d) as t:
        train, _, test = parts(t)

        def cell(a: str, n: str, c: list[str]) -> DataFrame:
            return judged(fitted(a, train, c, GRID), test, c, algorithm=a, features=n, n_features=len(c))

        rows = union(at_once(spark, {f"{a} {n}": partial(cell, a, n, c) for a in ALGORITHMS for n, c in SETS.items()}).values())
    whole = rows.where("features = 'full'").select("algorithm", F.col("auc").alias("_full"))
    schedule = rows.where("features = 'schedule'").select("algorithm", F.col("auc").alias("_schedule"))
    workload = rows.where("features = 'workload'").select("algorithm", F.col("auc").alias("_workload"))
    met = rows.join(F.broadcast(whole), "algorithm").join(F.broadcast(schedule), "algorithm").join(F.broadcast(workload), "algorithm")
    verdict = F.when(F.col("_schedule") >= F.col("_workload"), "holds").otherwise("attenuated")
    return met.select("algorithm", "features", "n_features", "auc", "ap", (F.col("ap") * F.col("n") / F.col("positives")).alias("lift"), (F.col("_full") - F.col("auc")).alias("loss"), verdict.alias("verdict"))


@query("l09_cohort_grid")
def l09(spark, d):
    cohorts = {"all": F.lit(True), "late": F.col("season") >= 1}
    grid = {f"{n} {m}": (n, m) for n in cohorts for m in SETS}
    cells = {k: (SETS[m], F.col("y"), cohorts[n] & F.expr(TRAIN), cohorts[n] & (F.col("season") >= 3)) for k, (n, m) in grid.items()}
    with modelled(spark, d) as t, regressions(t, cells) as s:
        got = by_cell(s)
    return spark.createDataFrame([(*key, *got.get(k, NOTHING)) for k, key in grid.items()], f"cohort string, features string, {MEASURES}")


def class_label(k: int) -> Column:
    """Class ``k`` against everything else."""
    return (F.coalesce(F.col("tissue") == k, F.lit(False)) & (F.col("y") == 1)).cast("int")


def of_class(t: DataFrame, k: int) -> DataFrame:
    return t.withColumn("y", class_label(k))


@query("l10_one_vs_rest")
def l10(spark, d):
    cells = {str(k): (ALL, class_label(k), F.expr(TRAIN), F.col("season") >= 3) for k in (1, 2, 3)}
    with modelled(spark, d) as t, regressions(t, cells) as s:
        got = by_cell(s)
    return spark.createDataFrame([(int(k), *got.get(k, NOTHING)) for k in cells], f"tissue int, {MEASURES}")


@query("l11_gated_fit")
def l11(spark, d):
    """Each class is a stratum with a model of its own; below ``LEAST_EVENTS`` test events nothing
    is fitted and only counts are reported. Medians and ranges are over seeds."""
    rows = []
    with modelled(spark, d) as t:
        train, _, test = parts(t)
        for k in (1, 2, 3):
            own, events = of_class(train, k), of_class(test, k)
            n, found = events.agg(F.count("*"), F.sum("y")).first()
            if (found or 0) < LEAST_EVENTS:
                rows.append((k, n, found or 0, "report only", LEAST_EVENTS - (found or 0), None, None, None))
                continue

            def of_seed(s: int, own=own, events=events) -> float:
                return judged(fitted("boosting", own, ALL, GRID, s), events, ALL).first()["auc"]

            aucs = sorted(at_once(spark, {str(s): partial(of_seed, s) for s in SEEDS}).values())
            rows.append((k, n, found, "fit", 0, aucs[len(aucs) // 2], aucs[0], aucs[-1]))
    return spark.createDataFrame(rows, "tissue int, n long, k long, gate string, shortfall long, auc double, lowest double, highest double")


@query("l12_window_refits")
def l12(spark, d):
    out = []
    for w in (1, 2, 3):
        with modelled(spark, d, w) as t:
            train, _, test = parts(t)
            out.append(judged(L.fit_logistic(train, ALL), test, ALL, match_window=w))
    return union(out)


@query("l13_leak_by_split")
def l13(spark, d):
    """Two splits x two arms. Within a split both arms score the same rows (an error otherwise);
    the temporal split covers all but the reserved validation season, the random one covers
    everything. The effect of the split alone is between different test rows, so it is a
    difference of two estimates, told with whether the sizes of the training parts could produce it."""
    rows, arms = [], {"clean": ALL, "with same-row columns": ALL + LEAK}
    splits = {"temporal": (F.expr(TRAIN), F.col("season") >= 3), "random": (~F.col("is_test"), F.col("is_test"))}
    cells = {f"{split}, {arm}": (cols, F.col("y"), *parts_) for split, parts_ in splits.items() for arm, cols in arms.items()}
    with modelled(spark, d, then=lambda t: R.stratified_split(t, "y", 0.25, 21, "user_id", "day")) as t:
        sizes = (F.coalesce(F.sum(train.cast("long")), F.lit(0)) for train, _ in splits.values())
        whole, reserved, *trained = t.agg(F.count("*"), F.coalesce(F.sum((F.col("season") == 2).cast("long")), F.lit(0)), *sizes).first()
        with regressions(t, cells, F.xxhash64("user_id", "day").alias("member")) as s:
            got = by_cell(s)
            member = {r["cell"]: r["digest"] for r in s.groupBy("cell").agg(F.expr("bit_xor(member)").alias("digest")).collect()}
    for split, n_train in zip(splits, trained, strict=True):
        digests = set()
        for arm in arms:
            auc, ap, _, n = got.get(f"{split}, {arm}", NOTHING)
            digests.add((member.get(f"{split}, {arm}"), n))
            rows.append({"split": split, "arm": arm, "auc": auc, "ap": ap, "n_train": n_train, "n_test": n or 0})
        if len(digests) > 1:
            raise AssertionError(f"the arms of the {split} split scored different rows")
        if n_train + rows[-1]["n_test"] + (reserved if split == "temporal" else 0) != whole:
            raise AssertionError(f"the {split} split lost rows")
    temporal, random = (next(r for r in rows if r["split"] == s and r["arm"] == "clean") for s in ("temporal", "random"))
    effect = random["auc"] - temporal["auc"]
    confounded = (effect > 0) == (random["n_train"] > temporal["n_train"])
    out = [(r["split"], r["arm"], r["auc"], r["ap"], r["n_train"], r["n_test"], whole, reserved, effect, "same direction" if confounded else "opposite direction") for r in rows]
    return spark.createDataFrame(out, "split string, arm string, auc double, ap double, n_train long, n_test long, cohort long, reserved long, split_effect double, size_confound string")


@query("l14_glm_cluster_robust")
def l14(spark, d):
    """Two workloads, each with main effects alone and with its interaction with rest."""
    out = []
    with modelled(spark, d, then=lambda t: t.where("season >= 3")) as t:
        for c in ("cents_r5", "n_r5"):
            main = [c, "rest_days", "panel_rows"]
            both = t.withColumn("interaction", F.col(c) * F.col("rest_days"))
            out += [(f"{c} main", L.logistic_glm(t, main, "y", "user_id")), (f"{c} interaction", L.logistic_glm(both, [*main, "interaction"], "y", "user_id"))]
    rows = terms(spark, *out)
    z = F.abs(F.col("beta") / F.col("robust_se"))
    return rows.withColumns({"lo": F.exp(F.col("beta") - 1.959964 * F.col("robust_se")), "hi": F.exp(F.col("beta") + 1.959964 * F.col("robust_se")), "z": z})


@query("l15_exchangeable")
def l15(spark, d):
    with modelled(spark, d) as t:
        lagged, alpha = L.exchangeable_logistic(t, ["cents_r5", "n_r5"], "y", "user_id")
        concurrent, beta = L.exchangeable_logistic(t, ["cents", "n"], "y", "user_id")
    out = terms(spark, ("lagged", lagged), ("concurrent", concurrent))
    return out.withColumn("correlation", F.when(F.col("model") == "lagged", F.lit(alpha)).otherwise(F.lit(beta)))


@query("l16_interaction_test")
def l16(spark, d):
    """Whether the effect of a short rest depends on the role (three values): two terms more."""
    o = outcomes(spark, d)
    f = X.build_features(o, SPEC).where("eligible and rest_days is not null")
    f = f.select("y", (F.col("rest_days") <= 2).cast("double").alias("short"), *((F.col("prior_mode") == v).cast("double").alias(v) for v in ("view", "purchase")))
    with held(f.withColumns({f"short_{v}": F.col("short") * F.col(v) for v in ("view", "purchase")})) as t:
        main = ["short", "view", "purchase"]
        small, large = L.logistic_glm(t, main, "y"), L.logistic_glm(t, [*main, "short_view", "short_purchase"], "y")
    stat, p, df = L.likelihood_ratio(small, large)
    return spark.createDataFrame([(stat, p, df, "interaction" if p <= 0.05 else "none detected")], "statistic double, p double, df int, verdict string")


@query("l17_ablation_delta")
def l17(spark, d):
    """A forest of full size with and without the workload block."""
    with modelled(spark, d) as t:
        train, _, test = parts(t)
        with_, without = (judged(fitted("forest", train, c), test, c).first()["auc"] for c in (ALL, SCHEDULE + HISTORY))
    return spark.createDataFrame([(with_, without, with_ - without)], "auc_all double, auc_without double, delta double")


@query("l18_permuted_control")
def l18(spark, d):
    """With labels permuted over the table no algorithm may leave the band around one half."""
    with modelled(spark, d, then=lambda t: R.permuted(t, "y", 31, "user_id", "day")) as t:
        train, _, test = parts(t)
        e = union(at_once(spark, {a: lambda a=a: judged(fitted(a, train, ALL, GRID), test, ALL, algorithm=a) for a in ALGORITHMS}).values())
    se = auc_error(F.lit(0.5), F.col("positives"), F.col("n") - F.col("positives"))
    band = e.withColumns({"band_lo": 0.5 - 2.576 * se, "band_hi": 0.5 + 2.576 * se})
    return band.withColumn("verdict", F.when(F.col("auc").between(F.col("band_lo"), F.col("band_hi")), "pass").otherwise("fail"))


def refit_contrast(t: DataFrame, lagged: list[str], concurrent: list[str], cluster: str, replicates: int, seed: int) -> DataFrame:
    """For each pair of covariates: the difference of their coefficients in the full fits of both
    arms, and its interval over bootstrap replicates in which both arms are fitted again;
    replicates in which an arm did not converge are left out and counted."""
    spark = t.sparkSession
    full = [L.exchangeable_logistic(t, xs, "y", cluster)[0].beta for xs in (lagged, concurrent)]
    with held(R.cluster_weights(t.select(cluster).distinct(), cluster, replicates, seed)) as w:
        arms = [{r: b for r, b, ok in L.replicate_fits(t, w, xs, "y", cluster) if ok} for xs in (lagged, concurrent)]
    good = sorted(set(arms[0]) & set(arms[1]))
    schema = "covariate string, rep long, delta double"
    rows = [(a, r, float(arms[1][r][j] - arms[0][r][j])) for j, a in enumerate(lagged, 1) for r in good]
    point = spark.createDataFrame([(a, float(full[1][j] - full[0][j]), replicates - len(good)) for j, a in enumerate(lagged, 1)], "covariate string, estimate double, dropped long")
    out = point.join(R.interval(spark.createDataFrame(rows, schema), "delta", ["covariate"]), "covariate", "left")
    return report(out.withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0)))


@query("r03_bootstrap_refit")
def r03(spark, d):
    with modelled(spark, d) as t:
        return refit_contrast(t, ["cents_r5", "n_r5"], ["cents", "n"], "user_id", REFITS, 3)


@query("r08_seed_sweep")
def r08(spark, d):
    """A forest of full size under each of ``SEEDS``."""
    with modelled(spark, d) as t:
        train, _, test = parts(t)
        runs = union(at_once(spark, {str(s): lambda s=s: judged(fitted("forest", train, ALL, FULL, s), test, ALL, seed=s) for s in SEEDS}).values())
    return runs.agg(F.median("auc").alias("median"), F.min("auc").alias("lowest"), F.max("auc").alias("highest"), F.count("*").alias("seeds"))
