"""Model-table jobs: fits run on executors, the driver holds p x p algebra only."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import logit
from .metrics import medians
from .replicates import Blocks


def imputed(df: DataFrame, columns: Sequence[str], train: Column | str) -> DataFrame:
    """Nulls become the exact median of the training rows (0 where there is none)."""
    rows = df.where(train).select(F.explode(F.array(*(F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_value")) for c in columns))).alias("_r"))
    known = {r["_name"]: r["median"] for r in medians(rows.select("_r.*"), "_value", ["_name"]).collect()}  # one number a column
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(known.get(c) or 0.0))) for c in columns})


def standardised(df: DataFrame, columns: Sequence[str], train: Column | str) -> DataFrame:
    """Mean 0 and population deviation 1 on the training rows."""
    m = df.where(train).agg(*(F.avg(c).alias(f"_a_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    z = {c: (F.col(c) - F.col(f"_a_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return df.join(F.broadcast(m)).withColumns(z).drop(*m.columns)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``weight``: both classes weigh the same in sum."""
    m = df.agg(F.count("*").alias("_n"), F.sum(label).alias("_k"))
    w = F.when(F.col(label) == 1, F.try_divide(F.col("_n"), 2.0 * F.col("_k"))).otherwise(F.try_divide(F.col("_n"), 2.0 * (F.col("_n") - F.col("_k"))))
    return df.join(F.broadcast(m)).withColumn("weight", F.coalesce(w, F.lit(1.0))).drop("_n", "_k")


def assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)


@dataclass
class Logistic:
    """A regularised regression; unlike a fitted model of ``pyspark.ml`` it holds no session in a training summary."""

    columns: list[str]
    intercept: float
    coefficients: np.ndarray

    def probability(self) -> Column:
        eta = F.lit(float(self.intercept))
        for c, b in zip(self.columns, self.coefficients, strict=True):
            eta = eta + F.lit(float(b)) * F.col(c)
        return 1 / (1 + F.exp(-eta))


def fit_logistic(train: DataFrame, columns: Sequence[str], label: str = "y", c: float = 0.1) -> Logistic:
    """L2 logistic regression on balanced classes; ``c`` is the inverse strength."""
    return fit_logistics(train, {"one": (columns, F.col(label), F.lit(True))}, c)["one"]


def fit_logistics(df: DataFrame, fits: dict[str, tuple[Sequence[str], Column, Column]], c: float = 0.1, rounds: int = 60) -> dict[str, Logistic]:
    """``fit_logistic`` for each of ``fits`` (covariates, label, condition of the rows that take part), all at once by Newton's
    method: a round is one pass over ``df`` in which each task adds up the p x p sums of the fits that still
    move. Where all labels are the same, covariates have no effect."""
    used = list(dict.fromkeys(x for columns, _, _ in fits.values() for x in columns))
    names = list(fits)
    side = {n: F.coalesce(F.when(rows, label.cast("int")), F.lit(-1)).alias(f"_y{k}") for k, (n, (_, label, rows)) in enumerate(fits.items())}
    data = df.select(*(F.col(x).cast("double").alias(x) for x in used), *side.values())
    at = {n: np.array([0, *(1 + used.index(x) for x in fits[n][0])]) for n in names}
    beta, out = {n: np.zeros(len(at[n])) for n in names}, {}
    for n_round in range(rounds):
        open_ = [(k, at[n], beta[n]) for k, n in enumerate(names) if n not in out]
        if not open_:
            break
        sums = data.mapInArrow(_class_sums(used, open_), "fit int, v array<double>").select("fit", F.posexplode("v")).groupBy("fit", "pos").agg(F.sum("col").alias("v")).collect()
        got = {(r["fit"], r["pos"]): r["v"] for r in sums}
        for k, columns, now in open_:
            n, p = names[k], len(columns)
            v = np.array([got.get((k, i), 0.0) for i in range(2 * (1 + p + p * p))]).reshape(2, -1)
            if not np.isfinite(v).all():
                raise ValueError("null or NaN among the covariates")
            size = v[:, 0]
            if not size.sum():
                raise ValueError("no rows to fit")
            if not size.all():
                out[n] = Logistic(list(fits[n][0]), float("inf") if size[1] else float("-inf"), np.zeros(p - 1))
                continue
            own = c * size.sum() / (2 * size)  # weight of a row of either class, times the strength
            shrink = np.diag([0.0, *np.ones(p - 1)])
            step = np.linalg.lstsq((own[:, None] * v[:, 1 + p :]).sum(0).reshape(p, p) + shrink, own @ v[:, 1 : 1 + p] - shrink @ now, rcond=None)[0]
            beta[n] = now + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8 * (1 + np.abs(now).max()) or n_round == rounds - 1:
                out[n] = Logistic(list(fits[n][0]), float(beta[n][0]), beta[n][1:])
    return out


def _class_sums(used: list[str], fits: list[tuple[int, np.ndarray, np.ndarray]]):
    """For each fit, by class: rows, score and information of a task's rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((2, 1 + len(b) + len(b) ** 2)) for _, _, b in fits]
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *(batch.column(c).to_numpy(zero_copy_only=False) for c in used)])
            for (k, at, beta), t in zip(fits, total, strict=True):
                y = batch.column(f"_y{k}").to_numpy(zero_copy_only=False)
                for label in (0, 1):
                    own = x[y == label][:, at]
                    mu = 1 / (1 + np.exp(-np.clip(own @ beta, -700, 700)))
                    t[label] += np.concatenate([[len(own)], own.T @ (label - mu), ((own * (mu * (1 - mu))[:, None]).T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in fits], pa.int32()), pa.array([t.ravel().tolist() for t in total], pa.list_(pa.float64()))], ["fit", "v"])

    return run


def fit_forest(train: DataFrame, columns: Sequence[str], label: str = "y", trees: int = 400, depth: int = 10, leaf: int = 20, seed: int = 7) -> Model:
    model = RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, cacheNodeIds=True, seed=seed).fit(assembled(balanced(train, label), columns))
    return model.copy()  # without the training summary, whose session can't be sent to tasks once it has run an observation


def fit_boosting(train: DataFrame, columns: Sequence[str], label: str = "y", rounds: int = 400, depth: int = 4, rate: float = 0.05, seed: int = 7) -> Model:
    return GBTClassifier(labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, seed=seed).fit(assembled(balanced(train, label), columns))


def scored(model: Model | Logistic, df: DataFrame, columns: Sequence[str], name: str = "p") -> DataFrame:
    if isinstance(model, Logistic):
        return df.withColumn(name, model.probability())
    out = model.transform(assembled(df, columns))
    return out.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def recalibrated(validation: DataFrame, test: DataFrame, score: str = "p", label: str = "y", name: str = "p_cal") -> DataFrame:
    """Isotonic regression on validation rows, applied to test rows."""
    model = IsotonicRegression(featuresCol=score, labelCol=label).fit(validation)
    return model.transform(test).withColumnRenamed("prediction", name)


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    se: np.ndarray
    robust_se: np.ndarray | None
    loglik: float
    rounds: int
    converged: bool

    def rows(self) -> list[tuple]:
        robust = self.robust_se if self.robust_se is not None else self.se
        return [(n, float(b), float(s), float(r), float(np.exp(b))) for n, b, s, r in zip(self.names, self.beta, self.se, robust, strict=True)]


TERMS = "term string, beta double, se double, robust_se double, odds_ratio double"


def _linear(names: Sequence[str], offset: Column | None = None) -> Column:
    """The linear predictor from the columns of ``_with``."""
    eta = offset if offset is not None else F.lit(0.0)
    for j, n in enumerate(names):
        eta = eta + F.col(n) * F.col(f"_b{j}")
    return eta


def _with(df: DataFrame, beta: np.ndarray) -> DataFrame:
    """``df`` with the coefficients as columns (one row, broadcast): unlike literals they leave
    the plan of a round as it was, so that its code is compiled once."""
    now = df.sparkSession.createDataFrame([tuple(map(float, beta))], ", ".join(f"_b{j} double" for j in range(len(beta))))
    return df.join(F.broadcast(now))


def logistic_glm(df: DataFrame, xs: Sequence[str], label: str, cluster: str | None = None, offset: Column | None = None, intercept: bool = True, rounds: int = 25) -> Fit:
    """Maximum-likelihood logistic regression by Newton's method: one aggregate a round.
    With ``cluster``, robust errors from sums of scores by cluster. Rows with nulls in what
    is used are left out. The frame is read once for each round: cache it if it is costly."""
    names = (["_one"] if intercept else []) + list(xs)
    df = (df.withColumn("_one", F.lit(1.0)) if intercept else df).na.drop(subset=[label, *xs])
    p = len(names)
    pairs = [(j, k) for j in range(p) for k in range(j, p)]
    beta = np.zeros(p)
    info, loglik, done = np.eye(p), float("nan"), False
    for n_round in range(1, rounds + 1):
        eta = _linear(names, offset)
        mu = 1 / (1 + F.exp(-eta))
        resid, w = F.col(label) - mu, mu * (1 - mu)
        row = _with(df, beta).agg(
            *(F.sum(resid * F.col(n)).alias(f"g{j}") for j, n in enumerate(names)),
            *(F.sum(w * F.col(names[j]) * F.col(names[k])).alias(f"h{j}_{k}") for j, k in pairs),
            F.sum(F.col(label) * eta - F.log1p(F.exp(eta))).alias("ll"),
        ).first()
        if row["ll"] is None:
            return Fit(names, beta, np.full(p, np.nan), None, float("nan"), 0, False)
        grad = np.array([row[f"g{j}"] for j in range(p)], float)
        for j, k in pairs:
            info[j, k] = info[k, j] = row[f"h{j}_{k}"]
        loglik = float(row["ll"])
        step = np.linalg.lstsq(info, grad, rcond=None)[0]
        if np.abs(step).max() < 1e-8:
            done = True
            break
        beta = beta + np.clip(step, -5, 5)
    inverse = np.linalg.pinv(info)
    robust = None
    if cluster:
        resid = F.col(label) - 1 / (1 + F.exp(-_linear(names, offset)))
        scores = _with(df, beta).groupBy(cluster).agg(*(F.sum(resid * F.col(n)).alias(f"u{j}") for j, n in enumerate(names)))
        row = scores.agg(F.count("*").alias("g"), *(F.sum(F.col(f"u{j}") * F.col(f"u{k}")).alias(f"m{j}_{k}") for j, k in pairs)).first()
        meat = np.zeros((p, p))
        for j, k in pairs:
            meat[j, k] = meat[k, j] = row[f"m{j}_{k}"]
        g = row["g"]
        robust = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse) * g / max(1, g - 1), 0))
    return Fit([n.replace("_one", "(intercept)") for n in names], beta, np.sqrt(np.maximum(np.diag(inverse), 0)), robust, loglik, n_round, done)


def exchangeable_logistic(df: DataFrame, xs: Sequence[str], label: str, cluster: str, rounds: int = 25) -> tuple[Fit, float]:
    """Population-averaged logistic regression with one correlation within clusters. The
    inverse of an exchangeable matrix is closed-form, so each round needs a cluster's sums
    only; the correlation is a moment estimate from residual sums. Where it can't be
    estimated, independence (0) is used."""
    names = ["_one", *xs]
    df = df.withColumn("_one", F.lit(1.0)).na.drop(subset=[label, cluster, *xs])
    p = len(names)
    pairs = [(j, k) for j in range(p) for k in range(j, p)]
    beta = logistic_glm(df, xs, label).beta
    alpha, done = 0.0, False
    for n_round in range(1, rounds + 1):
        mu = 1 / (1 + F.exp(-_linear(names)))
        s = F.sqrt(mu * (1 - mu))
        r = (F.col(label) - mu) / s
        x = [F.col(n) * s for n in names]
        g = _with(df, beta).groupBy(cluster).agg(
            F.count("*").alias("m"), F.sum(r).alias("r"), F.sum(r * r).alias("rr"), *(F.sum(c).alias(f"x{j}") for j, c in enumerate(x)),
            *(F.sum(c * r).alias(f"xr{j}") for j, c in enumerate(x)), *(F.sum(x[j] * x[k]).alias(f"xx{j}_{k}") for j, k in pairs),
        )
        mom = g.agg(F.sum(F.col("r") ** 2 - F.col("rr")), F.sum(F.col("m") * (F.col("m") - 1)), F.sum("rr"), F.sum("m")).first()
        phi = (mom[2] or 0) / max(1, (mom[3] or 0) - p)
        alpha = float(np.clip((mom[0] or 0) / phi / max(1.0, (mom[1] or 0) - 2 * p), -0.05, 0.95)) if phi and mom[1] else 0.0
        # the inverse is (I - c 11') / (1 - a), with c = a / (1 + (m - 1) a)
        c = F.lit(alpha) / (1 + (F.col("m") - 1) * F.lit(alpha))
        u = [(F.col(f"xr{j}") - c * F.col(f"x{j}") * F.col("r")) / (1 - alpha) for j in range(p)]
        h = {(j, k): (F.col(f"xx{j}_{k}") - c * F.col(f"x{j}") * F.col(f"x{k}")) / (1 - alpha) for j, k in pairs}
        row = g.agg(*(F.sum(u[j]).alias(f"u{j}") for j in range(p)), *(F.sum(h[jk]).alias(f"h{jk[0]}_{jk[1]}") for jk in pairs), *(F.sum(u[j] * u[k]).alias(f"m{j}_{k}") for j, k in pairs)).first()
        info, meat = np.zeros((p, p)), np.zeros((p, p))
        for j, k in pairs:
            info[j, k] = info[k, j] = row[f"h{j}_{k}"]
            meat[j, k] = meat[k, j] = row[f"m{j}_{k}"]
        step = np.linalg.lstsq(info, np.array([row[f"u{j}"] for j in range(p)]), rcond=None)[0]
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            done = True
            break
    inverse = np.linalg.pinv(info)
    robust = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 0))
    return Fit(["(intercept)", *xs], beta, np.sqrt(np.maximum(np.diag(inverse), 0)), robust, float("nan"), n_round, done), alpha


def replicate_fits(df: DataFrame, weights: DataFrame, xs: Sequence[str], label: str, cluster: str, rounds: int = 25) -> list[tuple[int, np.ndarray, bool]]:
    """(rep, coefficients, converged) of the population-averaged model for all bootstrap
    replicates at once. A cluster that a replicate draws w times counts as w clusters, so a
    round needs each cluster's sums by replicate, times w. Rows lie in blocks of whole clusters, written once; a
    round reads them and returns a row of sums for each task and replicate. Replicates that have
    converged take no part in further rounds."""
    p = len(xs) + 1
    blocks = Blocks(df, weights, xs, label, cluster)
    beta = {r["rep"]: np.zeros(p) for r in weights.select("rep").distinct().collect()}  # as many as asked for
    alpha, moved = dict.fromkeys(beta, 0.0), dict.fromkeys(beta, float("inf"))
    for n_round in range(rounds):
        open_ = sorted(k for k in beta if moved[k] >= 1e-7)
        if not open_:
            break
        for row in blocks.round(open_, np.array([beta[k] for k in open_]), np.array([alpha[k] for k in open_])):
            rep, (pair_sum, pairs, squares, n, *rest) = row["rep"], row["v"]
            info = np.zeros((p, p))
            for (j, k), v in zip(blocks.pairs, rest[p:], strict=True):
                info[j, k] = info[k, j] = v
            step = np.linalg.lstsq(info, np.array(rest[:p]), rcond=None)[0]
            phi = squares / max(1, n - p)
            # the correlation of this round's residuals serves the next round
            new = float(np.clip(pair_sum / phi / max(1.0, pairs - 2 * p), -0.05, 0.95)) if phi and pairs else 0.0
            moved[rep] = max(float(np.abs(step).max()), abs(new - alpha[rep])) if n_round else float("inf")
            beta[rep], alpha[rep] = beta[rep] + np.clip(step, -5, 5), new
    blocks.remove()
    return [(k, beta[k], moved[k] < 1e-5) for k in sorted(beta)]


def calibration_slope(df: DataFrame, score: str, label: str, cluster: str | None = None) -> Fit:
    """Slope of the label on the score's logit; 1 is well calibrated."""
    return logistic_glm(df.withColumn("_logit", logit(F.col(score))), ["_logit"], label, cluster)


def calibration_in_the_large(df: DataFrame, score: str, label: str) -> Fit:
    """Intercept with the score's logit as offset; 0 is well calibrated."""
    return logistic_glm(df.withColumn("_logit", logit(F.col(score))), [], label, offset=F.col("_logit"))


def likelihood_ratio(small: Fit, large: Fit) -> tuple[float, float, int]:
    """Statistic, p value, degrees of freedom (1 or 2) of two nested fits."""
    from math import erfc, exp, sqrt

    stat, df = max(0.0, 2 * (large.loglik - small.loglik)), len(large.beta) - len(small.beta)
    if df not in (1, 2):
        raise ValueError("one or two further terms")
    return stat, exp(-stat / 2) if df == 2 else erfc(sqrt(stat / 2)), df
