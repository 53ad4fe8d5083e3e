"""Bootstrap replicates as vectors: a cluster's weights in all replicates lie together, and what is
added up is a vector with a number for each replicate. Rows are never repeated by replicate.

What is shuffled does not grow with rows x replicates: a rate's sums are added within each task
before anything is sent; an AUC is one pass over counts by (cluster, score) in score order, in
slices, each of which returns three vectors; a refit reads blocks of whole clusters that are written
once, and each task returns one row of sums for each replicate.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import dropped, new_path, written
from .sliced import cut_points, slice_number, slices_of

CELLS = 1 << 24  # numbers of a block of weights (clusters x replicates) that all tasks get: 64 MB
AT_ONCE = 1 << 21  # numbers of a table (rows x replicates) in a task
CHUNK = 50_000  # rows of a cluster in one block


def weight_vectors(weights: DataFrame, cluster: str) -> DataFrame:
    """(cluster, weights: array of rep and w) from (rep, cluster, w); replicates without the cluster are left out."""
    return weights.groupBy(cluster).agg(F.collect_list(F.struct(F.col("rep").cast("int").alias("rep"), F.col("w").cast("int").alias("w"))).alias("weights"))


def replicate_sums(vectors: DataFrame, counts: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """(rep, columns): weighted sums of ``columns`` of ``counts`` (one row for each cluster) in each replicate. The
    vectors are taken apart and added within a task; a task sends a row for each replicate."""
    one = counts.select(cluster, *columns).join(vectors, cluster).select(*columns, F.explode("weights").alias("_w"))
    return one.groupBy(F.col("_w.rep").cast("long").alias("rep")).agg(*(F.sum(F.col("_w.w") * F.col(c)).alias(c) for c in columns))


def _matrix(weights: DataFrame, numbers: DataFrame, cluster: str, low: int, high: int, n: int) -> np.ndarray:
    """Weights of clusters 0 to n - 1 in the replicates from ``low`` to ``high``; at most ``CELLS`` numbers."""
    part = weights.where((F.col("rep") >= low) & (F.col("rep") < high)).join(numbers, cluster)
    got = part.select(F.col("_i").cast("long"), F.col("rep").cast("long"), F.col("w").cast("int")).toArrow()
    out = np.zeros((n, high - low), np.int32)
    out[got["_i"].to_numpy(), got["rep"].to_numpy() - low] = got["w"].to_numpy()
    return out


def _slice_sums(sent):
    """For each slice, whose rows come with falling scores: pairs of a positive above a negative (ties half), positives and
    negatives in each replicate."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        reps = weights.shape[1]
        now = None

        def close() -> pa.RecordBatch:
            pairs, above, total = now[1] + now[3][1] * (now[2] + now[3][0] / 2), now[2] + now[3][0], now[4] + now[3][1]
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in (pairs, above, total))], ["slice", "pairs", "pos", "neg"])

        step = max(1, AT_ONCE // max(1, reps))
        for batch in batches:
            slices, score = batch.column("slice").to_numpy(), batch.column("score").to_numpy()
            i, n, k = (batch.column(c).to_numpy() for c in ("i", "n", "k"))
            bounds = np.flatnonzero(np.diff(slices)) + 1
            for a, z in zip([0, *bounds], [*bounds, len(slices)], strict=True):
                for at in range(a, z, step):
                    own = slice(at, min(z, at + step))
                    if now is None or now[0] != slices[at]:
                        if now is not None:
                            yield close()
                        zero = np.zeros(reps)
                        now = [int(slices[at]), zero, zero, (zero, zero, None), zero]  # slice, pairs, positives above, the open tie, negatives above
                    w = weights[i[own]].astype(float)
                    first = np.flatnonzero(np.concatenate([[True], np.diff(score[own]) != 0]))
                    pos = np.add.reduceat(w * k[own][:, None], first, axis=0)
                    neg = np.add.reduceat(w * (n[own] - k[own])[:, None], first, axis=0)
                    if now[3][2] is not None and now[3][2] == score[at]:  # the tie goes on
                        pos[0] += now[3][0]
                        neg[0] += now[3][1]
                    else:
                        now[1] = now[1] + now[3][1] * (now[2] + now[3][0] / 2)
                        now[2], now[4] = now[2] + now[3][0], now[4] + now[3][1]
                    above = now[2] + np.cumsum(pos, axis=0) - pos
                    now[1] = now[1] + (neg[:-1] * (above[:-1] + pos[:-1] / 2)).sum(0)
                    now[2], now[4] = above[-1], now[4] + neg[:-1].sum(0)
                    now[3] = (pos[-1], neg[-1], score[own][-1])
        if now is not None:
            yield close()

    return run


def replicate_auc(scored: DataFrame, score: str, label: str, cluster: str, weights: DataFrame, replicates: int) -> DataFrame:
    """(rep, auc) for replicates 0 to ``replicates`` - 1 of the clusters of ``scored``, by ``weights`` (rep, cluster, w); null where
    a replicate lacks a class. Where distinct scores times replicates are at most ``AT_ONCE``, each task adds up its own clusters'
    weight vectors by score, and no weight passes through the driver. Otherwise weights go to all tasks in blocks
    of replicates of a bounded size, each of which is one pass over the counts; the counts travel without them."""
    spark = scored.sparkSession
    known = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull() & F.col(cluster).isNotNull())
    counts = known.groupBy(cluster, F.col(score).cast("double").alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("k"))
    few = AT_ONCE // max(1, replicates)
    values = [r[0] for r in known.select(F.col(score).cast("double")).distinct().limit(few + 1).collect()]
    if len(values) <= few:
        return _auc_of_slices(_score_sums(counts, weights, cluster, np.sort(values), replicates))
    numbers = written(_numbered(weights.select(cluster).distinct()), "clusters")
    n = numbers.count()
    cuts = cut_points(known, F.col(score).cast("double"), slices_of(scored))
    rows = written(counts.join(numbers, cluster).select(F.col("_i").cast("int").alias("i"), "score", "n", "k", slice_number(F.col("score"), cuts).alias("slice")), "counts")
    dealt = rows.repartition("slice").sortWithinPartitions("slice", F.desc("score"))
    block, parts = max(1, min(replicates, CELLS // max(1, n))), []
    for low in range(0, replicates, block):
        high = min(replicates, low + block)
        sent = spark.sparkContext.broadcast(_matrix(weights, numbers, cluster, low, high, n))
        sums = dealt.mapInArrow(_slice_sums(sent), "slice int, pairs array<double>, pos array<double>, neg array<double>")
        parts.append(written(sums.withColumn("low", F.lit(low)), "sums"))
        sent.unpersist()
    sums = parts[0]
    for part in parts[1:]:
        sums = sums.unionByName(part)
    one = sums.select("slice", "low", F.posexplode(F.arrays_zip("pairs", "pos", "neg")).alias("at", "x"))
    return _auc_of_slices(one.select("slice", (F.col("low") + F.col("at")).cast("long").alias("rep"), "x.*"))  # slices x replicates rows


def _auc_of_slices(one: DataFrame) -> DataFrame:
    """(rep, auc) from pairs, positives and negatives by (slice, rep); a higher slice holds higher scores."""
    above = F.coalesce(F.sum("pos").over(W.partitionBy("rep").orderBy(F.desc("slice")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    joined = one.withColumn("pairs", F.col("pairs") + F.col("neg") * above)
    return joined.groupBy("rep").agg(F.try_divide(F.sum("pairs"), F.sum("pos") * F.sum("neg")).alias("auc"))


def _score_sums(counts: DataFrame, weights: DataFrame, cluster: str, values: np.ndarray, replicates: int) -> DataFrame:
    """(slice, rep, pairs, pos, neg) with a slice for each of the few ``values``, in rising order."""
    own = counts.groupBy(cluster).agg(F.collect_list(F.struct("score", "n", "k")).alias("rows"))
    met = own.join(weight_vectors(weights, cluster), cluster).select("rows", "weights")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(values), replicates))
        step = max(1, AT_ONCE // max(1, replicates, len(values)))
        for whole in batches:
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                rows, drawn = batch.column("rows"), batch.column("weights")
                of, by = (np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(x.offsets))) for x in (rows, drawn))
                row, one = rows.flatten(), drawn.flatten()
                rep = one.field("rep").to_numpy()
                ok = rep < replicates
                w = np.zeros((batch.num_rows, replicates))
                w[by[ok], rep[ok]] = one.field("w").to_numpy()[ok]
                at, k = np.searchsorted(values, row.field("score").to_numpy()), row.field("k").to_numpy()
                for side, number in enumerate((k, row.field("n").to_numpy() - k)):
                    table = np.zeros((len(values), batch.num_rows))
                    table[at, of] = number
                    total[side] += table @ w
        for at in np.flatnonzero(total.any((0, 2))):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array([x[at].tolist()], pa.list_(pa.float64())) for x in total)], ["slice", "pos", "neg"])

    sums = met.mapInArrow(run, "slice int, pos array<double>, neg array<double>").select("slice", F.posexplode(F.arrays_zip("pos", "neg")).alias("rep", "x"))
    sums = sums.groupBy("slice", F.col("rep").cast("long").alias("rep")).agg(F.sum("x.pos").alias("pos"), F.sum("x.neg").alias("neg"))
    return sums.withColumn("pairs", F.col("pos") * F.col("neg") / 2)


def _numbered(clusters: DataFrame) -> DataFrame:
    """Clusters with ``_i``: 0, 1, ... in no order that matters."""
    rows = written(clusters.withColumn("_id", F.monotonically_increasing_id()), "ids")
    sizes = rows.groupBy(F.shiftright("_id", 33).alias("_p")).agg(F.count("*").alias("_n"))  # a row for each task
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    met = rows.join(F.broadcast(before), F.shiftright("_id", 33) == F.col("_p"))
    return met.select(*clusters.columns, (F.col("_b") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("_i"))


class Blocks:
    """Rows of a model by cluster, written once with the clusters' weight vectors: each round of a fit reads them without a
    shuffle. A cluster of more than ``CHUNK`` rows is several blocks."""

    def __init__(self, df: DataFrame, weights: DataFrame, xs: Sequence[str], label: str, cluster: str):
        self.spark, self.p, self.cluster = df.sparkSession, len(xs) + 1, cluster
        rows = df.na.drop(subset=[label, cluster, *xs]).select(cluster, F.array(F.col(label).cast("double"), F.lit(1.0), *(F.col(c).cast("double") for c in xs)).alias("_row"))
        sizes = written(rows.groupBy(cluster).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")), "sizes")
        dealt = rows.join(sizes, cluster).withColumn("_chunk", F.expr("cast(rand(5) * parts as int)"))
        blocks = dealt.groupBy(cluster, "parts", "_chunk").agg(F.flatten(F.collect_list("_row")).alias("values"))
        self.path = new_path(self.spark, "blocks")
        blocks.join(weight_vectors(weights, cluster), cluster).select(F.col(cluster).alias("cluster"), "parts", "values", "weights").write.parquet(self.path)
        self.table = self.spark.read.parquet(self.path)
        self.cut = self.table.where("parts > 1").limit(1).count() > 0
        self.pairs = [(j, k) for j in range(self.p) for k in range(j, self.p)]

    def remove(self) -> None:
        dropped(self.spark, self.path)

    def round(self, reps: list[int], beta: np.ndarray, alpha: np.ndarray) -> list:
        """For each of ``reps`` the sums that its next step needs: ``rep`` and ``v``: pair sum of residuals, pairs, squared residuals,
        rows, score and information."""
        p, pairs = self.p, self.pairs
        key = dict(self.table.dtypes)["cluster"]
        schema = f"whole boolean, rep long, cluster {key}, w long, v array<double>"
        out = self.table.mapInArrow(_round_sums(p, pairs, np.array(reps), beta, alpha), schema)
        if not self.cut:
            return _added(out, 4 + p + len(pairs)).collect()
        out = written(out, "round")  # sums of whole clusters by replicate, and of cut ones by replicate and cluster
        a = F.element_at(F.array(*(F.lit(float(x)) for x in alpha)), F.array_position(F.array(*(F.lit(int(x)) for x in reps)), F.col("rep")).cast("int"))
        many = out.where("not whole").groupBy("rep", "cluster", "w").agg(*(F.sum(F.col("v")[k]).alias(f"s{k}") for k in range(3 + 2 * p + len(pairs)))).withColumn("_a", a)
        m, r, rr, w = F.col("s0"), F.col("s1"), F.col("s2"), F.col("w")
        x = [F.col(f"s{3 + j}") for j in range(p)]
        xr = [F.col(f"s{3 + p + j}") for j in range(p)]
        xx = [F.col(f"s{3 + 2 * p + k}") for k in range(len(pairs))]
        c = F.col("_a") / (1 + (m - 1) * F.col("_a"))
        score = [(xr[j] - c * x[j] * r) / (1 - F.col("_a")) for j in range(p)]
        info = [(xx[q] - c * x[j] * x[k]) / (1 - F.col("_a")) for q, (j, k) in enumerate(pairs)]
        v = F.array(*(w * y for y in (r * r - rr, m * (m - 1), rr, m, *score, *info)))
        return _added(out.where("whole").select("rep", "v").unionByName(many.select("rep", v.alias("v"))), 4 + p + len(pairs)).collect()


def _added(df: DataFrame, size: int) -> DataFrame:
    return df.groupBy("rep").agg(F.array(*(F.sum(F.col("v")[k]) for k in range(size))).alias("v"))


def _round_sums(p: int, pairs: list[tuple[int, int]], reps: np.ndarray, beta: np.ndarray, alpha: np.ndarray):
    """Sums of the blocks of a task, for all replicates at once. Of whole clusters, only residuals and scaled covariates are added up
    by cluster; what is linear in a cluster's sums is added over rows times weights, as matrix products."""
    place = np.full(int(reps.max(initial=0)) + 1, -1)
    place[reps] = np.arange(len(reps))

    def sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(blocks, 3 + 2p + pairs, replicates): rows, residuals and their squares, covariates, products."""
        y, x = rows[:, :1], rows[:, 1:]
        mu = 1 / (1 + np.exp(-np.clip(x @ beta.T, -700, 700)))
        s = np.sqrt(mu * (1 - mu))
        r = (y - mu) / s
        raw = y - mu
        cols = [np.ones_like(s), r, r * r, *(x[:, j : j + 1] * s for j in range(p)), *(x[:, j : j + 1] * raw for j in range(p)), *(x[:, j : j + 1] * x[:, k : k + 1] * s * s for j, k in pairs)]
        return np.stack([np.add.reduceat(c, first, axis=0) for c in cols], 1)

    left, right = np.array(pairs).T

    def weighted(rows: np.ndarray, first: np.ndarray, w: np.ndarray) -> tuple:
        """By block and replicate: residuals and scaled covariates. By replicate: squares, score and information, each row times its weight."""
        y, x = rows[:, :1], rows[:, 1:]
        mu = x @ beta.T
        np.clip(mu, -700, 700, out=mu)
        np.exp(np.negative(mu, out=mu), out=mu)
        np.reciprocal(np.add(mu, 1, out=mu), out=mu)
        raw, v = y - mu, mu * (1 - mu)
        s = np.sqrt(v)
        r = raw / s
        by_block = [np.add.reduceat(r, first, axis=0), np.add.reduceat(s, first, axis=0), *(np.add.reduceat(x[:, j : j + 1] * s, first, axis=0) for j in range(1, p))]
        w = np.repeat(w, np.diff(first, append=len(rows)), axis=0)
        return np.stack(by_block), np.einsum("ij,ij,ij->j", w, r, r), x.T @ (w * raw), (x[:, left] * x[:, right]).T @ (w * v)

    def of_whole(rows: np.ndarray, first: np.ndarray, w: np.ndarray, most: int) -> np.ndarray:
        m = np.diff(first, append=len(rows)).astype(float)
        if len(first) > 1 or len(rows) <= most:
            by_block, squares, score, info = weighted(rows, first, w)
        else:  # a single block of very many rows is added up in pieces
            got = [weighted(rows[k : k + most], np.zeros(1, np.int64), w) for k in range(0, len(rows), most)]
            by_block, squares, score, info = (sum(x) for x in zip(*got, strict=True))
        r, x = by_block[0], by_block[1:]
        wc = w * (alpha / (1 + (m[:, None] - 1) * alpha))
        score = [(score[j] - (wc * x[j] * r).sum(0)) / (1 - alpha) for j in range(p)]
        info = [(info[q] - (wc * x[j] * x[k]).sum(0)) / (1 - alpha) for q, (j, k) in enumerate(pairs)]
        return np.stack([(w * r * r).sum(0) - squares, (m * (m - 1)) @ w, squares, m @ w, *score, *info])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4 + p + len(pairs), len(reps)))
        for batch in batches:
            values, parts = batch.column("values"), batch.column("parts").to_numpy()
            flat, offsets = values.flatten().to_numpy(zero_copy_only=False), np.asarray(values.offsets) - values.offsets[0].as_py()
            size = np.diff(offsets) // (p + 1)
            lists = batch.column("weights")
            owner, drawn = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets))), lists.flatten()
            at, of = drawn.field("rep").to_numpy(), drawn.field("w").to_numpy()
            ok = (at < len(place)) & (place[np.minimum(at, len(place) - 1)] >= 0)
            weights = np.zeros((batch.num_rows, len(reps)))
            weights[owner[ok], place[at[ok]]] = of[ok]
            most = max(1, AT_ONCE // max(1, len(reps) * (3 + 2 * p + len(pairs))))
            whole, ends, a = parts == 1, np.cumsum(size), 0
            turns = np.append(np.flatnonzero(np.diff(whole)) + 1, batch.num_rows)
            while a < batch.num_rows:
                z = max(a + 1, int(np.searchsorted(ends, (ends[a] - size[a] + most), "right")))
                z = min(z, int(turns[np.searchsorted(turns, a, "right")]))  # either whole clusters or parts of cut ones
                rows = flat[offsets[a] : offsets[z]].reshape(-1, p + 1)
                first = np.concatenate([[0], np.cumsum(size[a:z])[:-1]])
                w = weights[a:z]
                if whole[a]:
                    total += of_whole(rows, first, w, most)
                    a = z
                    continue
                v = sums_in_pieces(rows, first, most)
                for b in range(z - a):
                    of_ = np.flatnonzero(w[b])
                    n = len(of_)
                    key = batch.column("cluster").slice(a + int(b), 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([False] * n), pa.array(reps[of_], pa.int64()), pa.concat_arrays([key] * n) if n else key.slice(0, 0), pa.array(w[b][of_].astype(np.int64)), pa.array(v[b][:, of_].T.tolist(), pa.list_(pa.float64()))],
                        ["whole", "rep", "cluster", "w", "v"],
                    )
                a = z
        kind = batch_kind[0]
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array([True] * len(reps)), pa.array(reps, pa.int64()), pa.nulls(len(reps), kind), pa.nulls(len(reps), pa.int64()), pa.array(total.T.tolist(), pa.list_(pa.float64()))], ["whole", "rep", "cluster", "w", "v"])

    batch_kind: list = [None]

    def sums_in_pieces(rows: np.ndarray, first: np.ndarray, most: int) -> np.ndarray:
        """As ``sums``; a single block of very many rows is added up in pieces."""
        if len(first) > 1 or len(rows) <= most:
            return sums(rows, first)
        return sum(sums(rows[k : k + most], np.zeros(1, np.int64)) for k in range(0, len(rows), most))

    def typed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch_kind[0] = batch.column("cluster").type
            yield batch

    return lambda batches: run(typed(batches))
