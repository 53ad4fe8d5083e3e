"""Hard negatives: Fagin's threshold algorithm over per-dimension sorted lists.

Components become integers, floor(256 x). Rows are cut into segments of ``SEGMENT`` rows, which are
written once with, for each dimension, the list of their rows in order of that component. An anchor reads
these lists in step, from the top where its own component is positive, from the bottom where it is
negative, not at all where it is 0 (sorted access); each row met is scored by its whole integer
inner product (random access). The sum of the anchor's components times the values that the lists
have come to is the threshold: no unmet row scores more. A segment is left once the threshold
is strictly below the k-th score of each of the anchor's windows (its lower end, as long as it has
fewer than k rows), or all its rows are met; strictly, so that ties are seen. What earlier segments of a
task have given counts for the k-th score.

First each anchor's positives are found (one window: rows of its label), then for each positive the
rows of other labels whose scores lie between ``low`` and ``high`` hundredths of the positive's. Anchors
go in waves of at most ``WAVE_BYTES`` of vectors and ``WAVE`` anchors, which all tasks get; a task returns the
best k of each window, and tasks' results are ranked by anchor in Spark. No pair of rows becomes a row.

Results: a row for each anchor, positive and negative found: anchor_id, positive_id, rank,
negative_id, positive_score, negative_score. Rows take no part whose vec_id, label or vector is null, or
whose vector holds a null or non-finite component. Missing components of a shorter vector count
as 0, and an empty vector scores 0. Ties in score go by smaller vec_id, then (rows of one vec_id) by
place in the table; a row is never its own positive, a repeated row may be. A positive of negative score has no
window; one of score 0 takes negatives of score 0. Arithmetic is exact at any size of the components;
components beyond 2^62 and scores beyond 64 bits count as the largest of these. Vectors of any length are read whole. An
empty table gives an empty result. Columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import removed, stored

SCALE = 256
SEGMENT = 8192  # rows of a segment
SEGMENT_BYTES = 32 << 20  # of a segment's components, as integers of 64 bits
WAVE, WAVE_BYTES = 16_384, 32 << 20  # anchors at once
STEPS = 64, 4  # the first step reads 1/64 of the lists, each step goes 4 times as deep
LIMIT = 1 << 62
SEGMENTS = "n int, dims int, kind string, ids binary, places binary, labels binary, rows binary, lists binary"
FOUND = "anchor long, positive int, score long, vec_id long, place long"


def _integers(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """floor(256 x) of some vectors, shorter ones filled with 0; which vectors are finite and whole."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    n, size = len(vectors), np.diff(np.asarray(vectors.offsets))
    flat = vectors.flatten()
    x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
    out = np.zeros((n, int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = x
    fine = np.isfinite(out).all(1)
    with np.errstate(over="ignore"):
        out = np.floor(SCALE * np.where(fine[:, None], out, 0.0))
    return np.clip(out, -LIMIT, LIMIT).astype(np.int64), fine


def _segment(ids: np.ndarray, places: np.ndarray, labels: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
    """One segment: its rows and, for each dimension, their order by component."""
    reach = int(np.abs(q).max(initial=0))
    kind = next(k for k in ("<i2", "<i4", "<i8") if reach <= np.iinfo(k).max)
    lists = np.argsort(q, axis=0, kind="stable").T.astype("<u2")
    data = [x.tobytes() for x in (ids.astype("<i8"), places.astype("<i8"), labels.astype("<i8"), q.astype(kind), lists)]
    return pa.RecordBatch.from_arrays([pa.array([q.shape[0]], pa.int32()), pa.array([q.shape[1]], pa.int32()), pa.array([kind]), *(pa.array([x], pa.binary()) for x in data)], [c.split()[0] for c in SEGMENTS.split(", ")])


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of what a task reads; a batch of very long vectors is cut smaller."""
    held: list[tuple] = []
    rows = width = 0

    def given() -> pa.RecordBatch:
        q = np.zeros((rows, width), np.int64)
        at = 0
        for part in held:
            q[at : at + len(part[3]), : part[3].shape[1]] = part[3]
            at += len(part[3])
        return _segment(*(np.concatenate([part[k] for part in held]) for k in range(3)), q)

    for batch in batches:
        longest = max(1, int(np.diff(np.asarray(batch.column("embedding").cast(pa.large_list(pa.float64())).offsets)).max(initial=0)))
        step = max(1, min(SEGMENT, SEGMENT_BYTES // (8 * longest)))
        for at in range(0, batch.num_rows, step):
            own = batch.slice(at, step)
            q, fine = _integers(own.column("embedding"))
            if held and (rows + len(q) > SEGMENT or (rows + len(q)) * 8 * max(width, q.shape[1]) > SEGMENT_BYTES):
                yield given()
                held, rows, width = [], 0, 0
            held.append((*(own.column(c).to_numpy()[fine] for c in ("vec_id", "place", "label")), q[fine]))
            rows, width = rows + int(fine.sum()), max(width, q.shape[1])
    if rows:
        yield given()


class Segment:
    """A written segment, opened."""

    def __init__(self, row: dict):
        n, dims = row["n"], row["dims"]
        self.ids, self.places, self.labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "places", "labels"))
        self.rows = np.frombuffer(row["rows"], row["kind"]).reshape(n, dims).astype(np.int64)
        up = np.frombuffer(row["lists"], "<u2").reshape(dims, n)
        self.lists = {1: up[:, ::-1], -1: up}  # from the top, from the bottom
        self.norm = float(np.sqrt((self.rows.astype(float) ** 2).sum(1)).max(initial=0))
        self.exact = None  # the rows in the number type of the last product

    def product(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and anchor in a type in which their products are exact: partial sums are bounded by the norms."""
        bound = self.norm * float(np.sqrt((a.astype(float) ** 2).sum())) * 1.001
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
        if self.exact is None or self.exact.dtype != kind:
            self.exact = self.rows.astype(kind)
        return self.exact, a.astype(kind)


class Windows:
    """The best ``k`` rows of one anchor in each of its windows so far, best first."""

    def __init__(self, k: int, low: list[int], high: list[int]):
        self.k, self.low, self.high = k, low, high
        self.best: list[list[tuple]] = [[] for _ in low]  # (-score, vec_id, place)

    def floor(self) -> float:
        """Below this, no further row matters."""
        open_ = ((b, low) for b, low, high in zip(self.best, self.low, self.high, strict=True) if low <= high)
        return min((-b[-1][0] if len(b) == self.k else low for b, low in open_), default=np.inf)

    def add(self, score: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        for w, (low, high) in enumerate(zip(self.low, self.high, strict=True)):
            b = self.best[w]
            least = max(low, -b[-1][0]) if len(b) == self.k else low
            at = np.flatnonzero((score >= least) & (score <= high))
            if len(at) > self.k:  # all that tie with the k-th
                kth = np.partition(score[at], len(at) - self.k)[len(at) - self.k]
                at = at[score[at] >= kth]
            if len(at):
                self.best[w] = sorted([*b, *((-int(s), int(i), int(p)) for s, i, p in zip(score[at], ids[at], places[at], strict=True))])[: self.k]


def walk(segment: Segment, a: np.ndarray, fits: np.ndarray, windows: Windows) -> int:
    """Read the lists of ``segment`` for the anchor ``a`` until no unmet row matters; rows where ``fits``
    is false are met but not taken. Returns how many rows were scored."""
    n, dims = segment.rows.shape
    a = np.concatenate([a, np.zeros(max(0, dims - len(a)), np.int64)])[:dims]
    rows, exact = segment.product(a)
    signs = [(s, np.flatnonzero(np.sign(a) == s)) for s in (1, -1)]
    met = np.zeros(n, bool)
    scored, depth, step = 0, 0, max(1, n // STEPS[0])
    if not any(len(d) for _, d in signs):
        met[:] = True  # every row scores 0
        windows.add(np.zeros(n, np.int64)[fits], segment.ids[fits], segment.places[fits])
        return n
    while True:
        upto = min(n, depth + step)
        now = np.zeros(n, bool)
        for s, of in signs:
            now[segment.lists[s][of, depth:upto].ravel()] = True
        now &= ~met
        met |= now
        taken = now & fits
        at = np.flatnonzero(taken)
        if len(at):
            score = (rows @ exact)[at] if 2 * len(at) > n else rows[at] @ exact
            windows.add(score, segment.ids[at], segment.places[at])
        scored += int(now.sum())
        if upto == n or met.all():
            return scored
        kind = np.int64 if exact.dtype == np.float32 else object  # the values come from many rows, the bound of products does not hold
        threshold = sum(int(np.dot(a[of].astype(kind), segment.rows[segment.lists[s][of, upto - 1], of].astype(kind))) for s, of in signs)
        if threshold < windows.floor():
            return scored
        depth, step = upto, step * STEPS[1]


def _searched(wave, same: bool, k: int):
    """The best rows of each window of a wave's anchors in a task's segments."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = wave.value
        states = [Windows(k, low, high) for low, high in zip(anchors["low"], anchors["high"], strict=True)]
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row)
                for a, place, label, state in zip(anchors["q"], anchors["place"], anchors["label"], states, strict=True):
                    if state.low:
                        fits = (segment.labels == label) & (segment.places != place) if same else segment.labels != label
                        walk(segment, a, fits, state)
        rows = [(place, w, max(min(-s, (1 << 63) - 1), -(1 << 63)), i, p) for place, state in zip(anchors["place"], states, strict=True) for w, b in enumerate(state.best) for s, i, p in b]
        if rows:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in FOUND.split(", ")])

    return run


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` of all tasks' rows, with their rank."""
    order = W.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "place")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _windows(positives: list[int], low: int, high: int) -> tuple[list[int], list[int]]:
    """For each positive's score the least and the greatest score of its negatives, in integers."""
    return [-((-low * p) // 100) for p in positives], [(high * p) // 100 for p in positives]


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives of the rows of ``vectors`` (vec_id, embedding, label) for which the condition ``anchors`` holds."""
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    own = own.where("vec_id is not null and label is not null and embedding is not null").withColumn("place", F.monotonically_increasing_id())
    table = stored(own, "vectors")
    segments = stored(table.mapInArrow(_cut, SEGMENTS), "segments")
    chosen = stored(table.where(F.coalesce(anchors, F.lit(False))), "anchors")
    count, widest = chosen.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    waves = max(1, -(-count // max(1, min(WAVE, WAVE_BYTES // (8 * max(1, widest))))))
    parts = []
    for k in range(waves):
        wave = chosen.where(F.pmod(F.xxhash64("place"), F.lit(waves)) == k).toArrow().combine_chunks()
        q, fine = _integers(wave["embedding"].combine_chunks() if wave.num_rows else pa.array([], pa.list_(pa.float64())))
        ids, places, labels = (wave[c].to_numpy()[fine] for c in ("vec_id", "place", "label"))
        if not len(ids):
            continue
        every = {"q": q[fine], "place": places.tolist(), "label": labels.tolist()}
        sent = spark.sparkContext.broadcast(every | {"low": [[-LIMIT * LIMIT]] * len(ids), "high": [[LIMIT * LIMIT]] * len(ids)})
        near = stored(_best(segments.mapInArrow(_searched(sent, True, positives), FOUND), ["anchor"], positives), "positives")
        sent.unpersist()
        of: dict[int, list[int]] = {p: [] for p in places.tolist()}
        for r in near.select("anchor", "score").orderBy("anchor", "rank").toLocalIterator():
            of[r["anchor"]].append(r["score"])
        lows, highs = zip(*(_windows(of[p], low, high) for p in every["place"]), strict=True)
        sent = spark.sparkContext.broadcast(every | {"low": list(lows), "high": list(highs)})
        far = _best(segments.mapInArrow(_searched(sent, False, negatives), FOUND), ["anchor", "positive"], negatives)
        names = near.select("anchor", (F.col("rank") - 1).alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        parts.append(stored(far.join(names, ["anchor", "positive"]), "negatives"))
        sent.unpersist()
        removed(near)
    removed(segments)
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    named = found.join(chosen.select(F.col("place").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def shifted_labels(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, embedding and label, the label moved on by one where vec_id is divisible by ``every``."""
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    moved = F.when(vec_id % every == 0, F.try_mod(F.try_add(label, F.lit(1)), F.lit(labels))).otherwise(label)
    return vectors.select(vec_id.alias("vec_id"), "embedding", moved.alias("label"))
