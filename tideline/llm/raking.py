"""Mixing sources to target weights: iterative proportional fitting, calibrated sampling.

Each document gets a topic: the nearest of ``TOPICS`` centres of hashed word counts, which
spherical k-means fits on all documents with words. The first centres are drawn as k-means++
draws them, by a hash of the text; centres that end with less than ``LEAST_SHARE`` of all words are given
up, and their documents go to the nearest of the others. Vectors stay in the shared folder; in each round only a sum
for each centre and dimension reaches the driver, in whole numbers, so that their order does
not matter. Tokens are counted
as words plus one. Cells are the combinations of source, language and topic that occur; all
documents are counted, before anything is shuffled. The cells' token weights are raked to the
three target marginals in turn until no value of a marginal is off its target by more than
``TOLERANCE`` of the whole.

Targets are shares by value (``{"source": {"web": 0.2, ...}}``); by default a marginal's
shares are its token counts to the power ``POWERS``. A value missing in given targets gets
weight 0. The marginals add up to ``keep`` of all tokens. No value is asked for more tokens
than it has (the others take over what it lacks), and no cell for more than it has. Three
marginals that can be met one by one may still contradict each other: then the targets are moved
towards the shares that the documents have, as little as it takes, which bisection finds to 1/``GRAIN``. Results
tell this step (1: the targets asked for; 0: the documents' own shares, which can always be met), the target
and the weight reached; where targets that were given had to be moved, there is a warning.

A document's probability is its cell's weight over the cell's tokens; it is kept where a hash
of doc_id and text lies below that: the same rows are kept on every run.

Up to ``LOCAL_CELLS`` cells are raked on the driver, as one would solve a small linear
program; more of them by the same steps as aggregates and joins.

Results: one row per row (``mix_report``), or the rows kept. Null source, language or text
(topic -1, as for a text without words) are values of their own; an empty text counts one token
and texts of any length are read whole; doc_id may be null or repeated, and equal rows fare
alike. Ties in distance go to the first centre. An empty table gives an empty result. Columns not
named pass through, whatever their names.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .store import carried, name_of, removed, restored, small, stored
from .workers import lean

TOPICS, DIMENSIONS = 8, 256
ROUNDS, TOLERANCE, GRAIN = 500, 0.001, 64
STALL = 25  # rounds in which the misfit has to fall by a hundredth, else the targets clash
LEAST_SHARE = 0.01
NAMES = ("source", "lang", "topic")
TOPIC_ROUNDS = 15
AT_ONCE = 2048  # vectors
UNIT = float(1 << 32)  # of the sums of vectors
KEEP = 0.75
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.7}
BROADCAST_CELLS = 100_000
LOCAL_CELLS = 200_000


def _chunk_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, DIMENSIONS) hashed word counts, and word counts."""
    w, first = textops.words(data, offsets)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    return np.bincount(doc * DIMENSIONS + (w >> np.uint64(56)).astype(np.int64), minlength=len(n) * DIMENSIONS).reshape(-1, DIMENSIONS), n


def _unit(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts at length 1."""
    x = np.sqrt(counts)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _chunk_vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, DIMENSIONS) square roots of hashed word counts at length 1, and word counts."""
    counts, n = _chunk_counts(data, offsets)
    return _unit(counts), n


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of each text with words, as bytes of int32."""
    for batch in batches:
        for at, *c in textops.chunks(batch.column(1)):
            counts, n = _chunk_counts(*c)
            has = np.flatnonzero(n)
            x = [r.tobytes() for r in counts[has].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)).take(pa.array(has)), pa.array(x, pa.binary())], ["h", "x"])


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most ``AT_ONCE`` rows at a time: a vector of doubles takes much more than its stored counts."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32).reshape(-1, DIMENSIONS))


def _next_centre(rows: DataFrame, centres: np.ndarray) -> np.ndarray | None:
    """A text's vector, drawn with chances in proportion to its distance from the centres."""

    def run(batches):
        best = None
        for batch in _pieces(batches):
            far = 1 - (_vectors(batch) @ centres.T).max(1) if len(centres) else np.ones(batch.num_rows)
            u = textops.mix(batch.column(0).to_numpy().view(np.uint64) + np.uint64(len(centres))) >> np.uint64(11)
            key = np.where(far > 1e-9, np.log((u + 0.5) / float(1 << 53)) / np.maximum(far, 1e-9), -np.inf)
            k = int(key.argmax())
            if key[k] > -np.inf and (best is None or key[k] > best[0]):
                best = key[k], batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([float(best[0])]), pa.array([best[1]]), pa.array([best[2]], pa.binary())], ["key", "h", "x"])

    top = rows.mapInArrow(lean(run), "key double, h long, x binary").orderBy(F.desc("key"), "h", "x").limit(1).collect()
    return _unit(np.frombuffer(bytes(top[0]["x"]), np.int32).reshape(1, -1)) if top else None


def _sums(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centre the sum of the vectors that it is nearest to, and how many words these have."""
    width = DIMENSIONS + 1

    def run(batches):
        sums = np.zeros((len(centres), width), np.int64)
        for batch in _pieces(batches):
            x = _vectors(batch)
            nearest = (x @ centres.T).argmax(1)
            words = np.abs(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32).reshape(-1, DIMENSIONS).astype(np.int64)).sum(1)
            x = np.rint(x * UNIT).astype(np.int64)
            for k in np.unique(nearest):
                sums[k, :-1] += x[nearest == k].sum(0)
                sums[k, -1] += words[nearest == k].sum()
        cell = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sums.ravel()[cell])], ["cell", "s"])

    out = np.zeros(len(centres) * width)
    for cell, s in rows.mapInArrow(lean(run), "cell long, s long").groupBy("cell").agg(F.sum("s")).collect():  # centres x (DIMENSIONS + 1)
        out[cell] = s
    out = out.reshape(-1, width)
    return out[:, :-1], out[:, -1]


def fit_topics(docs: DataFrame, topics: int = TOPICS, least_share: float = LEAST_SHARE) -> np.ndarray:
    """Centres (``topics`` at most, DIMENSIONS) from all texts with words, each nearest to ``least_share`` of the
    words or more; none without such texts."""
    rows = stored(docs.where("text is not null").select(F.xxhash64("text").alias("h"), "text").mapInArrow(lean(_counted), "h long, x binary"), "vectors")
    centres = np.zeros((0, DIMENSIONS))
    while len(centres) < topics and (one := _next_centre(rows, centres)) is not None:
        centres = np.concatenate([centres, one])
    while len(centres):
        for _ in range(TOPIC_ROUNDS):
            sums, n = _sums(rows, centres)
            moved = np.where(n[:, None] > 0, sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12), centres)
            if np.abs(moved - centres).max() < 1e-9:
                break
            centres = moved
        few = n < least_share * n.sum()
        if not few.any():
            break
        centres = centres[~few]
    removed(rows)
    return centres


def _profiler(centres, text: str, drop: bool):
    """Batches with topic and tokens; everything else goes through as it came."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            topics, tokens = [], []
            for _, data, offsets in textops.chunks(batch.column(at)):
                x, n = _chunk_vectors(data, offsets)
                topic = (x @ centres.value.T).argmax(1) if len(centres.value) else np.zeros(len(x), int)
                topics.append(np.where(n > 0, topic, -1).astype(np.int32))
                tokens.append(n + 1)
            kept = [(f.name, c) for f, c in zip(batch.schema, batch.columns, strict=True) if not (drop and f.name == text)]
            none = np.zeros(0, np.int32)
            new = [("_topic", pa.array(np.concatenate(topics or [none]))), ("_tokens", pa.array(np.concatenate(tokens or [none]).astype(np.int64)))]
            names, columns = zip(*kept, *new, strict=True)
            yield pa.RecordBatch.from_arrays(list(columns), names=list(names))

    return run


def profiled(rows: DataFrame, centres: np.ndarray, text: str = "_text", drop: bool = True) -> DataFrame:
    """``rows`` with ``_topic`` (-1 without words) and ``_tokens`` of the column ``text``, which
    is then dropped if ``drop``."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    fields = [f for f in rows.schema.fields if not (drop and f.name == text)]
    schema = T.StructType([*fields, T.StructField("_topic", T.IntegerType()), T.StructField("_tokens", T.LongType())])
    return rows.mapInArrow(lean(_profiler(shared, text, drop)), schema)


def _share(name: str, targets: dict | None) -> Column:
    """The share asked for, not scaled, of each value of a marginal with its tokens."""
    given = (targets or {}).get(name)
    if given is None:
        return F.pow(F.col("tokens").cast("double"), F.lit(POWERS[name]))
    out = F.lit(0.0)
    for value, share in given.items():
        out = F.when(F.col("value").eqNullSafe(F.lit(value)), F.lit(float(share))).otherwise(out)
    return out


def _wanted(tokens: np.ndarray, share: np.ndarray, whole: float) -> np.ndarray:
    """Targets in proportion to ``share`` that sum to ``whole`` (or to all that there is), none
    above ``tokens``: values that can't supply their part give all, the others take over."""
    out, open_ = np.zeros(len(tokens)), share > 0
    left = min(whole, float(tokens[open_].sum()))
    while open_.any():
        out[open_] = share[open_] * left / share[open_].sum()
        over = open_ & (out >= tokens)
        if not over.any():
            break
        out[over] = tokens[over]
        left -= float(tokens[over].sum())
        open_ &= ~over
    return out


class _Local:
    """Cells as arrays."""

    def __init__(self, cells: DataFrame) -> None:
        self.cells = cells.select(*NAMES, "tokens").toPandas()  # LOCAL_CELLS at most
        self.tokens = self.cells["tokens"].to_numpy(float)
        self.codes, self.values = {}, {}
        for n in NAMES:
            values = self.cells[n].astype(object).where(self.cells[n].notna(), None)
            order = {v: k for k, v in enumerate(dict.fromkeys(values))}
            self.codes[n], self.values[n] = values.map(lambda v, o=order: o[v]).to_numpy(int), list(order)

    def start(self) -> None:
        self.w = self.tokens.copy()

    def sums(self, n: str) -> np.ndarray:
        return np.bincount(self.codes[n], self.w, len(self.values[n]))

    def scale(self, n: str, want: np.ndarray) -> None:
        have = self.sums(n)
        self.w = np.minimum(self.w * (want / np.where(have > 0, have, 1.0))[self.codes[n]], self.tokens)

    def fitted(self, wants: dict[str, np.ndarray]) -> bool:
        """Rake to these targets; whether they are met."""
        self.start()
        whole = max(float(next(iter(wants.values())).sum()), 1e-9)
        before = np.inf
        for k in range(ROUNDS):
            for n in NAMES:
                self.scale(n, wants[n])
            off = max(np.abs(self.sums(n) - wants[n]).max(initial=0) for n in NAMES)
            if off <= TOLERANCE * whole:
                return True
            if k % STALL == STALL - 1:
                if off > 0.99 * before:
                    return False
                before = off
        return False


class _Spread(_Local):
    """Cells as a stored table, for more of them than the driver should hold."""

    def __init__(self, cells: DataFrame) -> None:
        self.cells = cells
        self.values = {n: [r[0] for r in cells.select(n).distinct().collect()] for n in NAMES}  # values of a marginal, not cells

    def start(self) -> None:
        self.w = stored(self.cells.withColumn("w", F.col("tokens").cast("double")), "weights")

    def sums(self, n: str) -> np.ndarray:
        got = {r[0]: r[1] for r in self.w.groupBy(n).agg(F.sum("w")).collect()}  # as many as the marginal has values
        return np.array([got.get(v, 0.0) for v in self.values[n]])

    def scale(self, n: str, want: np.ndarray) -> None:
        have = self.sums(n)
        kind = self.cells.schema[n].dataType.simpleString()
        factors = self.cells.sparkSession.createDataFrame([(v, float(f)) for v, f in zip(self.values[n], want / np.where(have > 0, have, 1.0), strict=True)], f"_v {kind}, _f double")
        old = self.w
        self.w = stored(old.join(small(factors), F.col(n).eqNullSafe(F.col("_v"))).select(*NAMES, "tokens", F.least(F.col("w") * F.col("_f"), F.col("tokens").cast("double")).alias("w")), "weights")
        removed(old)


def rake(cells: DataFrame, targets: dict | None = None, keep: float = KEEP, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight`` (tokens wanted), ``probability``
    (weight over tokens), and for each marginal the target and the weight reached of the cell's
    value. Shares of a marginal need not sum to 1."""
    spark = cells.sparkSession
    table = _Local(cells) if cells.count() <= local_cells else _Spread(cells)
    table.start()
    tokens = {n: table.sums(n) for n in NAMES}
    asked = {}
    for n in NAMES:
        rows = spark.createDataFrame([(k, v, float(t)) for k, (v, t) in enumerate(zip(table.values[n], tokens[n], strict=True))], f"k long, value {cells.schema[n].dataType.simpleString()}, tokens double")
        share = {r[0]: r[1] for r in rows.select("k", _share(n, targets)).collect()}
        asked[n] = _wanted(tokens[n], np.array([share[k] for k in range(len(share))]), keep * float(tokens[n].sum()))
    for n in NAMES:  # cells of values that nobody wants take no part
        table.scale(n, np.where(asked[n] > 0, table.sums(n), 0.0))
    own = {n: table.sums(n) for n in NAMES}
    whole = min(float(x.sum()) for x in (*asked.values(), own["source"]))
    asked, own = ({n: x * (whole / x.sum() if x.sum() else 0.0) for n, x in y.items()} for y in (asked, own))

    def at(step: float) -> dict[str, np.ndarray]:
        return {n: step * asked[n] + (1 - step) * own[n] for n in NAMES}

    step = low = 0
    if table.fitted(at(1.0)):
        step = GRAIN
    else:  # the largest part of GRAIN that is met; 0 always is
        high = GRAIN
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if table.fitted(at(mid / GRAIN)) else (low, mid)
        step = low
        table.fitted(at(step / GRAIN))
        if targets:
            warnings.warn(f"the targets contradict each other or the documents; they were moved to {step / GRAIN:.3f} of the way from the documents' shares", stacklevel=2)
    wants = at(step / GRAIN)
    reached = {n: table.sums(n) for n in NAMES}
    fields = ", ".join(f"{n} {cells.schema[n].dataType.simpleString()}" for n in NAMES)
    if isinstance(table, _Spread):
        out = table.w.withColumnRenamed("w", "weight")
        for n in NAMES:
            told = spark.createDataFrame([(v, float(a), float(b)) for v, a, b in zip(table.values[n], wants[n], reached[n], strict=True)], f"_v {cells.schema[n].dataType.simpleString()}, {n}_target double, {n}_reached double")
            out = out.join(small(told), F.col(n).eqNullSafe(F.col("_v"))).drop("_v")
    else:
        names = [[table.values[n][k] for k in table.codes[n]] for n in NAMES]
        told = [x[table.codes[n]].tolist() for n in NAMES for x in (wants[n], reached[n])]
        rows = list(zip(*names, table.cells["tokens"].tolist(), table.w.tolist(), *told, strict=True))
        rows = [tuple(int(v) if isinstance(v, np.integer) else v for v in r) for r in rows]
        out = spark.createDataFrame(rows, f"{fields}, tokens long, weight double, " + ", ".join(f"{n}_target double, {n}_reached double" for n in NAMES))
    return stored(out.withColumns({"probability": F.col("weight") / F.col("tokens"), "step": F.lit(step / GRAIN)}), "raked")


def _joined(rows: DataFrame, cells: DataFrame, targets: dict | None, keep: float) -> DataFrame:
    """``rows`` (with _source, _lang, _topic, _tokens, _chance) with weight, probability, kept,
    and targets and what was reached."""
    raked = rake(cells, targets, keep)
    known = small(raked.drop("tokens").withColumnsRenamed({"source": "_s", "lang": "_l", "topic": "_t"}), BROADCAST_CELLS)
    met = rows.join(known, F.col("_source").eqNullSafe(F.col("_s")) & F.col("_lang").eqNullSafe(F.col("_l")) & (F.col("_topic") == F.col("_t")))
    return met.withColumn("kept", F.col("_chance") < F.col("probability"))


def _rows(docs: DataFrame, columns: list[Column], centres: np.ndarray, seed: int) -> DataFrame:
    """``columns``, the cell's values, tokens and chance of each row; the text only among ``columns``."""
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))
    own = [F.col("source").alias("_source"), F.col("lang").alias("_lang"), chance.alias("_chance")]
    if columns:
        return profiled(docs.select(*columns, *own), centres, name_of(docs, "text"), False)
    return profiled(docs.select(*own, F.col("doc_id").alias("_doc_id"), F.col("text").alias("_text")), centres)


def _cells(rows: DataFrame) -> DataFrame:
    keys = (F.col(f"_{c}").alias(c) for c in NAMES)
    return stored(rows.groupBy(*keys).agg(F.sum("_tokens").alias("tokens")), "tokens")


def mix_report(docs: DataFrame, targets: dict | None = None, keep: float = KEEP, seed: int = 17) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight (the cell's), probability and kept for
    each document, for its source, language and topic the target and the weight reached, and the step."""
    rows = stored(_rows(docs, [], fit_topics(docs), seed), "profiles")
    met = _joined(rows, _cells(rows), targets, keep)
    told = [f"{n}_{x}" for n in NAMES for x in ("target", "reached")]
    return met.select(*(F.col(f"_{c}").alias(c) for c in ("doc_id", *NAMES, "tokens")), "weight", "probability", "kept", *told, "step")


def sampled(docs: DataFrame, targets: dict | None = None, keep: float = KEEP, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that the calibrated sample keeps, columns unchanged."""
    centres = fit_topics(docs)
    cells = _cells(_rows(docs, [], centres, seed))
    return restored(_joined(_rows(docs, carried(docs), centres, seed), cells, targets, keep).where("kept"), docs)
