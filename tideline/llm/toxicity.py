"""Toxicity: class-conditional Kneser-Ney models over words.

Bigrams of words (runs of letters, digits and other non-ASCII characters, lower case) are
counted exactly for both classes over all labelled rows of the training folds. A word's
probability in a class is its discounted bigram count, backing off to the class's continuation
counts (how many different words it follows), which back off to the continuation counts of both
classes together (a part spread evenly over their words): rare expressions are smoothed through
counts that the classes share. A word
that neither class has speaks for neither. A text's signals are log-likelihood ratios per
word: of the whole text, and the highest of any window of 1 and of 3 words (``WINDOWS``; single
words by their continuation counts, which copies of a text do not raise), so that a few words in
a very long text are not averaged away. A logistic curve turns the signals into a score; it is
fitted on rows of another fold than the counts.

All counts are kept, however many there are, and no place holds them all. Training texts are read
in blocks of about ``BLOCK_BYTES``; a block sends each of its different bigrams once, with its counts,
to the bigram's shard (a hash of both words; a frequent second word is spread over several shards).
A shard adds them up to its part of the model; what it knows of words goes to a table of words, which is sharded
too. Both parts lie in one bucketed table. Then all texts are dealt into blocks, which are written once, compressed. In rounds, each over some of the
blocks, a block asks each shard for its different bigrams (64 bits of a hash) and words (48 bits), and meets
the answers; the model is not shuffled again, and a round's shuffles are removed before the next, so that the largest
holds no more than its share of what is asked.

Results: one row per row. A text without words (null, empty) has the share of toxic rows
among the labelled ones as its score; without labelled rows every score is 0. A text of any length
is read whole. A document with contradictory labels counts as toxic; a score that ties with the
threshold is toxic. doc_id may be null (then it has no label) or repeated; equal texts get equal
scores. An empty table gives an empty result. Columns other than doc_id and text are not read,
and pass through ``without_toxic`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops
from .store import carried, name_of, removed, restored, shared_folder, small, stored, without_shuffle_files
from .workers import lean, lean_cogroup, lean_group

WINDOWS = (1, 3)
CALIBRATION_ROWS = 20_000
BLOCK_ROWS, BLOCK_BYTES = 10_000, 4 << 20  # of texts that are read at once; a longer text is a block of its own
SHARD_BYTES, TRAINING_BYTES = 24 << 20, 6 << 20  # of texts and of training texts, for each shard
LEAST_SHARDS, LANES = 8, 64  # shards at least; shards for each lane of a frequent word
ROUNDS, ROUND_BYTES = 16, 32 << 20  # rounds at most; of texts in a round at least
BUCKETS = (16, 100_000)  # of the model, at least and at most
DISCOUNT = 0.75
EVEN = 0.5  # of what is backed off to both classes: the part spread evenly over the words
SIGNALS = ["n", "whole", *(f"window{k}" for k in WINDOWS)]
COUNTS = ["c1", "c0", "c", "t1", "t0", "d1", "d0"]  # contexts (toxic, ordinary, either), tokens after, words after
ANSWER = "block long, shard long, data binary"
WORD = f"word long, {', '.join(f'{x} long' for x in COUNTS)}"


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


def _separators() -> np.ndarray:
    table = ~textops.letters()
    table[48:58] = False
    return table


def _read(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words of some texts (numbers of 48 bits, over 0), and each text's first."""
    parts, words, first, n = _separators(), [], [np.zeros(1, np.int64)], 0
    for _, data, offsets in textops.chunks(texts):
        w, at = textops.words(data, offsets, parts)
        words.append(np.maximum((w >> np.uint64(16)).view(np.int64), 1))
        first.append(at[1:] + n)
        n += len(w)
    return np.concatenate(words) if words else np.zeros(0, np.int64), np.concatenate(first)


def _before(w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before each word; 0 at a text's start."""
    v = np.concatenate([np.zeros(1, np.int64), w[:-1]])
    v[first[:-1][np.diff(first) > 0]] = 0
    return v


@dataclass
class Bigrams:
    """The different bigrams of a block by shard, w and v, and their hash; ``cuts``: where each shard begins;
    ``at``: for each word of the texts the bigram that it ends."""

    w: np.ndarray
    v: np.ndarray
    key: np.ndarray
    shard: np.ndarray
    cuts: np.ndarray
    at: np.ndarray

    def parts(self) -> Iterator[tuple[int, int]]:
        return zip(self.cuts, [*self.cuts[1:], len(self.w)], strict=True)


def _key(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    return textops.mix(textops.mix(v.view(np.uint64)) ^ w.view(np.uint64))


def _bigrams(w: np.ndarray, v: np.ndarray, shards: int, by_key: bool = True) -> Bigrams:
    """In a shard, in order of the hash or of the words."""
    key, one, at = np.unique(_key(w, v), return_index=True, return_inverse=True)
    w, v = w[one], v[one]
    lane = textops.mix(v.view(np.uint64) + np.uint64(77)) % np.uint64(max(1, shards // LANES))
    shard = (textops.mix(textops.mix(w.view(np.uint64)) + lane) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable") if by_key else np.lexsort((v, w, shard))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    shard = shard[order]
    return Bigrams(w[order], v[order], key[order], shard, np.flatnonzero(np.diff(shard, prepend=-1)), place[at])


def _six(x: np.ndarray) -> bytes:
    """Numbers of 48 bits, six bytes each."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _of_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<i8").ravel()


def _planes(x: np.ndarray) -> bytes:
    """Numbers of 64 bits, first the lowest bytes of all, so that high bytes of small ones compress to nothing."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _of_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _gaps(x: np.ndarray) -> bytes:
    """Sorted numbers as differences."""
    return _planes(np.diff(x.view(np.uint64), prepend=np.uint64(0)))


def _of_gaps(b: bytes) -> np.ndarray:
    return np.cumsum(_of_planes(b), dtype=np.uint64)


def _packed(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(parts), *map(len, parts)], "<i8").tobytes(), *parts]))


def _unpacked(b: bytes) -> list[bytes]:
    b = zstandard.ZstdDecompressor().decompress(b)
    n = int(np.frombuffer(b[:8], "<i8")[0])
    ends = np.cumsum(np.frombuffer(b[8 : 8 * (n + 1)], "<i8")) + 8 * (n + 1)
    return [b[a:z] for a, z in zip([8 * (n + 1), *ends[:-1]], ends, strict=True)]


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The blocks of a batch."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES, "right"))
        end = min(max(end, at + 1), at + BLOCK_ROWS, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def _dealt(rounds: int):
    """A row for each block of texts: its round, a number, and the rows as a compressed Arrow stream."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = uuid4().int
        for batch in batches:
            for part in _cut(batch):
                own += 1
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([own % rounds], pa.int32()), pa.array([uuid4().int >> 65]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["round", "block", "rows"])

    return run


def _opened(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all().combine_chunks()


def _word_shard(words: np.ndarray, shards: int) -> np.ndarray:
    return (textops.mix(words.view(np.uint64) + np.uint64(55)) % np.uint64(shards)).astype(np.int64)


def _words(b: Bigrams, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words that a block asks for by shard and in order, their shards, and where each begins."""
    words = np.unique(np.append(b.w, 0))
    shard = _word_shard(words, shards)
    order = np.lexsort((words, shard))
    return words[order], shard[order], np.flatnonzero(np.diff(shard[order], prepend=-1))


def _counting(shards: int):
    """For each block of training rows and each shard its bigrams and their counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _cut(batch):
                w, first = _read(part.column("text"))
                if not len(w):
                    continue
                b = _bigrams(w, _before(w, first), shards, by_key=False)
                toxic = np.repeat(part.column("toxic").to_numpy(), np.diff(first))
                n1, n0 = (np.bincount(b.at[toxic == k], minlength=len(b.w)).astype("<u4") for k in (1, 0))
                out = []
                for i, j in b.parts():
                    own = b.w[i:j]
                    begin = np.flatnonzero(np.diff(own, prepend=-1))
                    out.append(_packed(_six(own[begin]), np.diff(begin, append=j - i).astype("<u4").tobytes(), _six(b.v[i:j]), n1[i:j].tobytes(), n0[i:j].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(b.shard[b.cuts]), pa.array(out, pa.binary())], ["shard", "data"])

    return run


def _shard(rows: pa.Table) -> pa.Table:
    """A shard's part of the model (hashes of its bigrams in order, with the sums of all blocks' counts), and counts of words."""
    got = [_unpacked(x.as_py()) for x in rows.column("data")]
    w = np.concatenate([np.repeat(_of_six(x[0]), np.frombuffer(x[1], "<u4")) for x in got])
    v = np.concatenate([_of_six(x[2]) for x in got])
    n1, n0 = (np.concatenate([np.frombuffer(x[k], "<u4") for x in got]).astype(np.int64) for k in (3, 4))
    del got
    order = np.lexsort((v, w))
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(w[order]) != 0) | (np.diff(v[order]) != 0)]))
    s1, s0 = (np.add.reduceat(n[order], begin) for n in (n1, n0))
    w, v = w[order[begin]], v[order[begin]]
    words, which = np.unique(np.concatenate([w, v]), return_inverse=True)
    by = lambda k, x: np.bincount(which[: len(w)] if k else which[len(w) :], x, len(words))
    counts = [by(1, s1 > 0), by(1, s0 > 0), by(1, None), by(0, s1), by(0, s0), by(0, s1 > 0), by(0, s0 > 0)]
    key = _key(w, v)
    order = np.argsort(key)
    data = _packed(_gaps(key[order]), *(_planes(s[order]) for s in (s1, s0)))
    none = pa.nulls(len(words), pa.int64())
    told = pa.table([pa.concat_arrays([rows.column("shard").combine_chunks().slice(0, 1), none]), pa.array([data, *[None] * len(words)], pa.binary())], ["shard", "data"])
    for name, x in zip(["word", *COUNTS], [words, *counts], strict=True):
        told = told.append_column(name, pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(x.astype(np.int64))]))
    return told


def _sharded(shards: int):
    """Words with the number of their shard, as blocks ask for it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = -1 - _word_shard(batch.column(0).to_numpy(), shards)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], ["word", *COUNTS, "shard"])

    return run


def _gathered(rows: pa.Table) -> pa.Table:
    """A shard of words in one row."""
    rows = rows.sort_by("word")
    data = _packed(_gaps(rows.column("word").to_numpy()), *(_planes(rows.column(c).to_numpy()) for c in COUNTS))
    return pa.table([rows.column("shard").combine_chunks().slice(0, 1), pa.array([data], pa.binary())], ["shard", "data"])


def _asking(shards: int):
    """For each block and shard the hashes of its bigrams, and its words to shards that are told by numbers below 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w, first = _read(_opened(rows.as_py()).column("text"))
                if not len(w):
                    continue
                b = _bigrams(w, _before(w, first), shards)
                words, of, cuts = _words(b, shards)
                out = [_packed(_gaps(b.key[i:j])) for i, j in b.parts()]
                out += [_packed(_gaps(words[i:j])) for i, j in zip(cuts, [*cuts[1:], len(words)], strict=True)]
                shard = np.append(b.shard[b.cuts], -1 - of[cuts])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shard), block)), pa.array(shard), pa.array(out, pa.binary())], ["block", "shard", "data"])

    return run


def _answer(asked: pa.Table, known: pa.Table) -> pa.Table:
    """The counts of each block's bigrams or words in one shard, in its order; 0 where one is not known."""
    out = []
    if asked.num_rows:
        if known.num_rows:
            parts = _unpacked(known.column("data")[0].as_py())
            keys, counts = _of_gaps(parts[0]), [np.append(_of_planes(x), np.uint64(0)) for x in parts[1:]]
        else:
            keys, counts = np.zeros(0, np.uint64), [np.zeros(1, np.uint64)] * (2 if asked.column("shard")[0].as_py() >= 0 else len(COUNTS))
        for data in asked.column("data"):
            at = _find(keys, _of_gaps(_unpacked(data.as_py())[0]))
            out.append(_packed(*(_planes(c[at]) for c in counts)))
    return pa.table([asked.column("block"), asked.column("shard"), pa.array(out, pa.binary())], ["block", "shard", "data"])


@dataclass
class Model:
    """What is known of all counts together, and the curve; pairs are classes 1 (toxic) and 0."""

    bigrams: tuple  # different bigrams of a class, and of either
    types: tuple  # words that the class has
    size: int  # words that either has
    base: float = 0.0
    weights: tuple = ()
    mean: tuple = ()
    scale: tuple = ()


def ratios(bigrams: np.ndarray, of_w: np.ndarray, of_v: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """log P_toxic(w | v) - log P_ordinary(w | v), and the same for w alone. ``bigrams``: the
    two counts of each; ``of_w``, ``of_v``: rows of ``COUNTS``."""
    even = 1 / (model.size + 1)
    shared = EVEN * even + (1 - EVEN) * (of_w[:, 2] + 1) / (model.bigrams[2] + model.size + 1)
    alone = np.stack([(np.maximum(of_w[:, k] - DISCOUNT, 0) + (DISCOUNT * model.types[k] + 1) * shared) / (model.bigrams[k] + 1) for k in (0, 1)], 1)
    alone[of_w[:, 2] == 0] = even
    tokens, after = of_v[:, 3:5], of_v[:, 5:7]
    backoff = np.where(tokens > 0, DISCOUNT * after / np.maximum(tokens, 1), 1.0)
    p = np.log(np.maximum(bigrams - DISCOUNT, 0) / np.maximum(tokens, 1) + backoff * alone)
    one = np.log(alone)
    return p[:, 0] - p[:, 1], one[:, 0] - one[:, 1]


def signals(w: np.ndarray, first: np.ndarray, full: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """By text: words, ratio per word of the whole text, highest ratio per word of each window.
    ``full``, ``alone``: the ratios of each word."""
    size = np.diff(first)
    rows = np.zeros((len(size), 2 + len(WINDOWS)))
    rows[:, 0] = size
    has = np.flatnonzero(size)
    if len(has):
        full, alone = (np.concatenate([[0.0], np.cumsum(x)]) for x in (full, alone))
        rows[has, 1] = (full[first[has + 1]] - full[first[has]]) / size[has]
        past, start = np.arange(1, len(w) + 1), np.repeat(first[:-1], size)
        for k, window in enumerate(WINDOWS):
            begin = np.maximum(start, past - window)
            sums = alone if window == 1 else full
            whole = past - begin >= np.minimum(np.repeat(size, size), window)
            mean = np.where(whole, (sums[1:] - sums[begin]) / (past - begin), -np.inf)
            rows[has, 2 + k] = np.maximum.reduceat(mean, first[has])
    return rows


def _told(shards: int, model: Model):
    """Signals of a block's texts, from the block and the answers to it."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _opened(blocks.column("rows")[0].as_py())
        w, first = _read(texts.column("text"))
        full = alone = np.zeros(0)
        if len(w):
            b = _bigrams(w, _before(w, first), shards)
            shard = answers.column("shard").to_numpy()
            data = answers.column("data").to_pylist()
            got = [_unpacked(data[k]) for k in sorted(np.flatnonzero(shard >= 0), key=lambda k: shard[k])]
            bigrams = np.stack([np.concatenate([_of_planes(x[k]) for x in got]) for k in (0, 1)], 1).astype(float)
            words, _, _ = _words(b, shards)
            got = [_unpacked(data[k]) for k in sorted(np.flatnonzero(shard < 0), key=lambda k: -shard[k])]
            table = np.stack([np.concatenate([_of_planes(x[k]) for x in got]) for k in range(len(COUNTS))], 1).astype(float)
            order = np.argsort(words)
            of_w, of_v = (table[order[np.searchsorted(words[order], x)]] for x in (b.w, b.v))
            full, alone = (x[b.at] for x in ratios(bigrams, of_w, of_v, model))
        x = signals(w, first, full, alone)
        return pa.table([*(texts.column(c) for c in ("doc_id", "h", "h2")), *(pa.array(x[:, k]) for k in range(x.shape[1]))], ["doc_id", "h", "h2", *SIGNALS])

    return run


def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each value in sorted ``keys``; len(keys) where it is not there."""
    if not len(keys):
        return np.zeros(len(x), np.int64)
    at = np.searchsorted(keys, x)
    return np.where(keys[np.minimum(at, len(keys) - 1)] == x, at, len(keys))


def _bucketed(parts: DataFrame, shards: int) -> tuple[str, DataFrame]:
    """Write the parts of the model in buckets of shards: the table's name, and the table."""
    name = f"toxicity_model_{uuid4().hex}"
    path = f"{shared_folder(parts.sparkSession)}/{name}"
    parts.write.bucketBy(int(min(BUCKETS[1], max(BUCKETS[0], shards))), "shard").option("path", path).saveAsTable(name)
    out = parts.sparkSession.table(name)
    out.stored_at = path
    return name, out


def signalled(docs: DataFrame) -> tuple[DataFrame, Model | None]:
    """doc_id, two hashes of the text, and the text's signals, for every row of ``docs`` (doc_id,
    text, toxic: 1 or 0 in training rows); no model without training rows that have words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    bytes_ = F.octet_length("text").cast("long")
    size, taught = docs.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in (bytes_, F.when(F.col("toxic").isNotNull(), bytes_)))).first()
    shards = max(LEAST_SHARDS, size // SHARD_BYTES, taught // TRAINING_BYTES)
    rounds = int(min(ROUNDS, max(1, size // ROUND_BYTES)))
    schema = f"doc_id {kind}, h long, h2 long, {', '.join(f'{x} double' for x in SIGNALS)}"
    with without_shuffle_files(docs.sparkSession):
        training = docs.where("toxic is not null").select("text", F.col("toxic").cast("long").alias("toxic"))
        counted = training.mapInArrow(lean(_counting(shards)), "shard long, data binary")
        results = stored(counted.groupBy("shard").applyInArrow(lean_group(_shard), f"shard long, data binary, {WORD}"), "counts")
        words = stored(results.where("word is not null").groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS)), "words")
        met = lambda c: F.count(F.when(F.col(c) > 0, 1))
        n1, n0, n, types1, types0, known = (x or 0 for x in words.agg(*(F.sum(c) for c in COUNTS[:3]), met("c1"), met("c0"), met("c")).first())
        model = Model((n1, n0, n), (types1, types0), known)
        of_words = words.mapInArrow(lean(_sharded(shards)), f"{WORD}, shard long").groupBy("shard").applyInArrow(lean_group(_gathered), "shard long, data binary")
        name, parts = _bucketed(results.where("data is not null").select("shard", "data").unionByName(of_words), shards)
        try:
            removed(results)
            removed(words)
            blocks = stored(docs.select("doc_id", "text", *_hashes("text")).mapInArrow(lean(_dealt(rounds)), "round int, block long, rows binary"), "blocks", "round")
            found = []
            for k in range(rounds):
                own = blocks.where(F.col("round") == k).select("block", "rows")
                answers = own.mapInArrow(lean(_asking(shards)), ANSWER).groupBy("shard").cogroup(parts.groupBy("shard")).applyInArrow(lean_cogroup(_answer), ANSWER)
                found.append(stored(own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lean_cogroup(_told(shards, model)), schema), "signals"))
        finally:  # a failed run leaves nothing in the catalog
            docs.sparkSession.sql(f"DROP TABLE {name}")
    removed(blocks)
    removed(parts)
    return reduce(DataFrame.unionByName, found), model if known else None


def _hashes(text: str) -> list[Column]:
    """Two hashes that together stand for a text."""
    return [F.xxhash64(text).alias("h"), F.xxhash64(F.lit("2"), text, F.lit("2")).alias("h2")]


def _score(model: Model) -> Column:
    """The score by the signals' columns."""
    if not model.weights:
        return F.lit(float(model.base))
    z = F.lit(float(model.weights[0]))
    for name, w, m, d in zip(SIGNALS[1:], model.weights[1:], model.mean, model.scale, strict=True):
        z = z + F.lit(float(w)) * (F.col(name) - F.lit(float(m))) / F.lit(float(d))
    return F.when(F.col("n") > 0, 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))).otherwise(F.lit(float(model.base)))


def _calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Ridge logistic regression by Newton's method on standardised signals."""
    model.base = float(y.mean()) if len(y) else 0.0
    x, y = x[x[:, 0] > 0], y[x[:, 0] > 0]
    if not len(y):
        return
    model.mean, model.scale = tuple(x[:, 1:].mean(0)), tuple(x[:, 1:].std(0) + 1e-9)
    a = np.concatenate([np.ones((len(x), 1)), (x[:, 1:] - model.mean) / model.scale], 1)
    b = np.zeros(a.shape[1])
    ridge = np.diag([1e-6, *[0.5] * (len(b) - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ b)
        b += step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    model.weights = tuple(b)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, two hashes of the text and score for every row of ``docs``. Of the labelled rows
    folds 0 and 1 are counted, fold 3 (``CALIBRATION_ROWS`` rows of it at most, in order of a
    hash of the text) sets the curve, fold 2 is held out."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = small(stored(known.where(fold(F.col("doc_id")) != 2).withColumnRenamed("doc_id", "_id"), "labels"))
    rows = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_id"), "left")
    found, model = signalled(rows.select("doc_id", "text", F.when(fold(F.col("doc_id")).isin(0, 1), F.col("toxic")).alias("toxic")))
    if model is None:
        return found.select("doc_id", "h", "h2", F.lit(0.0).alias("score"))
    held = found.where((fold(F.col("doc_id")) == 3) & (F.col("h") != F.xxhash64(F.lit(None).cast("string")))).join(known, F.col("doc_id") == F.col("_id"))
    sample = held.select("toxic", *SIGNALS, "h").orderBy("h", "toxic", "n").limit(CALIBRATION_ROWS).toPandas()
    _calibrate(model, sample[SIGNALS].to_numpy(float), sample["toxic"].to_numpy(float))
    return found.select("doc_id", "h", "h2", _score(model).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text)."""
    out = scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels)
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more. A score is the text's, so
    these texts' hashes tell the rows."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bad = stored(scores(own, labels).where(F.col("score") >= threshold).select(F.col("h").alias("_h"), F.col("h2").alias("_h2")).distinct(), "toxic")
    h, h2 = _hashes(name_of(docs, "text"))
    return restored(docs.select(*carried(docs)).join(small(bad), (h == F.col("_h")) & (h2 == F.col("_h2")), "left_anti"), docs)
