"""Packing: a cutting-stock problem over the histogram of piece lengths.

A document's ids are cut into full pieces of ``CAPACITY`` and one remainder. Lengths are
counted in steps of ``GRID`` ids; only this histogram (``CAPACITY`` / ``GRID`` sizes at most,
however many documents) reaches the driver. There a linear program over patterns (multisets
of sizes that fit a sequence) is solved by column generation: dual prices of the sizes come
from the current basis, an unbounded knapsack over these prices finds the pattern with the
best reduced cost, until the proven gap is below ``GAP``. Pattern counts are rounded down,
what is left (a few pieces for each pattern) is packed first-fit decreasing.

Pieces are then ranked within their size, in parts of about ``PART`` pieces dealt by hash, so
that the number of tasks follows the number of pieces even where all have one size; a rank's
place in its size's list of patterns gives the sequence and the place in it.

Results: one row per piece. A null or empty text has one id (the end id 0); a text of any length
is read whole. Repeated rows are packed each for itself, with ranks of their own (pieces that tie
in everything may change places); doc_id may be null; an empty table gives no pieces. Columns
other than doc_id and text are not read. The ids are those of the ``tokenizers``
library for byte_bpe_50k.json; most are made with the same vocabulary as ranks, which is
three times faster, and tests hold both against each other. Texts that hold an added token of
the library's, or more than ``LONG_SPACE`` white space in a row, go to the library itself.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import small, stored
from .workers import lean

CAPACITY = 1024
GRID = 4
GAP = 0.001
PART = 500_000  # pieces that one task ranks
LEAST_PARTS = 64
LONG_SPACE = 20_000  # the other engine's stack overflows on very long runs
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _json(path: str) -> str:
    """The library's file beside a file of ranks."""
    return path.removesuffix(".tiktoken") + ".json"


def _needs_library(text: str, added: list[str]) -> bool:
    return any(x in text for x in added) or len(text) > LONG_SPACE and any(m.end() - m.start() > LONG_SPACE for m in re.finditer(r"\s+", text))


def _cut(path: str, pattern: str, capacity: int, added: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(path, pattern)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                own = library(_json(path)).encode(text, add_special_tokens=False).ids if _needs_library(text, added) else encoder.encode_to_numpy(text, disallowed_special=())
                ids = np.append(np.asarray(own, "<u4"), np.zeros(1, "<u4"))
                n = len(ids)
                rows += [(doc_id, at, min(capacity, n - at), zlib.crc32(ids[at : at + capacity]), n) for at in range(0, n, capacity)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """Each document's pieces of at most ``capacity`` ids (``PIECE``)."""
    with open(_json(path)) as f:
        added = [x["content"] for x in json.load(f)["added_tokens"]]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_cut(path, pattern, capacity, added)), PIECE)


def _best_pattern(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Value and counts of the pattern that is worth most at these prices: an unbounded
    knapsack by dynamic programming over the fill."""
    use = np.flatnonzero(price > 1e-12)
    size, worth = sizes[use], price[use]
    value = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for fill in range(1, capacity + 1):
        value[fill] = value[fill - 1]
        k = int(np.searchsorted(size, fill, "right"))
        if k:
            got = value[fill - size[:k]] + worth[:k]
            best = int(got.argmax())
            if got[best] > value[fill] + 1e-12:
                value[fill], last[fill] = got[best], use[best]
    counts = np.zeros(len(sizes))
    at = capacity
    while at > 0:
        if last[at] < 0:
            at -= 1
        else:
            counts[last[at]] += 1
            at -= int(sizes[last[at]])
    return float(value[capacity]), counts


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, rounds: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows: counts by size) and how often each is used, fractions allowed: the
    linear program (fewest sequences that cover the demand) by column generation, in revised
    simplex form. Prices are smoothed towards the best ones so far, at first a size's share
    of the capacity, which keeps them from swinging. ``sizes`` rise."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / (capacity // sizes))
    cost = np.ones(m)
    x = inverse @ demand
    centre = sizes / capacity
    bound = float(centre @ demand)
    smooth = 0.9
    for step in range(rounds):
        price = cost @ inverse
        if float(cost @ x) - bound <= gap * bound:
            break
        low = int(price.argmin())
        if price[low] < -1e-9:  # more of this size than asked for does no harm
            counts, c = -np.eye(m)[low], 0.0
        else:
            for part in (smooth, 0.5 * smooth, 0.0):
                mixed = np.maximum(part * centre + (1 - part) * price, 0)
                worth, counts = _best_pattern(sizes, mixed, capacity)
                if float(mixed @ demand) / max(worth, 1.0) > bound:
                    bound, centre = float(mixed @ demand) / max(worth, 1.0), mixed / max(worth, 1.0)
                if price @ counts > 1 + 1e-9:
                    break
            else:
                break
            c = 1.0
        move = inverse @ counts
        room = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
        out = int(room.argmin())
        if not np.isfinite(room[out]):
            break
        inverse[out] /= move[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(move[others], inverse[out])
        basis[out], cost[out] = counts, c
        if step % 100 == 99:
            inverse = np.linalg.inv(basis.T)
        x = np.maximum(inverse @ demand, 0)
    real = cost > 0
    return basis[real], x[real]


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Rows (size, lo, hi, sequence, copies, slot): the pieces of a size ranked lo to hi - 1
    go, ``copies`` to each, into sequences from ``sequence`` on, at places from ``slot`` on.
    And the number of sequences."""
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(n)] for n in sizes], np.int64)
    patterns: list[tuple[np.ndarray, int]] = []
    left = demand.copy()
    if len(sizes):
        found, x = solve(sizes, demand.astype(float), capacity)
        for k in np.argsort(-x, kind="stable"):
            counts = found[k].astype(np.int64)
            has = counts > 0
            times = min(int(x[k] + 1e-6), int((left[has] // counts[has]).min()))
            if times:
                patterns.append((counts, times))
                left -= counts * times
    room: list[int] = []
    fills: list[np.ndarray] = []
    for k in range(len(sizes) - 1, -1, -1):  # the rest first fit, longest first
        at = 0
        for _ in range(int(left[k])):
            while at < len(room) and room[at] < sizes[k]:
                at += 1
            if at == len(room):
                room.append(capacity)
                fills.append(np.zeros(len(sizes), np.int64))
            room[at] -= int(sizes[k])
            fills[at][k] += 1
    rows, sequence, done = [], 0, np.zeros(len(sizes), np.int64)
    for counts, times in [*patterns, *((c, 1) for c in fills)]:
        slot = 0
        for k in np.flatnonzero(counts):
            copies = int(counts[k])
            rows.append((int(sizes[k]), int(done[k]), int(done[k]) + copies * times, sequence, copies, slot))
            done[k] += copies * times
            slot += copies
        sequence += times
    return rows, sequence


def packed(cut: DataFrame, capacity: int = CAPACITY, grid: int = GRID) -> DataFrame:
    """``cut`` (a stored table of pieces) with sequence_id and offset. Pieces are dealt by their place (``row``) too, so
    that many identical ones are many tasks."""
    spark = cut.sparkSession
    if "row" not in cut.columns:
        cut = stored(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    sized = cut.withColumn("size", F.expr(f"(length + {grid - 1}) div {grid}"))
    parts = max(LEAST_PARTS, cut.count() // PART)
    dealt = sized.withColumn("salt", F.expr(f"pmod(xxhash64(doc_id, start, ids_crc32, row), {parts})"))
    counts = stored(dealt.groupBy("size", "salt").count(), "sizes")
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("count").alias("n")).collect()}  # capacity / grid sizes at most
    before = F.coalesce(F.sum("count").over(W.partitionBy("size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = small(stored(counts.select("size", "salt", before.alias("before")), "ranks"))
    rows, _ = plan(histogram, capacity // grid)
    places = F.broadcast(spark.createDataFrame(rows, "_size long, lo long, hi long, sequence long, copies long, slot long"))
    order = W.partitionBy("size", "salt").orderBy("row")
    ranked = dealt.withColumn("n", F.row_number().over(order)).join(base, ["size", "salt"]).withColumn("rank", F.col("before") + F.col("n") - 1)
    placed = ranked.join(places, F.expr("size = _size and rank >= lo and rank < hi"))
    placed = placed.withColumn("sequence_id", F.expr("sequence + (rank - lo) div copies")).withColumn("place", F.expr("slot + (rank - lo) % copies"))
    ahead = F.sum("length").over(W.partitionBy("sequence_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(ahead, F.lit(0)).cast("long").alias("offset"))


def pack(docs: DataFrame, path: str | None = None, pattern: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text); see above. ``path``: a file of ranks,
    ``pattern``: what splits a text before merging; both default to the public vocabulary."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    cut = pieces(docs, path, pattern, capacity).withColumn("row", F.monotonically_increasing_id())
    return packed(stored(cut, "pieces"), capacity)
