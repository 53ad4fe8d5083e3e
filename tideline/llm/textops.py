"""Vectorised word and shingle hashes over Arrow string batches.

A word is a maximal run of bytes other than ASCII white space in the lower-cased
UTF-8 text. Words are hashed with a polynomial over a table of random 64-bit values,
so that all words of a batch come from one cumulative sum. A document's shingles are
the distinct hashes of its runs of ``n`` consecutive words; a document of fewer words
has one shingle, made of all its words; a document without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18  # what is hashed at once; a longer document is a chunk of its own
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


@lru_cache(maxsize=1)
def _is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, lower: bool = True, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about ``size`` bytes; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """True for ASCII letters and all bytes of other characters."""
    table = np.zeros(256, bool)
    table[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return table


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each document the index of its first word (n + 1 values).
    ``separator``: for each byte value whether it parts words; white space by default."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = (_is_space() if separator is None else separator)[data]
    starts = ~space
    starts[1:] &= space[:-1]
    ends = ~space
    ends[:-1] &= space[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]  # words don't run over documents
    starts[cuts] = ~space[cuts]
    ends[cuts - 1] = ~space[cuts - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    # only the powers for chunks are kept, not those for a longer document
    up, down = _powers(CHUNK_BYTES) if len(data) <= CHUNK_BYTES else _powers.__wrapped__(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_byte_values()[data] * up[: len(data)], out=total[1:])
    return mix((total[end + 1] - total[start]) * down[start]), np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in text order with repeats, and for each document the index of its first."""
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(made)])
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    pos = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], made)
    left = np.repeat(first[1:], made) - pos  # words from here to the document's end
    out = np.zeros(at[-1], np.uint64)
    for k in range(n):
        out = (out + np.where(k < left, padded[pos + k], np.uint64(0))) * np.uint64(_BASE)
    return mix(out), at


def shingle_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for _, data, offsets in chunks(texts):
        values, at = shingles(*words(data, offsets), n)
        out += [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out
