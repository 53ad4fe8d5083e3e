"""Memory of Python workers. Spark gives a worker one task after another, of this stage and of later ones,
and what a task has freed stays with the worker's allocators, beside whatever the executor does next. Work that
is wrapped here gives it back to the system."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa

Batches = Iterable[pa.RecordBatch]


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """glibc's ``malloc_trim``; other C libraries have none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Free memory of Arrow's pool and of the C library goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim:
        trim(0)


def lean(work: Callable[[Batches], Iterator[pa.RecordBatch]]) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """``work`` of a ``mapInArrow``; gives back after each batch and at its end."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        def fed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                give_back()

        yield from work(fed())
        give_back()

    return run


def lean_group(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``work`` of a group's ``applyInArrow``; gives back after each group."""

    def run(rows: pa.Table) -> pa.Table:
        out = work(rows)
        give_back()
        return out

    return run


def lean_cogroup(work: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same of two groups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right)
        give_back()
        return out

    return run
