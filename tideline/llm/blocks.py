"""Comparison of all members of a group in pieces of bounded size.

A group of any size is dealt into blocks of about ``target`` members; every pair of blocks
is one unit of work, and units are spread over all tasks. No unit has many more than
2 x target rows, however large its group is, and no pair of members becomes a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .workers import lean

Unit = tuple[int, int]


def units(df: DataFrame, keys: list[str], member: str, target: int = 256) -> DataFrame:
    """Rows of groups of two and more, each once for every unit that it is part of, with
    ``gid`` (the unit) and ``side`` (0 or 1; all 0 where a block meets itself). Group sizes are
    written out, so that Spark can split the join of a group of any size with its size."""
    sizes = stored(df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1"), "sizes")
    dealt = (
        df.join(sizes, keys)
        .withColumn("_blocks", F.ceil(F.col("_n") / target).cast("int"))
        .withColumn("_own", F.expr(f"cast(pmod(xxhash64({member}, 11), _blocks) as int)"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    )
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    return dealt.select(
        *(c for c in df.columns if c not in keys or c == member),
        *(k for k in keys if k != member),
        F.xxhash64(*keys, low, high).alias("gid"),
        (F.col("_own") > F.col("_other")).cast("int").alias("side"),
    )


def map_units(df: DataFrame, work: Callable[[pa.Table, list[Unit]], pa.Table | None], schema: str) -> DataFrame:
    """Bring each unit together and call ``work(rows, [(first, past the last), ...])`` on
    whole units; rows of a unit are contiguous and have side 0 before side 1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([held, now]) if held is not None else now
            gid = now["gid"].to_numpy()
            cut = np.flatnonzero(gid[1:] != gid[:-1]) + 1
            if not len(cut):
                held = now
                continue
            yield from _given(work, now.slice(0, cut[-1]), [0, *cut.tolist()])
            held = now.slice(cut[-1])
        if held is not None and held.num_rows:
            yield from _given(work, held, [0, held.num_rows])

    def _given(f, rows: pa.Table, bounds: list[int]) -> Iterator[pa.RecordBatch]:
        out = f(rows.combine_chunks(), list(zip(bounds[:-1], bounds[1:], strict=True)))
        if out is not None and out.num_rows:
            yield from out.to_batches()

    return df.repartition("gid").sortWithinPartitions("gid", "side").mapInArrow(lean(run), schema)


def roots(near: np.ndarray) -> np.ndarray:
    """For each node of a symmetric boolean matrix, the first node of its component."""
    n = len(near)
    out = np.full(n, -1)
    for i in range(n):
        if out[i] >= 0:
            continue
        out[i] = i
        front = near[i] & (out < 0)
        while front.any():
            out[front] = i
            front = near[front].any(0) & (out < 0)
    return out
