"""Embedding near-duplicates: sign hashing in several tables, exact cosines, components.

Equal vectors (bit for bit) are collapsed first; each different vector is a node with a number
of its own. It gets the signs of its products with random hyperplanes: b bits in each of T tables,
and ``CODE`` more for all tables. b grows with the logarithm of the number of vectors, so that
buckets keep their mean size, and T follows from b so that a pair exactly at the threshold meets
in a bucket with probability ``recall``. Within a bucket all pairs are screened by how many
of the ``CODE`` signs differ (a pair at the threshold fails this once in about 10^7), in blocks; what
remains of a bucket is passed on as a spanning forest. Only signs travel so far. Vectors are
fetched for the components of these forests, where every pair is compared by its cosine in double
precision, in blocks; links are counted, and their own components are the result.

Results: one row per row of the input: vec_id, n_links (other vectors linked directly, equal
ones included), component_id (smallest vec_id reachable, itself included), kept (vec_id =
component_id). A vector that is null, empty, zero or holds null or non-finite components links
with nothing; nor does a row without vec_id (component_id null, kept true). Vectors of different
lengths never link; vectors of any length are read whole. A cosine that ties with the threshold
links. A row repeated with its vec_id and vector is one vector, and no link of itself; rows of
one vec_id with different vectors are different vectors. An empty table gives an empty result.
Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import map_units, roots, units
from .components import components
from .store import small, stored

BUCKET = 512  # mean members of a bucket
CODE = 256  # signs that pairs are screened by
SLACK = 5.2  # standard errors that a pair at the threshold may differ more than expected
BLOCK = 256  # vectors in a block
BROADCAST_VECTORS = 20_000


def shape(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits a table, and tables, for ``n`` vectors."""
    bits = min(30, max(4, round(math.log2(max(n, 1) / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def _signs(x: np.ndarray, columns: int, seed: int) -> np.ndarray:
    return (x @ np.random.default_rng(seed).standard_normal((x.shape[1], columns))) > 0


def _codes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(vectors, tables) bucket numbers."""
    return _signs(x, tables * bits, 5).reshape(len(x), tables, bits) @ (1 << np.arange(bits))


def _clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes of doubles, others as null."""
    for batch in batches:
        lists = batch.column(1)
        out = []
        flat = np.asarray(lists.values.to_numpy(zero_copy_only=False), np.float64)  # nulls are NaN
        at = lists.offsets.to_numpy()
        for i, valid in enumerate(lists.is_valid().to_pylist()):
            x = flat[at[i] : at[i + 1]]
            out.append(x.tobytes() if valid and len(x) and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])


def _groups(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors, for each length of vectors."""
    raw = column.to_pylist()
    size = np.array([len(x) for x in raw], np.int64)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        x = np.frombuffer(b"".join(raw[k] for k in rows), np.float64).reshape(len(rows), -1)
        x = x / np.abs(x).max(1, keepdims=True)
        yield rows, x / np.sqrt((x * x).sum(1, keepdims=True))


def _signed(bits: int, tables: int):
    """rep, length, bucket numbers and signs of each vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 4096) for whole in batches for k in range(0, whole.num_rows, 4096)):
            for rows, x in _groups(batch.column(1)):
                codes = _codes(x, bits, tables).astype(np.int32)
                signs = np.packbits(_signs(x, CODE, 6), axis=1)
                columns = [batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), x.shape[1], np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([s.tobytes() for s in signs], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["rep", "size", "codes", "signs"])

    return run


def _bucketed(tables: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int32)
            rep, size = (np.repeat(batch.column(k).to_numpy(), tables) for k in (0, 1))
            table = np.tile(np.arange(tables, dtype=np.int64), n)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(size), pa.array(table << 32 | codes)], ["rep", "size", "bucket"])

    return run


def _screen(threshold: float):
    """Spanning forest of each unit's pairs whose signs pass the screen."""
    part = math.acos(threshold) / math.pi
    most = math.floor(CODE * part + SLACK * math.sqrt(CODE * part * (1 - part)))

    def work(rows: pa.Table, bounds: list[tuple[int, int]]) -> pa.Table:
        rep, side = (rows[c].to_numpy() for c in ("rep", "side"))
        packed = np.frombuffer(b"".join(rows["signs"].to_pylist()), np.uint8).reshape(-1, CODE // 8)
        us, vs = [], []
        for i, j in bounds:
            mid = int(np.searchsorted(side[i:j], 1))
            signs = np.unpackbits(packed[i:j], axis=1).astype(np.float32) * 2 - 1
            near = signs @ signs.T >= CODE - 2 * most
            if mid < j - i:
                near[:mid, :mid] = False
                near[mid:, mid:] = False
            root = roots(near)
            moved = np.flatnonzero(root != np.arange(j - i))
            us.append(rep[i + moved])
            vs.append(rep[i + root[moved]])
        none = [np.zeros(0, np.int64)]
        return pa.table({"u": np.concatenate(us or none), "v": np.concatenate(vs or none)})

    return work


def _link(threshold: float):
    """Exact links within each unit: rep, its linked vectors there, and a linked root."""

    def work(rows: pa.Table, bounds: list[tuple[int, int]]) -> pa.Table:
        rep, side, copies = (rows[c].to_numpy() for c in ("rep", "side", "copies"))
        out_rep, out_n, out_root = [], [], []
        for i, j in bounds:
            for own, x in _groups(rows["v"].slice(i, j - i)):
                second = side[i:j][own] == 1
                linked = x @ x.T >= threshold
                np.fill_diagonal(linked, False)
                if second.any():
                    linked &= second[:, None] != second[None, :]
                n = linked @ copies[i:j][own]
                root = roots(linked)
                tell = n > 0
                out_rep.append(rep[i:j][own][tell])
                out_n.append(n[tell])
                out_root.append(rep[i:j][own][root[tell]])
        none = [np.zeros(0, np.int64)]
        return pa.table({"rep": np.concatenate(out_rep or none), "n": np.concatenate(out_n or none).astype(np.int64), "root": np.concatenate(out_root or none)})

    return work


def embedding_near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.999) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    clean = stored(rows.mapInArrow(_clean, "vec_id long, v binary"), "vectors")
    told_apart = clean.where("v is not null and vec_id is not null").select("vec_id", "v").distinct()
    reps = told_apart.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()), "vector-reps")
    bits, tables = shape(reps.count(), threshold, recall)
    signed = stored(reps.select("rep", "v").mapInArrow(_signed(bits, tables), "rep long, size int, codes binary, signs binary"), "signs")
    buckets = signed.select("rep", "size", "codes").mapInArrow(_bucketed(tables), "rep long, size int, bucket long")
    met = units(buckets, ["bucket", "size"], "rep", BLOCK).join(signed.select("rep", "signs"), "rep")
    near = components(map_units(met, _screen(threshold), "u long, v long"))
    near = stored(near.join(reps.select("rep", "copies"), F.col("node") == F.col("rep")).select("rep", "component", "copies"), "vector-near")
    compared = units(near, ["component"], "rep", BLOCK).join(reps.select("rep", "v"), "rep")
    links = stored(map_units(compared, _link(threshold), "rep long, n long, root long"), "vector-links")
    classes = components(links.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    members = stored(classes.join(reps.select("rep", "first"), F.col("node") == F.col("rep")).select("rep", "component", "first"), "vector-members")
    named = stored(members.groupBy("component").agg(F.min("first").alias("component_id")), "vector-classes")
    counted = links.groupBy("rep").agg(F.sum("n").alias("n"))
    placed = members.join(named, "component").select("rep", "component_id").join(counted, "rep", "left")
    known = reps.join(placed, "rep", "left").where("component_id is not null or copies > 1")
    known = small(stored(known.select("v", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component_id", "first").alias("component_id")), "vector-known"), BROADCAST_VECTORS)
    told = clean.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("v")).alias("v")).join(known, "v", "left")
    component = F.coalesce("component_id", "vec_id")
    return told.select(
        "vec_id",
        F.coalesce(F.col("n") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
