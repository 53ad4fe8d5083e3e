"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

1. Every text is signed once: 16 trees of 8 MinHash values over its word shingles, and a
   hash of its word sequence. Texts of the same words (letter case and white space aside)
   are one *class of copies*, and a class is one node, with a number of its own: doc_id is
   never what identifies a text.
2. A tree is a prefix trie of the nodes' branches (its 8 values), written in sorted order. A
   level of the forest meets the nodes that share a prefix of its length; the descent starts
   at long prefixes and shortens them, and a level compares only pairs that the levels before
   did not (those whose branches part just there). After each level the chance of having found
   a pair is estimated for the least similar pairs at or above the threshold that were seen;
   the prefix is shortened until this reaches ``recall``. Where even one value does not reach
   it, the join raises an error.
3. Pairs whose signatures agree in fewer than ``screen`` of their values are left out
   (128 values: a pair at the threshold fails this once in about 10^7). What remains of a
   group is passed on as a spanning forest, so that rows grow with texts, not with pairs.
4. Within each component, all pairs are verified on whole shingle sets (64-bit hashes) in
   blocks; links are counted, and the links' own components are the classes. What travels to
   the blocks is not a text but its set as a difference from the component's first one (a bit
   for each hash of that, and the other hashes), since a member of a group of m texts goes to
   m / ``VERIFIED`` of them.

Results: one row per row of the input. ``class_id`` is the smallest doc_id that links of
similarity >= threshold reach, ``n_links`` the number of other rows linked directly, copies
included, ``kept`` whether doc_id = class_id. A text that is null or has no words links with
nothing, nor does a row without doc_id (class_id null, kept true). Repeated rows are copies
of each other; rows of one doc_id with different texts are different documents. A text of
fewer than n words has one shingle, all its words. Texts of any length are read whole. Ties of
similarity do not occur: a pair links or does not. An empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .blocks import map_units, roots, units
from .components import components
from .store import carried, name_of, removed, restored, small, stored
from .workers import lean

TREES, DEPTH = 16, 8
START = 6  # length of the first prefixes
BAND = 0.05  # of similarity, for the estimate of recall
VERIFIED = 256  # texts in a block of verification


def _signer(n: int):
    random = np.random.default_rng(7)
    a = random.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    b = random.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures, wholes = [], []
            for _, data, offsets in textops.chunks(batch.column(2)):
                hashes, first = textops.words(data, offsets)
                values, at = textops.shingles(hashes, first, n)
                low = (values >> np.uint64(32)).astype(np.uint32)
                has = np.flatnonzero(np.diff(at))
                out = np.zeros((len(at) - 1, TREES * DEPTH), np.uint32)
                whole = np.zeros((len(at) - 1, 2), np.uint64)
                if len(has):
                    for k in range(TREES * DEPTH):
                        out[has, k] = np.minimum.reduceat(low * a[k] + b[k], at[has])
                    # the word sequence: words weighted by their place
                    place = textops.mix(np.arange(len(hashes), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64))
                    for j, h in enumerate((hashes * (place | np.uint64(1)), textops.mix(hashes ^ place))):
                        whole[has, j] = np.add.reduceat(h, first[has])
                signatures += [x.tobytes() if k else None for x, k in zip(out, np.diff(at), strict=True)]
                wholes += [x.tobytes() if k else None for x, k in zip(whole, np.diff(at), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(wholes, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "h", "words", "signature"])

    return sign


def _branches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: the 4 x ``DEPTH`` bytes of its values, most significant first."""
    for batch in batches:
        n = batch.num_rows
        if n:
            s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).astype(">u4")
            branch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * DEPTH), n * TREES, [None, pa.py_buffer(s.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), TREES)), pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), branch], ["rep", "tree", "branch"])


def forest(reps: DataFrame) -> DataFrame:
    """The tries (tree, branch, rep) in sorted order; ``reps``: rep, signature."""
    grown = reps.select("rep", "signature").mapInArrow(lean(_branches), "rep long, tree int, branch binary")
    return stored(grown.repartitionByRange("tree", "branch").sortWithinPartitions("tree", "branch"), "forest")


def _compare(depth: int, done: int, screen: float):
    """Spanning forest of each unit's pairs that pass the screen (kind 0: u, v), and how many
    of its pairs, each counted in the first tree that finds it, agree in how many of the
    values (kind 1: values, pairs). Pairs with a common prefix of ``done`` values in this tree
    were compared there (0: none)."""
    least = int(np.ceil(screen * TREES * DEPTH))

    def work(rows: pa.Table, bounds: list[tuple[int, int]]) -> pa.Table:
        rep, side, tree = (rows[c].to_numpy() for c in ("rep", "side", "tree"))
        s = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint32).reshape(-1, TREES * DEPTH)
        us, vs = [], []
        agree = np.zeros(TREES * DEPTH + 1, np.int64)
        for i, j in bounds:
            mid = i + int(np.searchsorted(side[i:j], 1))
            other = (mid, j) if mid < j else (i, j)
            left, right = s[i:mid], s[other[0] : other[1]]
            near = np.zeros((len(left), len(right)), bool)
            for x in range(len(left)):  # a row of pairs at once keeps the comparison in cache
                same = left[x] == right
                equal = same.sum(1)
                hit = equal >= least
                if mid == j:
                    hit[: x + 1] = False
                if hit.any() and done:
                    at = DEPTH * tree[i]
                    hit &= ~same[:, at : at + done].all(1)
                if hit.any():
                    near[x] = hit
                    met = same[hit].reshape(-1, TREES, DEPTH)
                    first = met[:, :, :depth].all(2).argmax(1) == tree[i]
                    if done:
                        first &= ~met[:, :, :done].all(2).any(1)
                    agree += np.bincount(equal[hit][first], minlength=len(agree))
            if mid == j:
                full = near | near.T
            else:
                full = np.zeros((j - i, j - i), bool)
                full[: mid - i, mid - i :] = near
                full |= full.T
            root = roots(full)
            moved = np.flatnonzero(root != np.arange(j - i))
            us.append(rep[i + moved])
            vs.append(rep[i + root[moved]])
        found = np.flatnonzero(agree)
        u = np.concatenate([*us, found]).astype(np.int64)
        v = np.concatenate([*vs, agree[found]]).astype(np.int64)
        kind = np.repeat([0, 1], [len(u) - len(found), len(found)]).astype(np.int32)
        return pa.table({"kind": kind, "u": u, "v": v})

    return work


def _recall(agree: dict[int, int], depth: int, threshold: float) -> float:
    """Chance that this depth finds a pair of the lowest band of similarity, at ``threshold``
    or above it, of which pairs were seen (at the threshold itself where none was). Estimates
    up to a standard error below the threshold count as there."""
    size = TREES * DEPTH
    slack = np.sqrt(threshold * (1 - threshold) / size)
    seen = [max(values / size, threshold) for values, pairs in agree.items() if pairs and values / size >= threshold - slack]
    least = threshold + BAND * int((min(seen) - threshold) / BAND) if seen else threshold
    return 1 - (1 - least**depth) ** TREES


def _coded(n: int):
    """Each text's shingle set as its difference from the set of its component's first text: a
    bit for each hash of that set, in their order, and the hashes that are not in it."""

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, VERIFIED):  # sets of so many texts at once
                rows = batch.slice(low, VERIFIED)
                of = rows.column(1).to_numpy()
                begin = np.flatnonzero(np.diff(of, prepend=-1))
                bases = textops.shingle_sets(rows.column(3).take(pa.array(begin)), n)
                bits, rest = [], []
                for own, k in zip(textops.shingle_sets(rows.column(2), n), np.repeat(np.arange(len(begin)), np.diff(begin, append=len(of))), strict=True):
                    at = np.searchsorted(bases[k], own)
                    has = bases[k][np.minimum(at, len(bases[k]) - 1)] == own
                    mask = np.zeros(len(bases[k]), bool)
                    mask[at[has]] = True
                    bits.append(np.packbits(mask).tobytes())
                    rest.append(own[~has].tobytes())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(bits, pa.binary()), pa.array(rest, pa.binary())], ["rep", "bits", "rest"])

    return code


def _verify(threshold: float):
    """Exact links within each unit: rep, its linked documents there, and a linked root."""

    def work(rows: pa.Table, bounds: list[tuple[int, int]]) -> pa.Table:
        rep, side, copies, component = (rows[c].to_numpy() for c in ("rep", "side", "copies", "component"))
        bits, rest = (np.array(rows[c].to_pylist(), object) for c in ("bits", "rest"))
        out_rep, out_n, out_root = [], [], []
        for i, j in bounds:
            for of in np.unique(component[i:j]):  # one, but where two units have one hash
                own = i + np.flatnonzero(component[i:j] == of)
                mid = int(np.searchsorted(side[own], 1))
                shared = _shared_bits(bits[own]) + _shared([np.frombuffer(x, np.uint64) for x in rest[own]])
                size = shared.diagonal()
                linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
                np.fill_diagonal(linked, False)
                if mid < len(own):
                    linked[:mid, :mid] = False
                    linked[mid:, mid:] = False
                # a unit of two blocks shows only links across them
                out_rep.append(rep[own])
                out_n.append(linked @ copies[own])
                out_root.append(rep[own[roots(linked)]])
        return pa.table({"rep": np.concatenate(out_rep), "n": np.concatenate(out_n).astype(np.int64), "root": np.concatenate(out_root)})

    return work


def _shared_bits(rows: Iterable[bytes]) -> np.ndarray:
    """How many bits each two rows of equal length have in common."""
    packed = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    out = np.zeros((len(rows), len(rows)))
    for low in range(0, packed.shape[1], 512):
        hot = np.unpackbits(packed[:, low : low + 512], axis=1).astype(np.float32)
        out += hot @ hot.T
    return np.rint(out).astype(np.int64)


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets have in common."""
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    new = np.cumsum(often) - 1
    use = often[inverse]
    column, owner = new[inverse[use]], owner[use]
    out = np.zeros((m, m))
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        hot = np.zeros((m, 4096), np.float32)
        hot[owner[a:b], column[a:b] - low] = 1
        out += hot @ hot.T
    np.fill_diagonal(out, [len(x) for x in sets])
    return np.rint(out).astype(np.int64)


def candidate_pairs(reps: DataFrame, threshold: float, recall: float, screen: float) -> DataFrame:
    """Edges (u, v) that span all groups of similar signatures; ``reps``: rep, signature."""
    tries = forest(reps)
    agree: dict[int, int] = {}
    edges: DataFrame | None = None
    for depth in range(START, 0, -1):
        nodes = tries.select("rep", "tree", F.expr(f"substring(branch, 1, {4 * depth})").alias("prefix"))
        met = units(nodes, ["tree", "prefix"], "rep").join(reps, "rep")
        found = stored(map_units(met, _compare(depth, 0 if depth == START else depth + 1, screen), "kind int, u long, v long"), "level")
        for r in found.where("kind = 1").groupBy("u").agg(F.sum("v").alias("pairs")).collect():  # as many as values in a signature
            agree[r["u"]] = agree.get(r["u"], 0) + r["pairs"]
        here = found.where("kind = 0").select("u", "v")
        edges = here if edges is None else edges.unionByName(here)
        if _recall(agree, depth, threshold) >= recall:
            removed(tries)
            return edges
    raise ValueError(f"{TREES} trees can't find pairs of {threshold} with a chance of {recall}")


def _linked(docs: DataFrame, n: int, threshold: float, recall: float, screen: float | None) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, h: a hash of the text, words), and for the words of which there is
    more than one row or a near copy: n_links, class_id, and h of the row (class_id, h) that
    stands for the class."""
    screen = threshold - 0.2 if screen is None else screen
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    signed = stored(ids.mapInArrow(lean(_signer(n)), "doc_id long, h long, words binary, signature binary"), "signed")
    some = signed.where("words is not null and doc_id is not null")
    copies = some.groupBy("words", "signature").agg(F.min(F.struct(F.col("doc_id").alias("first"), "h")).alias("least"), F.count("*").alias("copies"))
    copies = copies.select("words", "signature", "least.first", "least.h", "copies")
    reps = stored(copies.withColumn("rep", F.monotonically_increasing_id()), "reps")
    near = components(candidate_pairs(reps.select("rep", "signature"), threshold, recall, screen))
    near = stored(near.join(reps.select("rep", "first", "h", "copies"), F.col("node") == F.col("rep")).select("rep", "component", "first", "h", "copies"), "near")
    texts = ids.withColumnRenamed("doc_id", "first").join(small(near.select("rep", "component", "first", "h")), ["first", "h"])
    bases = stored(texts.where("rep = component").dropDuplicates(["component"]).select("component", F.col("text").alias("base")), "bases")
    sets = texts.join(bases, "component").select("rep", "component", "text", "base").mapInArrow(lean(_coded(n)), "rep long, bits binary, rest binary")
    coded = stored(sets.dropDuplicates(["rep"]), "coded")
    removed(bases)
    met = units(near.select("rep", "component", "copies"), ["component"], "rep", VERIFIED).join(coded, "rep")
    links = stored(map_units(met, _verify(threshold), "rep long, n long, root long"), "links")
    removed(coded)
    classes = components(links.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    counted = links.groupBy("rep").agg(F.sum("n").alias("n")).where("n > 0")
    members = stored(classes.join(counted, F.col("node") == F.col("rep")).join(near.select("rep", "first", "h"), "rep").select("rep", "component", "n", "first", "h"), "members")
    named = members.groupBy("component").agg(F.min(F.struct(F.col("first").alias("class_id"), F.col("h").alias("class_h"))).alias("least")).select("component", "least.*")
    classes_ = stored(named, "classes")
    placed = members.join(classes_, "component").select("rep", "n", "class_id", "class_h")
    known = reps.join(placed, "rep", "left").where("n is not null or copies > 1")
    links_ = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    known = stored(known.select("words", links_, F.coalesce("class_id", "first").alias("class_id"), F.coalesce("class_h", "h").alias("class_h")), "known")
    for old in (reps, near, links, members, classes_):
        removed(old)
    return signed, known


def _told(signed: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, h, and n_links, class_id and class_h where the row has a copy or near copy."""
    own = signed.select("doc_id", "h", F.when(F.col("doc_id").isNotNull(), F.col("words")).alias("words"))
    return own.join(small(known), "words", "left")


def ngram_jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.998, screen: float | None = None) -> DataFrame:
    """doc_id, class_id, n_links, kept for every row of ``docs`` (doc_id, text); see above."""
    told = _told(*_linked(docs, n, threshold, recall, screen))
    class_id = F.coalesce("class_id", "doc_id")
    return told.select(
        "doc_id",
        class_id.alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"),
    )


def one_of_each_class(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.998, screen: float | None = None) -> DataFrame:
    """``docs`` without the rows that another one of their class stands for: of each class one
    row of the smallest doc_id stays. A row is told by doc_id and text, so that rows of one
    doc_id with different texts are judged apart; of rows with both the least by all columns stays. Rows
    that link with nothing stay (no words, no doc_id, or no copy). Columns are kept."""
    told = stored(_told(*_linked(docs, n, threshold, recall, screen)).where("class_id is not null"), "told")
    stands = (F.col("doc_id") == F.col("class_id")) & (F.col("h") == F.col("class_h"))
    gone = stored(told.where(~stands).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct(), "gone")
    again = stored(told.where(stands).groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).count().where("count > 1").drop("count"), "again")
    rows = docs.select(*carried(docs))
    same = (F.col(name_of(docs, "doc_id")).cast("long") == F.col("_id")) & (F.xxhash64(name_of(docs, "text")) == F.col("_h"))
    left = rows.join(small(gone), same, "left_anti")
    if again.count():
        # the least by all columns, so that a task that runs again keeps the same row
        of_one = left.join(small(again), same).groupBy(name_of(docs, "doc_id"), name_of(docs, "text")).agg(F.min_by(F.struct(*left.columns), F.to_json(F.struct(*left.columns))).alias("row"))
        repeated = of_one.select("row.*")
        left = left.join(small(again), same, "left_anti").unionByName(repeated)
    return restored(left, docs)
