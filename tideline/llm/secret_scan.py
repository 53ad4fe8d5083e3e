"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text (the blob). The ledger, a
table in shared storage, holds for each blob and rule version scanned so far the spans found. A
run scans only pairs of blob and rule version that the ledger lacks, appends them, and joins
spans back to all paths that hold or held the blob. The rule version is a hash of the rules
themselves, so that a changed rule scans everything again.

A span is (kind, first, past): code points, end exclusive. Spans of a kind are leftmost and
do not overlap: the pieces between a pattern's matches (``split``) and the matches
themselves give the places by running sums. Folds go over blocks of ``BLOCK`` elements, so
that the work grows with a text's length and spans, not with their square.

Results: one row per row of the input. Text that is null counts as empty, and both have no
spans; a text of any length is scanned whole. Of spans with one start, the kind listed first
comes first. Repeated rows and rows without path are kept as they are; copies of a text, however
many, are one blob and scanned once. An empty table gives an empty result. Columns other than
those named pass through unread, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import carried, name_of, restored, shared_folder, small, stored

#: Kind, pattern, least length, and of which group. The two last patterns ask
#: for the least length themselves, which finds the same spans.
PATTERNS = [
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0),
    ("hex", r"[0-9a-f]{32,}", 0),
]

SPANS = "array<struct<start:int,rank:int,kind:string,past:int>>"
LEDGER = f"blob string, rules string, spans {SPANS}"
BLOCK = 64
BROADCAST_BLOBS = 500_000
BROADCAST_SPANS = 500_000


def rules_version(patterns: list[tuple] = PATTERNS) -> str:
    return hashlib.sha256(json.dumps(patterns).encode()).hexdigest()[:16]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(items: Column) -> Column:
    """``items`` (a column or bound name) in arrays of ``BLOCK``; one empty array if there are none."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int") + F.when(F.size(items) == 0, 1).otherwise(0)), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def _running(lengths: Column) -> Column:
    """Running sums of an array of int."""

    def step(acc: Column, block: Column) -> Column:
        sums = F.aggregate(block, F.array(acc["base"]), lambda out, n: F.array_append(out, F.element_at(out, -1) + n))
        return _let(sums, lambda x: F.struct(F.element_at(x, -1).alias("base"), F.array_append(acc["out"], F.slice(x, 2, F.lit(BLOCK))).alias("out")))

    start = F.struct(F.lit(0).alias("base"), F.array().cast("array<array<int>>").alias("out"))
    return _let(lengths, lambda n: F.aggregate(_blocks(n), start, step, lambda acc: F.flatten(acc["out"])))


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if group else found
    hits = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.transform(found, F.length).alias("hit"), F.transform(value, F.length).alias("value"))

    def placed(x: Column) -> Column:
        ends = _running(F.transform(x, lambda h: F.length(h["gap"]) + h["hit"]))
        rows = F.zip_with(x, ends, lambda h, end: F.struct(h["value"].alias("value"), (end - h["hit"]).alias("start"), end.alias("past")))
        return F.transform(
            F.filter(rows, lambda r: r["value"] >= max(group, 1)),
            lambda r: F.struct(r["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), r["past"].alias("past")),
        )

    scanned = _let(hits, lambda h: _let(F.slice(h, 1, F.size(h) - 1), placed))  # the last gap has no match after it
    return F.when(text.rlike(pattern), scanned).otherwise(F.array().cast(SPANS))


def scan(blobs: DataFrame) -> DataFrame:
    """blob, rules, spans for each row of ``blobs`` (blob, text)."""
    parts = [_spans(F.col("text"), i, *rule) for i, rule in enumerate(PATTERNS)]
    return blobs.select("blob", F.lit(rules_version()).alias("rules"), F.array_sort(F.concat(*parts)).cast(SPANS).alias("spans"))


def _blob(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)


def ledger_update(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """What has to be appended to ``ledger`` (blob, rules, spans) for ``versions`` (path,
    version, text): one scanned row for each blob that it lacks under this rule version."""
    blobs = versions.select(_blob("text").alias("blob"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if ledger is not None:
        blobs = blobs.join(small(ledger.where(F.col("rules") == rules_version()).select("blob"), BROADCAST_BLOBS), "blob", "left_anti")
    return scan(blobs.distinct())  # equal blobs have equal texts


def recorded(versions: DataFrame, path: str) -> DataFrame:
    """The ledger at ``path``, after the blobs of ``versions`` that it lacked were scanned and
    appended. A run that fails before the append leaves it as it was."""
    spark = versions.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = place.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(place)
    ledger = spark.read.schema(LEDGER).parquet(path) if known else None
    ledger_update(versions, ledger).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def entries(ledger: DataFrame) -> DataFrame:
    """(blob, spans) under this rule version, one row for each blob: two runs at a time may both have appended
    one. Written out, so that the join with very many paths of a blob is one of plain scans."""
    known = ledger.where(F.col("rules") == rules_version()).groupBy(F.col("blob").alias("_known"))
    return stored(known.agg(F.first("spans").alias("_spans")), "entries")  # equal blobs have equal spans


def new_ledger(versions: DataFrame) -> str:
    """Where a ledger of its own may lie, for a run that has none to go on from."""
    return f"{shared_folder(versions.sparkSession)}/ledger-{uuid4().hex}"


def findings(versions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Columns of ``versions`` but text, with blob and spans, for every version of every path. Columns of
    these two names give way. A blob that very many paths hold is a skewed key of a join of two scans, which Spark splits."""
    addressed = versions.select(*carried(versions), _blob("text").alias("_blob"))
    told = addressed.join(entries(ledger), F.col("_blob") == F.col("_known"), "left")
    own = [F.col(name_of(versions, c)).alias(c) for c in versions.columns if c not in ("text", "blob", "spans")]
    return told.select(*own, F.col("_blob").alias("blob"), F.col("_spans").alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["past"])), ",")


def secret_report(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Each document as one version of its path, against the ledger at ``ledger`` (a new one by
    default): counts by kind, the digest and the spans."""
    versions = docs.select("doc_id", "text")
    told = findings(versions, recorded(versions, ledger or new_ledger(docs)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = joined(F.col("spans"))
    return told.select("doc_id", *(count(kind) for kind, *_ in PATTERNS), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with ``spans`` (in order of start) replaced; overlapping ones as one."""

    def one(origin: Column, rest: Column):
        def step(acc: Column, s: Column) -> Column:
            fresh = F.concat(acc["out"], F.substring(rest, acc["at"] - origin + 1, s["start"] - acc["at"]), F.lit(mask))
            return F.struct(F.greatest(acc["at"], s["past"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

        return step

    def block(acc: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(acc["at"].alias("at"), F.lit("").alias("out")), one(acc["at"], acc["rest"]))
        return _let(
            done,
            lambda d: F.struct(
                d["at"].alias("at"), F.substring(acc["rest"], d["at"] - acc["at"] + 1, F.length(acc["rest"])).alias("rest"), F.array_append(acc["out"], d["out"]).alias("out")
            ),
        )

    start = F.struct(F.lit(0).alias("at"), text.alias("rest"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(_blocks(spans), start, block, lambda acc: F.concat(F.array_join(acc["out"], ""), acc["rest"]))


def without_secrets(docs: DataFrame, mask: str = "[secret]", ledger: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``mask``; overlapping spans are replaced as one.
    Other rows and columns stay as they are; n_chars follows the text where it is there."""
    found = entries(recorded(docs.select("text"), ledger or new_ledger(docs)).where(F.size("spans") > 0))
    text, own = F.col(name_of(docs, "text")), carried(docs)
    size = found.agg(F.count("*") + F.coalesce(F.sum(F.size("_spans")), F.lit(0))).first()[0]
    found = F.broadcast(found) if size <= BROADCAST_SPANS else found
    told = docs.select(*own, _blob("text").alias("_blob")).join(found, F.col("_blob") == F.col("_known"), "left")
    has = F.size("_spans") > 0
    changed = told.withColumn(name_of(docs, "text"), F.when(has, masked(text, F.col("_spans"), mask)).otherwise(text))
    if "n_chars" in docs.columns:
        chars = name_of(docs, "n_chars")
        changed = changed.withColumn(chars, F.when(has, F.length(text)).otherwise(F.col(chars)).cast(docs.schema["n_chars"].dataType))
    return restored(changed, docs)
