"""Exact duplicates: a tree merge of sorted digest runs.

Texts are compared without white space (the six characters of ``SPACE``). Each document is a
digest of 64 bits, by which runs are sorted, and a witness (SHA-256 and length of what is left of
the text), by which each merge verifies that two entries of one digest are one text; entries whose
witnesses differ stay apart. The partitions that read the table form one run each, with one entry
for each text: the best row (most code points, then smallest doc_id) and how many rows it stands for. Then, in
rounds, ``FAN`` partitions at a time exchange their runs: each sends every other its part of the
digest range, and what arrives is merged in order. A run of w first partitions lies in
``PIECES`` x w ranges, so that pieces stay as large as they were while runs get fewer. In the last
run each text has one entry, which the documents' digests look up.

A text with very many copies is one entry in each run from the start: no merge gets more
than ``FAN`` entries of one text. The final lookup joins two written tables, which Spark splits
where one text has very many rows. Texts are read once; only digests travel.

Results: one row per row: doc_id, keep_id (doc_id of the row that stays), group_size, kept,
text_sha256 (lowercase hex, of the text without white space in UTF-8). A null text is an empty one;
empty texts and those of white space only are equal. Of rows that tie in length, one without
doc_id comes last; of rows that tie in doc_id too, exactly one stays. Texts of any length are
read whole. An empty table gives an empty result. Columns other than doc_id and text are not
read, and pass through ``one_of_each_text`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import carried, name_of, removed, restored, stored

SPACE = " \t\n\x0b\f\r"
FAN = 16  # runs that are merged at once
PIECES = 8  # ranges of a run, for each partition that it stems from
KEY = ["digest", "sha", "n_left"]


def _digests(docs: DataFrame) -> DataFrame:
    """Digest, witness, length and first run of every row of ``docs`` (doc_id, text, place)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "place", F.length(text).alias("n_chars"), F.translate(text, SPACE, "").alias("_left"))
    witness = [F.unhex(F.sha2("_left", 256)).alias("sha"), F.length("_left").alias("n_left")]
    return rows.select("doc_id", "place", "n_chars", F.xxhash64("_left").alias("digest"), *witness, F.spark_partition_id().alias("run"))


def _merged(entries: DataFrame) -> DataFrame:
    """One entry for each text of a run: the best of its rows and their number."""
    return entries.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("size").alias("size"))


def _exchanged(runs: DataFrame, pieces: int) -> DataFrame:
    """``FAN`` runs become one: its pieces are digest ranges, each in order in one partition."""
    bits = max(1, (pieces - 1).bit_length())
    piece = F.shiftrightunsigned("digest", 64 - bits)
    moved = runs.withColumn("run", F.expr(f"run div {FAN}")).withColumn("piece", piece)
    return _merged(moved.repartition("run", "piece").sortWithinPartitions("run", *KEY))


def tree_merged(digests: DataFrame) -> DataFrame:
    """The last run: (digest, witness, best, size) for each text of a written table of digests."""
    best = F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "place")
    runs = _merged(digests.select("run", *KEY, best.alias("best"), F.lit(1).cast("long").alias("size")))
    count, width = (digests.agg(F.max("run")).first()[0] or 0) + 1, 1
    while count > width:
        width *= FAN
        runs = _exchanged(runs, PIECES * min(width, count))
    return runs.select(*KEY, "best", "size")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("place"))
    digests = stored(_digests(rows), "digests")
    last = stored(tree_merged(digests), "last_run")
    kept = F.col("best.place") == F.col("place")
    own = [F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")]
    return digests.join(last, KEY).select("doc_id", *own)


def one_of_each_text(docs: DataFrame) -> DataFrame:
    """``docs`` with the row that stays of each text; all columns, whatever their names."""
    rows = stored(docs.select(*carried(docs), F.monotonically_increasing_id().alias("place")), "rows")
    own = rows.select(F.col(name_of(docs, "doc_id")).alias("doc_id"), F.col(name_of(docs, "text")).cast("string").alias("text"), "place")
    digests = stored(_digests(own), "digests")
    last = stored(tree_merged(digests).select(F.col("best.place").alias("place")), "last_run")
    removed(digests)
    return restored(rows.join(last, "place", "left_semi"), docs)
