"""A training corpus from ``documents``: each stage reads what its predecessor wrote.

For all stages: rows with nulls in any column, empty or very long texts and repeated rows go
through; an empty table gives an empty table; further columns pass unchanged, whatever their
names. What a stage does with each of these is said at the stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.llm.ngram_join import one_of_each_class
from tideline.llm.packing import pack
from tideline.llm.raking import sampled
from tideline.llm.secret_scan import without_secrets
from tideline.llm.store import stored
from tideline.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go: those that score 0.3 or more, a tie included.
    Null and empty texts score the share of toxic rows among the labelled ones; without labels
    all stay. Equal texts share their fate, so repeated rows go or stay together."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: a row of the smallest doc_id, one of
    several equal ones. Null and empty texts and rows without doc_id stay; rows of one doc_id
    with different texts are judged apart."""
    return one_of_each_class(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, overlapping ones as one; every row stays, repeated ones too. Null texts
    stay null, empty ones empty; n_chars follows a text that was changed."""
    return without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with raked source, language and topic weights. Null source or language and texts
    without words are values of their own; equal rows are kept or left together; a row whose
    chance ties with its probability is left."""
    return sampled(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 1024 tokens. A null or empty text is one id; a very long one many
    pieces; repeated rows are packed each for itself."""
    return pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", mask_secrets),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Models, signatures and token ids are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; between stages the rows are written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
