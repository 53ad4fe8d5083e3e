"""Linking dated events to panel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import is_true


def known_entities(panel: DataFrame, events: DataFrame, entity: str) -> DataFrame:
    """Panel rows of entities that have an event at all: keeps the interval join small."""
    return panel.join(events.select(entity).distinct(), entity, "left_semi")


def within_days(panel: DataFrame, events: DataFrame, entity: str, day: str, event_day: str, low: int = 1, high: int = 3) -> DataFrame:
    """Pairs of a row and an event ``low`` to ``high`` calendar days after it, with ``gap``.

    Each event is copied to the days that may hold its rows, which makes the range condition
    an equality on (entity, day): a hash join however long a history is."""
    candidates = events.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("gap")).withColumn("_day", F.date_sub(event_day, F.col("gap")))
    return panel.join(candidates.withColumnRenamed(entity, "_entity"), (F.col(entity) == F.col("_entity")) & (F.col(day) == F.col("_day"))).drop("_entity", "_day")


def nearest(pairs: DataFrame, row: list[str], order: list) -> DataFrame:
    """The first event of each row by ``order``."""
    return pairs.withColumn("_rank", F.row_number().over(W.partitionBy(*row).orderBy(*order))).where("_rank = 1").drop("_rank")


def attach(panel: DataFrame, linked: DataFrame, row: list[str]) -> DataFrame:
    """Every panel row once, with the columns of its linked event or null."""
    return panel.join(linked, row, "left")


def index_rows(linked: DataFrame, event: list[str], order: list) -> Column:
    """True for the one row that stands for an event: first by ``order``."""
    return is_true(F.row_number().over(W.partitionBy(*event).orderBy(*order)) == 1) & F.col(event[-1]).isNotNull()
