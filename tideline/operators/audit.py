"""Feature-timing audit: change what a feature must not see, rebuild, compare.

A *builder* maps a panel to a table with the same keys and one column for each feature.
Test A cuts the future off, test B changes the row itself, test C rewrites labels from a
day on, test D rewrites labels everywhere. A feature passes where no row differs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import differs
from ..sources.scratch import written

Builder = Callable[[DataFrame], DataFrame]


def compare(base: DataFrame, other: DataFrame, keys: Sequence[str], columns: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """(column_name, n_compared, n_diff) over the keys that both have; exact, nulls equal. With
    ``within`` (columns that a row's keys determine, such as entity and season) rows are joined only where
    the digests of their groups differ; the others count as compared."""
    equal = None
    if within:
        equal, base, other = _differing(base, other, keys, columns, within)
    right = other.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    both = base.select(*keys, *columns).join(right, list(keys))
    diffs = both.agg(F.count("*").alias("_n"), *(F.coalesce(F.sum(differs(F.col(c), F.col(f"_{c}")).cast("long")), F.lit(0)).alias(c) for c in columns))
    if equal is not None:
        diffs = diffs.join(F.broadcast(equal)).withColumn("_n", F.col("_n") + F.col("_equal"))  # one row each
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("_n").alias("n_compared"), F.col(c).alias("n_diff")) for c in columns))
    return diffs.select(F.explode(rows).alias("_r")).select("_r.*")


def digests(df: DataFrame, keys: Sequence[str], columns: Sequence[str], within: Sequence[str]) -> DataFrame:
    """A row for each group of ``within``: how many rows it has and a digest of their keys and columns in any order. Two
    sums of different hashes, so that what cancels in one shows in the other."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    row = [cell(c) for c in (*keys, *columns)]
    h, h2 = F.xxhash64(*row), F.xxhash64(F.lit(2), *reversed(row))
    low = lambda x: x.bitwiseAND(F.lit((1 << 20) - 1))  # noqa: E731  sums stay within 64 bits for 2^43 rows
    return df.groupBy(*within).agg(F.count("*").alias("_rows"), F.bit_xor(h).alias("_x"), F.sum(low(h)).alias("_s"), F.bit_xor(h2).alias("_x2"), F.sum(low(h2)).alias("_s2"))


def _differing(base: DataFrame, other: DataFrame, keys: Sequence[str], columns: Sequence[str], within: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How many rows lie in groups of equal digests (one row), and both tables without these groups. Digests
    are written once: a row for each group."""
    mine, theirs = (digests(x, keys, columns, within) for x in (base, other))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*within, "_rows", "_x", "_s", "_x2", "_s2")]
    met = same[0]
    for c in same[1:]:
        met = met & c
    equal = written(mine.alias("a").join(theirs.alias("b"), met).select("a.*"), "equal_digests").select(*(F.col(c).alias(f"_g_{c}") for c in within), "_rows")

    def rest(df: DataFrame) -> DataFrame:
        on = F.lit(True)
        for c in within:
            on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        return df.join(equal, on, "left_anti")

    return equal.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("_equal")), rest(base), rest(other)


def future_truncation(builder: Builder, panel: DataFrame, day: str, keys: Sequence[str], columns: Sequence[str], cutoffs: DataFrame, entity: str) -> DataFrame:
    """Test A for all ``cutoffs`` (cutoff: date) in one job: the panel is copied once for each
    cutoff without what follows it, and the cutoff becomes part of the entity, so that one
    rebuild serves all. Rows before a cutoff must not change."""
    copies = panel.join(F.broadcast(cutoffs), F.col(day) < F.col("cutoff"))
    own = F.concat_ws("|", F.col("cutoff").cast("string"), F.col(entity).cast("string"))
    rebuilt = builder(copies.withColumn(entity, own).drop("cutoff"))
    parts = F.split(entity, r"\|", 2)
    rebuilt = rebuilt.withColumn("cutoff", parts[0].cast("date")).withColumn(entity, parts[1].cast(panel.schema[entity].dataType))
    base = builder(panel).select(*keys, *columns)
    got = rebuilt.select("cutoff", *keys, *(F.col(c).alias(f"_{c}") for c in columns))
    both = got.join(base, list(keys))
    agg = both.groupBy("cutoff").agg(F.count("*").alias("_n"), *(F.sum(differs(F.col(c), F.col(f"_{c}")).cast("long")).alias(c) for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("_n").alias("n_compared"), F.col(c).alias("n_diff")) for c in columns))
    return agg.select("cutoff", F.explode(rows).alias("_r")).select("cutoff", "_r.*")


def one_row_per_entity(panel: DataFrame, entity: str, key: str, seed: int, eligible=None) -> DataFrame:
    """``panel`` with ``hit``: true on one row of each entity, drawn by md5 among eligible ones."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(entity).cast("string"), F.col(key).cast("string")))
    ok = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    place = F.row_number().over(W.partitionBy(entity).orderBy(F.when(ok, 0).otherwise(1), h))
    return panel.withColumn("hit", (place == 1) & ok)


def same_row_perturbation(builder: Builder, panel: DataFrame, change: dict, keys: Sequence[str], columns: Sequence[str], entity: str, key: str, seed: int = 1) -> DataFrame:
    """Test B: ``change`` (column: new expression) is applied to one row of each entity, and
    only these rows are compared; a feature that reads its own row differs."""
    marked = one_row_per_entity(panel, entity, key, seed)
    moved = marked.select(*(F.when(F.col("hit"), change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in panel.columns))
    hits = marked.where("hit").select(*keys)
    return compare(builder(panel).join(hits, list(keys), "left_semi"), builder(moved), keys, columns)


def label_rewrite(build: Callable[[DataFrame], DataFrame], labels: DataFrame, rewritten: DataFrame, keys: Sequence[str], columns: Sequence[str], before=None, within: Sequence[str] = ()) -> DataFrame:
    """Tests C and D: ``build`` goes from label records to features. With ``before`` (a
    condition on the keys) only rows ahead of the rewritten labels are compared; ``within`` as in ``compare``."""
    base, other = build(labels), build(rewritten)
    if before is not None:
        base, other = base.where(before), other.where(before)
    return compare(base, other, keys, columns, within)


def adjudicated(results: DataFrame, must_fail: Sequence[str] = ()) -> DataFrame:
    """From (test, column_name, n_compared, n_diff): tests failed by column and the verdict.
    A column that must fail passes this control where it did."""
    g = results.groupBy("column_name").agg(F.count(F.when(F.col("n_diff") > 0, 1)).alias("failed"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("n_diff") > 0, F.col("test")))), ",").alias("tests"))
    expected = F.col("column_name").isin(*must_fail) if must_fail else F.lit(False)
    return g.withColumn("verdict", F.when(expected, F.when(F.col("failed") > 0, "caught").otherwise("missed")).otherwise(F.when(F.col("failed") > 0, "leak").otherwise("clean")))
