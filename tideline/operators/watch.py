"""Counts that are taken while a plan runs, without a job of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Watch:
    """Named counts of rows at places of a plan. They are there once an action on a DataFrame above
    these places has ended; an action that reads fewer rows (``limit``) counts fewer. Each place belongs to one plan."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def rows(self, df: DataFrame, name: str, **conditions: Column) -> DataFrame:
        """``df``, whose rows are counted as ``name``, and as ``name.condition`` those that meet a condition."""
        if name in self._seen:
            raise ValueError(f"{name} is counted already")
        self._seen[name] = seen = Observation()
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count(F.when(c, 1)).alias(k) for k, c in conditions.items()))

    def filtered(self, df: DataFrame, name: str, condition: Column) -> DataFrame:
        """The rows that meet ``condition``; ``name.kept`` and ``name.dropped`` tell how many did and did not (null: dropped)."""
        keep = F.coalesce(condition, F.lit(False))
        return self.rows(df, name, kept=keep, dropped=~keep).where(keep)

    def counts(self) -> dict[str, int]:
        """All counts of the plan that has run."""
        out = {}
        for name, seen in self._seen.items():
            for k, v in seen.get.items():
                out[name if k == "rows" else f"{name}.{k}"] = v
        return out

    def same(self, before: str, after: str) -> None:
        """ValueError unless as many rows were counted at both places."""
        n = self.counts()
        if n[before] != n[after]:
            raise ValueError(f"{before} has {n[before]} rows, {after} has {n[after]}")


def attach_counted(rows: DataFrame, more: DataFrame, keys: list[str], watch: Watch, name: str = "attach") -> DataFrame:
    """``rows`` with what ``more`` has by key; after an action, ``watch.same(f"{name}.before", f"{name}.after")``
    holds that no row was lost or repeated."""
    joined = watch.rows(rows, f"{name}.before").join(more, keys, "left")
    return watch.rows(joined, f"{name}.after")
