"""Text rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str = "none") -> Column:
    """The label of the first of ``rules`` (label, pattern) that is found in ``text``."""
    out = None
    for label, pattern in rules:
        hit = text.rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def strict_category(site: Column, kind: Column, pattern: str, sites: Sequence[str], mapped: Sequence[str]) -> Column:
    """True where the descriptor matches, or where the site does and no mapped category
    outranks it."""
    by_kind = F.coalesce(kind.rlike(pattern), F.lit(False))
    by_site = F.coalesce(F.lower(F.trim(site)).isin(*sites), F.lit(False))
    return by_kind | (by_site & ~F.coalesce(kind.isin(*mapped), F.lit(False)))


def strip_prefix(text: Column, prefixes: Sequence[str]) -> Column:
    return F.regexp_replace(text, f"^({'|'.join(prefixes)}) ", "")


def name_variants(name: Column) -> Column:
    """Ranked spellings of a name: as it is, after a bracket, without dots, parts of ``a / b``."""
    after = F.trim(F.regexp_replace(name, r"^.*\)", ""))
    parts = F.transform(F.split(name, " / "), lambda p: F.struct(F.lit(4).alias("rank"), F.trim(p).alias("text")))
    own = [F.struct(F.lit(k).alias("rank"), x.alias("text")) for k, x in ((1, F.trim(name)), (2, after), (3, F.replace(F.trim(name), F.lit("."), F.lit(""))))]
    return F.concat(F.array(*own), parts)
