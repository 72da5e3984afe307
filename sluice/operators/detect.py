"""Phrase and regex detection: F3 blocklist_match, F4 pattern_match,
J4 terms_theta, J5 patterns_theta, O1 sorted_hits.

Rules arrive in one of two shapes:

* literal Python lists (one rule set for the whole batch): terms become a
  constant array folded into the plan, each regex one literal ``rlike`` so
  Java compiles it once per task;
* per-row array columns produced by the policy join (J1): terms through
  higher-order functions, patterns through programs compiled once per list.

Term tables of any length (J4, and F3 over a table) are in ``termjoin``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import first_pattern_of
from ..functions.rules import java_regex, term_entries
from ..functions.text import casefold
from .termjoin import term_hits, with_term_hits  # noqa: F401  (J4 and F3 over term tables)

TERM_TYPE = "array<struct<term:string,key:string>>"


def terms_literal(terms) -> Column:
    entries = term_entries(terms)
    if not entries:
        return F.array().cast(TERM_TYPE)
    return F.array(*[F.struct(F.lit(t).alias("term"), F.lit(k).alias("key")) for t, k in entries])


def blocklist_hits(key: Column, terms: Column) -> Column:
    """Sorted distinct original spellings whose casefold key occurs in ``key``."""
    found = F.filter(terms, lambda t: F.instr(key, t["key"]) > 0)
    return F.array_sort(F.array_distinct(F.transform(found, lambda t: t["term"])))


def hits_detail(hits: Column, prefix: str) -> Column:
    """O1: first five sorted hits joined, after a fixed prefix."""
    return F.concat(F.lit(prefix), F.array_join(F.slice(hits, 1, 5), ", "))


def first_pattern_literal(text: Column, patterns) -> Column:
    """First pattern in list order with a case-insensitive search hit."""
    pats = [p for p in patterns]
    if not pats:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(text.rlike(java_regex(p)), F.lit(p)) for p in pats])


def first_pattern_column(text: Column, patterns: Column) -> Column:
    """Same, with a per-row ARRAY<STRING> of patterns (policy join form): each
    distinct list is compiled once per worker (see ``functions.patterns``)."""
    some = F.size(patterns) > 0
    return first_pattern_of(F.when(some, text), F.when(some, patterns))


def pattern_ranks_literal(text: Column, patterns) -> Column:
    """ARRAY<STRUCT<rank,pattern>> of every matching pattern (J5 packed form)."""
    items = [
        F.when(text.rlike(java_regex(p)), F.struct(F.lit(i).alias("rank"), F.lit(p).alias("pattern")))
        for i, p in enumerate(patterns)
    ]
    if not items:
        return F.array().cast("array<struct<rank:int,pattern:string>>")
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def casefold_terms(df: DataFrame, term_col: str = "term") -> DataFrame:
    return df.withColumn("key", casefold(F.col(term_col)))
