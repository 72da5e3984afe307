"""Vector helpers (F9 golden_relevance, O3 best_label) as Catalyst HOFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let

def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 when either vector has zero norm."""
    return normed_cosine(a, norm(a), b, norm(b))


def normed_cosine(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """Cosine similarity with both norms at hand."""
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def best_match(target: Column, target_norm: Column, golden: Column) -> Column:
    """STRUCT<score DOUBLE, label STRING>: first strictly-best cosine.

    Starts from -1.0 and replaces only on a strictly greater score, so ties
    keep the lowest index and an all -1.0 golden set yields a null label.
    """
    init = F.struct(F.lit(-1.0).alias("score"), F.lit(None).cast("string").alias("label"))

    def step(acc, g):
        return let(normed_cosine(g["vec"], g["norm"], target, target_norm), lambda s: F.when(
            s > acc["score"], F.struct(s.alias("score"), g["label"].alias("label"))).otherwise(acc))

    return F.aggregate(golden, init, step)
