"""Match positions and running sums inside one row, in Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(x: Column) -> Column:
    """Inclusive running sums of an array of numbers.

    Blocks of the square root of its size keep it at n^1.5 steps, where a
    fold that appends to its result copies n^2 elements.
    """
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, v: s + v)

    def in_blocks(a):
        n = F.size(a)
        return let(F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1)), lambda b: let(
            F.transform(F.sequence(F.lit(0), F.floor((n - 1) / b).cast("int")), lambda i: F.slice(a, i * b + 1, b)),
            lambda blocks: let(F.transform(blocks, total), lambda sums: F.flatten(F.transform(
                blocks, lambda blk, i: let(total(F.slice(sums, F.lit(1), i)), lambda before: F.transform(
                    blk, lambda _, j: before + total(F.slice(blk, F.lit(1), j + 1)))))))))

    return let(x, lambda a: F.when(F.size(a) > 0, in_blocks(a)).otherwise(F.array().cast("array<bigint>")))


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start int, end int>> of a Java pattern's matches, in code
    points.  Texts without a match cost one scan; the others a second, for
    the gaps between matches."""
    nothing = F.array().cast("array<struct<start:int,end:int>>")

    def spans(hits):
        gaps = F.transform(F.split(text, pattern, -1), F.char_length)
        steps = lambda g: F.transform(F.arrays_zip(
            F.slice(g, F.lit(1), F.size(hits)).alias("gap"),
            F.concat(F.array(F.lit(0)), F.slice(F.transform(hits, F.char_length), F.lit(1), F.size(hits) - 1)).alias("last"),
        ), lambda s: (s["gap"] + s["last"]).cast("bigint"))
        return F.zip_with(prefix_sums(let(gaps, steps)), hits, lambda s, m: F.struct(
            s.cast("int").alias("start"), (s + F.char_length(m)).cast("int").alias("end")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
               lambda hits: F.when(F.size(hits) > 0, spans(hits)).otherwise(nothing))
