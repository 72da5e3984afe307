"""J4 / F3 for term tables of any length: which terms occur in which texts.

Terms and texts are compared as UTF-8 bytes (containment is the same there).
A term's grams are its GRAM-byte strings, or the whole term if it is shorter.

1. One narrow pass counts, for each gram that any term has, the texts that
   hold it.
2. Each term's anchor is its rarest gram.  A term with a gram that no text
   holds can't occur and goes: terms that don't occur cost no work on the texts.
3. A second narrow pass looks up the anchors among a text's grams and tests
   the terms of those it holds.

The known grams of step 1 and the terms left for step 3 travel to the tasks
only up to KNOWN grams and HELD bytes, which is looked up first.  Beyond that,
texts and grams meet in equi-joins instead: the grams of a text, exploded, with
the term grams (a semi-join, then counts) and with the anchors, and the candidate
pairs with the texts, where the exact test is the join's condition.

Up to FEW terms skip step 1 and take any of their grams; the result is the same.

Defined cases: null texts hold nothing; blank terms are no terms; terms that
repeat count once; rows that repeat an id are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM = 4
#: Most grams, and most bytes of terms, that travel to the tasks.
KNOWN, HELD = 1 << 20, 16 << 20
#: Terms up to which any gram will do as an anchor: counting would cost a pass
#: over the texts, and testing so few terms costs little.
FEW = 256
#: Texts looked at in one go.
ROWS = 256


def grams(data: bytes, sizes) -> np.ndarray:
    """Distinct byte strings of the given sizes as numbers that tell the size."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    out = [np.zeros(0, np.int64)]
    for n in sizes:
        if len(b) >= n:
            g = np.full(len(b) - n + 1, n, np.int64)
            for i in range(n):
                g = (g << 8) | b[i : len(b) - n + 1 + i]
            out.append(g)
    return np.unique(np.concatenate(out))


def _of_term(key: bytes) -> np.ndarray:
    return grams(key, (min(len(key), GRAM),))


def term_grams(terms: DataFrame) -> DataFrame:
    """(term, key, gram) of every gram of every term."""

    def batches(parts):
        for p in parts:
            got = [_of_term(k.encode()) for k in p.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([p.column("term"), p.column("key"), pa.array(got, pa.list_(pa.int64()))], ["term", "key", "g"])

    some = terms.where(F.length(F.trim("key")) > 0).select("term", "key").distinct()
    return some.mapInArrow(batches, "term string, key string, g array<bigint>").select("term", "key", F.explode("g").alias("gram"))


def _found(known: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Places in the sorted ``known`` of those of ``g`` that are in it."""
    if not len(known):
        return np.zeros(0, np.int64)
    at = np.searchsorted(known, g)
    at = np.minimum(at, len(known) - 1)
    return at[known[at] == g]


def _exploded(docs: DataFrame, ids: list[str], key: str, sizes) -> DataFrame:
    """(ids, _h, gram): the distinct grams of every text; ``_h`` tells texts
    under one id apart."""
    at = len(ids) + 1

    def batches(parts):
        for p in parts:
            for lo in range(0, p.num_rows, ROWS):
                q = p.slice(lo, ROWS)
                got = [grams((t.as_py() or "").encode(), sizes) for t in q.column(at)]
                yield pa.RecordBatch.from_arrays([*(q.column(i) for i in range(at)), pa.array(got, pa.list_(pa.int64()))], [*ids, "_h", "g"])

    some = docs.select(*ids, F.xxhash64(key).alias("_h"), F.col(key).alias("_key"))
    schema = T.StructType([*some.schema.fields[:at], T.StructField("g", T.ArrayType(T.LongType()))])
    return some.mapInArrow(batches, schema).select(*ids, "_h", F.explode("g").alias("gram"))


def gram_counts(docs: DataFrame, key: str, wanted: DataFrame, sizes, known: int) -> DataFrame:
    """(gram, c): texts that hold each gram of ``wanted`` (gram, distinct)."""
    if wanted.limit(known + 1).count() > known:
        return _exploded(docs.select(F.col(key).alias("_key")), [], "_key", sizes).join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    table = np.sort(np.array([r.gram for r in wanted.collect()], np.int64))

    def batches(parts):
        n = np.zeros(len(table), np.int64)
        for p in parts:
            for t in p.column(0):
                n[_found(table, grams((t.as_py() or "").encode(), sizes))] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(table[some]), pa.array(n[some])], ["gram", "c"])

    return docs.select(F.col(key).alias("_key")).mapInArrow(batches, "gram bigint, c bigint").groupBy("gram").agg(F.sum("c").alias("c"))


def anchored(docs: DataFrame, key: str, terms: DataFrame, known: int = KNOWN) -> tuple[DataFrame, list[int]]:
    """(term, key, gram) of the terms that can occur, ``gram`` being the anchor;
    and the gram sizes there are."""
    from ..session import materialize

    rows = materialize(term_grams(terms), "term-grams")
    # a gram's size is its highest byte
    size = lambda c: F.when(c < 1 << 16, 1).when(c < 1 << 24, 2).when(c < 1 << 32, 3).otherwise(4)
    sizes = sorted(r[0] for r in rows.select(size(F.col("gram"))).distinct().collect())
    if rows.select("term", "key").distinct().limit(FEW + 1).count() <= FEW:
        few = rows.groupBy("term", "key").agg(F.min_by("gram", F.xxhash64("gram")).alias("gram"))
        return materialize(few, "term-anchors"), sizes
    counts = gram_counts(docs, key, rows.select("gram").distinct(), sizes, known)
    held = rows.join(counts, "gram", "left").groupBy("term", "key").agg(
        F.min_by("gram", F.struct("c", "gram")).alias("gram"), F.min(F.coalesce("c", F.lit(0))).alias("least"))
    return materialize(held.where("least > 0").select("term", "key", "gram"), "term-anchors"), sizes


def with_term_hits(docs: DataFrame, ids: list[str], key: str, terms: DataFrame, known: int = KNOWN, held: int = HELD) -> DataFrame:
    """(ids, hits): for every row of ``docs`` the sorted distinct terms of
    ``terms`` (term, key) whose key occurs in it."""
    anchors, sizes = anchored(docs, key, terms, known)
    size = anchors.agg(F.sum(F.octet_length("term") + F.octet_length("key") + 64)).first()[0] or 0
    rows = docs.select(*ids, F.col(key).alias("_key"))
    if size > held:
        found = _candidates(docs, ids, key, anchors, sizes)
        hits = found.groupBy(*ids, "_h").agg(F.array_sort(F.collect_set("term")).alias("hits"))
        back = rows.select(*ids, F.xxhash64("_key").alias("_h"))
        same = F.lit(True)
        for c in (*ids, "_h"):
            same &= back[c].eqNullSafe(hits[c])
        return back.join(hits, same, "left").select(*(back[c] for c in ids), F.coalesce(hits["hits"], F.array().cast("array<string>")).alias("hits"))
    of: dict[int, list] = {}
    for r in anchors.collect():
        of.setdefault(r.gram, []).append((r.key, r.term))
    table = np.array(sorted(of), np.int64)
    groups = [of[g] for g in table.tolist()]
    at = len(ids)

    def batches(parts) -> Iterator[pa.RecordBatch]:
        for p in parts:
            out = []
            for t in p.column(at):
                text = t.as_py() or ""
                some = _found(table, grams(text.encode(), sizes)) if len(table) else ()
                out.append(sorted({term for i in some for k, term in groups[i] if k in text}))
            yield pa.RecordBatch.from_arrays([*(p.column(i) for i in range(at)), pa.array(out, pa.list_(pa.string()))], [*ids, "hits"])

    schema = T.StructType([*rows.schema.fields[:at], T.StructField("hits", T.ArrayType(T.StringType()))])
    return rows.mapInArrow(batches, schema)


def _candidates(docs: DataFrame, ids: list[str], key: str, anchors: DataFrame, sizes) -> DataFrame:
    """(ids, _h, term): texts and terms that meet in an anchor and pass the exact
    test, all by equi-joins."""
    pairs = _exploded(docs, ids, key, sizes).join(anchors, "gram").select(*(F.col(c).alias(f"_{c}_") for c in ids), F.col("_h").alias("_g"), "term", "key")
    rows = docs.select(*ids, F.xxhash64(key).alias("_h"), F.col(key).alias("_key"))
    meet = F.col("_h") == F.col("_g")
    for c in ids:
        meet &= F.col(c).eqNullSafe(F.col(f"_{c}_"))
    return rows.join(pairs, meet & (F.instr(F.col("_key"), F.col("key")) > 0)).select(*ids, "_h", "term").distinct()


def term_hits(docs: DataFrame, ids: list[str], key: str, terms: DataFrame, known: int = KNOWN, held: int = HELD) -> DataFrame:
    """One row per (text, term) containment: (ids, term)."""
    return with_term_hits(docs, ids, key, terms, known, held).select(*ids, F.explode("hits").alias("term"))
