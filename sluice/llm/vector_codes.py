"""Operator 11: product codes of vectors, distances over a trie of parts.

A vector's integer components are cut into PARTS equal parts, each replaced
by the index of the nearest entry of its position's codebook.  The codebooks
start from the ENTRIES smallest ids and take ROUNDS rounds of assignment and
averaging.

Every pass goes over the vectors in blocks of bounded size.  At each part
position a block's distinct parts, sorted, are the leaves of a lexicographic
trie whose level i branches on dimension i.  The traversal is depth first: a
node holds one vector, the distances of its prefix to all entries, summed up to
its dimension, and its children start from that vector, so a common prefix is
computed once however many parts (and, through a part's count, rows) share it.
Subtrees of at most LEAVES leaves go down level by level in one numpy step each.
A leaf takes the arg-min and adds its part, times its count, to that entry.

No vector is shuffled.  A round returns PARTS x ENTRIES sums a task, added by
Spark; the driver gets one codebook, whose size the parameters give.  A lost
executor repeats its own blocks.

Defined cases: vectors that are null or hold null or non-finite components (or
such beyond 8,192, see ``vectors``) are dropped, and those of another length
than the commonest; a length that PARTS doesn't divide is cut at i * length //
PARTS, so that parts may be empty (code 00, distance 0); with fewer than ENTRIES
rows the codebooks are smaller; null ids come last, ties among ids go to the
smaller vector; repeated rows are coded each; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import common_length, integers, usable

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components of a block of vectors, and leaves of a subtree taken in one go.
BLOCK, LEAVES = 1 << 21, 4096
#: Bytes of label sums up to which they are broadcast; salts of the join beyond.
SMALL, SALTS = 4 << 20, 32


def cuts(dim: int, parts: int = PARTS) -> list[tuple[int, int]]:
    return [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]


def nearest(parts: np.ndarray, book: np.ndarray, most: int = LEAVES) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest row of ``book`` for each of the
    ``parts``, which are distinct and sorted."""
    n, d = parts.shape
    index, least = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n or not d:
        return index, least
    # leading dimensions that a part shares with the one before it
    shared = np.zeros(n, np.int64)
    shared[1:] = np.logical_and.accumulate(parts[1:] == parts[:-1], axis=1).sum(1)

    def starts(lo, hi, depth):
        new = shared[lo:hi] < depth
        new[0] = True
        return new

    def extend(acc, lo, hi, depth):
        """Distances of the prefixes one longer, from those of length ``depth``."""
        parent = np.cumsum(starts(lo, hi, depth)) - 1
        at = np.flatnonzero(starts(lo, hi, depth + 1))
        return at + lo, acc[parent[at]] + (parts[lo + at, depth, None] - book[None, :, depth]) ** 2

    stack = [(0, n, 0, np.zeros((1, len(book)), np.int64))]
    while stack:
        lo, hi, depth, acc = stack.pop()
        if hi - lo <= most:
            while depth < d:
                _, acc = extend(acc, lo, hi, depth)
                depth += 1
            index[lo:hi], least[lo:hi] = acc.argmin(1), acc.min(1)
            continue
        at, acc = extend(acc, lo, hi, depth)
        ends = np.append(at[1:], hi)
        # children side by side, as long as they are small, are walked as one
        group, first = [], 0
        for i in range(len(at)):
            if i > first and ends[i] - at[first] > most:
                group.append((first, i))
                first = i
        group.append((first, len(at)))
        stack += [(at[a], ends[b - 1], depth + 1, acc[a:b]) for a, b in reversed(group)]
    return index, least


def coded(x: np.ndarray, books: list[np.ndarray]) -> Iterator[tuple]:
    """For each part position: (distinct parts, their counts, their entries,
    their distances, row -> distinct part) of a block of vectors."""
    for (lo, hi), book in zip(cuts(x.shape[1], len(books)), books):
        part = x[:, lo:hi]
        if hi == lo:
            distinct, row, count = part[:1], np.zeros(len(x), np.int64), np.array([len(x)])
        else:
            order = np.lexsort(part.T[::-1])
            ordered = part[order]
            new = np.append(True, (ordered[1:] != ordered[:-1]).any(1))
            distinct, row = ordered[new], np.empty(len(x), np.int64)
            row[order] = np.cumsum(new) - 1
            count = np.bincount(row)
        yield distinct, count, *nearest(distinct, book), row


def blocks(parts: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.Table]:
    """The batches, gathered to about BLOCK components."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += part.num_rows
        if n * max(dim, 1) >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def matrix(block: pa.Table, dim: int) -> np.ndarray:
    return integers(block.column("v").combine_chunks() if block.column("v").num_chunks != 1 else block.column("v").chunk(0), dim)


def averaged(rows: DataFrame, dim: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: an entry becomes the floor of the mean of
    the parts assigned to it; one without parts stays."""

    def sums(parts):
        total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for block in blocks(parts, dim):
            for t, (distinct, count, index, _, _) in zip(total, coded(matrix(block, dim), books)):
                np.add.at(t, index, np.column_stack((distinct * count[:, None], count)))
        flat = [t.ravel().tolist() for t in total]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat, pa.list_(pa.int64()))], ["part", "s"])

    each = rows.select("v").mapInArrow(sums, "part int, s array<bigint>").select("part", F.posexplode("s").alias("i", "x"))
    out = [np.zeros(len(b) * (b.shape[1] + 1), dtype=object) for b in books]
    for r in each.groupBy("part", "i").agg(F.sum("x").alias("x")).collect():
        out[r["part"]][r["i"]] = r["x"]
    new = []
    for s, b in zip(out, books):
        s = s.reshape(len(b), -1)
        new.append(np.array([[x // r[-1] for x in r[:-1]] if r[-1] else old.tolist() for r, old in zip(s, b)], np.int64).reshape(b.shape))
    return new


def learn(rows: DataFrame, dim: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """``rows``: id, v, all of length ``dim``.  One codebook a part position."""
    first = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    x = integers(pa.array([list(r["v"]) for r in first], pa.list_(pa.float64())), dim)
    books = [x[:, lo:hi].copy() for lo, hi in cuts(dim)]
    for _ in range(rounds):
        books = averaged(rows, dim, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, dim: int, books: list[np.ndarray]) -> DataFrame:
    """``id, label, code, error`` of every row (id, label, v)."""

    def code(parts):
        for block in blocks(parts, dim):
            error, index = np.zeros(block.num_rows, np.int64), []
            for _, _, nearest_, least, row in coded(matrix(block, dim), books):
                index.append(nearest_[row])
                error += least[row]
            hexed = np.stack(index, axis=1).astype(np.uint8)
            texts = pa.array([r.tobytes().hex() for r in hexed], pa.string())
            out = pa.table([block.column("id"), block.column("label"), texts, pa.array(error)], ["id", "label", "code", "error"])
            yield from out.to_batches()

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("id", "label", "v").mapInArrow(code, f"id bigint, label {kind}, code string, error bigint")


def with_label_sums(codes: DataFrame) -> DataFrame:
    """Adds ``label_error``, the sum of the errors of a row's label, null labels
    together.  Few labels are broadcast, after a look at their size; many are
    joined with a salt, so that a label of very many rows spreads over tasks."""
    sums = materialize(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "code-labels")
    size = sums.agg(F.sum(F.octet_length(F.coalesce(F.col("label").cast("string"), F.lit(""))) + 32)).first()[0] or 0
    sums = sums.withColumnRenamed("label", "_l")
    if size <= SMALL:
        return codes.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_l"))).drop("_l")
    sums = sums.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = codes.withColumn("_s", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(sums, F.col("label").eqNullSafe(F.col("_l")) & (F.col("_s") == F.col("_t"))).drop("_l", "_s", "_t")


def compress(vectors: DataFrame) -> DataFrame:
    """``vectors``: id, label, v.  Returns ``id, label, code, error,
    label_error, codebooks_sha256``."""
    rows = vectors.select(F.col("id").cast("bigint").alias("id"), "label", "v").where(usable(F.col("v")))
    dim = common_length(rows, "v")
    rows = rows.where(F.size("v") == (dim if dim is not None else -1))
    books = learn(rows, dim) if dim is not None else []
    codes = materialize(encode(rows, dim or 0, books), "codes")
    return with_label_sums(codes).withColumn("codebooks_sha256", F.lit(digest(books)))
