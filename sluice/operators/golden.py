"""Rows scored against a golden set of any size.

A set of up to HELD bytes travels to the tasks, which look up its size first:
one narrow pass over the rows, each Arrow batch one matrix product.  A larger set
is cut into numbered blocks of that size; rows and blocks meet in groups (chunk
of rows, block), each of which gives its rows' best item as one small row, and
the best over the blocks is a partial maximum per row.

An item's cosine is compared as the running arg-max in list order would: the
first strictly best item counts, a best of -1.0 or less gives no label, a zero
vector scores 0.0, null components count as 0.  Matrix products may differ in the
last bits; items within a hair of a row's best are summed again one component
after the other, so equal vectors tie and the first of them wins.

Defined cases: a null vector, or an empty golden set, gives score -1.0 and no
label; golden items without a vector are no items; NaN counts as larger than any
score; vectors of different length are filled up with zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of a block of golden vectors, and rows of a chunk that meets a block.
HELD, CHUNK = 8 << 20, 65536
#: Rows scored in one go, by numbers of the score matrix.
CELLS = 1 << 22
#: Scores closer than this to the best are summed again.
HAIR = 1e-9


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows x dim components, norms over all components, whether not null)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n, there = len(column), column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.flatten()
    nulls = flat.is_null().to_numpy(zero_copy_only=False)
    flat = np.where(nulls, 0.0, flat.to_numpy(zero_copy_only=False).astype(np.float64))
    size = np.where(there, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    row = np.repeat(np.arange(n), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    x = np.zeros((n, dim))
    x[row[place < dim], place[place < dim]] = flat[place < dim]
    return x, np.sqrt(np.bincount(row, flat * flat, n)), there


class Golden:
    """Golden items in list order: indexes, labels, vectors, norms."""

    def __init__(self, idx: list[int], labels: list, column: pa.Array):
        dim = int(max(column.value_lengths().to_numpy(zero_copy_only=False), default=0))
        v, norm, _ = matrix(column, dim)
        order = np.argsort(np.array(idx, np.int64), kind="stable")
        self.dim, self.idx, self.labels, self.v, self.norm = dim, np.array(idx, np.int64)[order], [labels[i] for i in order], v[order], norm[order]

    def scores(self, x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Cosines of the rows with all items; 0 with a zero vector."""
        both = norm[:, None] * self.norm[None, :]
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            return np.where(both == 0, 0.0, (x @ self.v.T) / both)

    def best(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(score, place of the item; -1 for none) of each row."""
        x, norm, there = matrix(column, self.dim)
        score, place = np.full(len(x), -1.0), np.full(len(x), -1)
        if not len(self.idx):
            return score, place
        step = max(1, CELLS // len(self.idx))
        for lo in range(0, len(x), step):
            s = self.scores(x[lo : lo + step], norm[lo : lo + step])
            s = np.where(np.isnan(s), np.inf, s)
            row, item = np.nonzero(s >= s.max(1, keepdims=True) - HAIR)
            exact = self._one_by_one(x[lo + row], norm[lo + row], item)
            order = np.lexsort((item, -exact, row))
            first = order[np.unique(row[order], return_index=True)[1]]
            top = exact[first] > -1.0
            score[lo : lo + step] = np.where(top, np.where(np.isinf(exact[first]), np.nan, exact[first]), -1.0)
            place[lo : lo + step] = np.where(top, item[first], -1)
        return np.where(there, score, -1.0), np.where(there, place, -1)

    def _one_by_one(self, x, norm, item) -> np.ndarray:
        dot = np.zeros(len(item))
        for j in range(self.dim):
            dot += x[:, j] * self.v[item, j]
        both = norm * self.norm[item]
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            s = np.where(both == 0, 0.0, dot / both)
        return np.where(np.isnan(s), np.inf, s)


def _items(golden: DataFrame) -> DataFrame:
    return golden.where(F.col("vec").isNotNull()).select(F.col("idx").cast("bigint").alias("idx"), "label", "vec")


def _size(items: DataFrame) -> int:
    return items.agg(F.sum(8 * F.size("vec") + F.octet_length(F.coalesce("label", F.lit(""))) + 64)).first()[0] or 0


def _taken(items: DataFrame) -> Golden:
    t = items.toArrow().combine_chunks()
    column = t.column("vec").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.float64()))
    return Golden(t.column("idx").to_pylist(), t.column("label").to_pylist(), column)


def _rows(df: DataFrame, vec: str, ids: list[str]) -> DataFrame:
    return df.select(*ids, F.col(vec).cast("array<double>").alias("_v"))


def best(df: DataFrame, vec: str, golden: DataFrame, ids: list[str], held: int = HELD) -> DataFrame:
    """(ids, matched_label, score) of every row's best golden item."""
    items, rows = _items(golden), _rows(df, vec, ids)
    at, size = len(ids), _size(items)
    schema = T.StructType([*rows.schema.fields[:at], T.StructField("matched_label", T.StringType()), T.StructField("score", T.DoubleType())])
    if size <= held:
        g = _taken(items)

        def batches(parts) -> Iterator[pa.RecordBatch]:
            for p in parts:
                score, place = g.best(p.column(at))
                yield pa.RecordBatch.from_arrays(
                    [*(p.column(i) for i in range(at)), pa.array([g.labels[i] if i >= 0 else None for i in place], pa.string()), pa.array(score)],
                    [*ids, "matched_label", "score"])

        return rows.mapInArrow(batches, schema)
    met = _meet(rows, items, ids, size, held, _best_of_block, T.StructType([
        T.StructField("_row", T.LongType()), *rows.schema.fields[:at], T.StructField("label", T.StringType()), T.StructField("idx", T.LongType()), T.StructField("score", T.DoubleType())]))
    top = met.groupBy("_row").agg(*(F.first(c).alias(c) for c in ids), F.max_by(F.struct("label", "score"), F.struct("score", -F.coalesce("idx", F.lit(2**63 - 1)))).alias("_m"))
    return top.select(*ids, F.col("_m.label").alias("matched_label"), F.col("_m.score").alias("score"))


def cross(df: DataFrame, vec: str, golden: DataFrame, ids: list[str], held: int = HELD) -> DataFrame:
    """(ids, idx, golden_label, score) of every row with every golden item, in
    the long form that is asked for."""
    items, rows = _items(golden), _rows(df, vec, ids)
    at, size = len(ids), _size(items)
    out = T.StructType([*rows.schema.fields[:at], T.StructField("idx", T.LongType()), T.StructField("golden_label", T.StringType()), T.StructField("score", T.DoubleType())])
    if size <= held:
        g = _taken(items)

        def batches(parts):
            for p in parts:
                yield from _long(g, pa.table([p.column(i) for i in range(at + 1)], [*ids, "_v"]), ids).to_batches()

        return rows.mapInArrow(batches, out)
    return _meet(rows, items, ids, size, held, _long, out)


def _best_of_block(g: Golden, t: pa.Table, ids: list[str]) -> pa.Table:
    score, place = g.best(t.column("_v"))
    return pa.table([t.column("_row"), *(t.column(c) for c in ids), pa.array([g.labels[i] if i >= 0 else None for i in place], pa.string()),
                     pa.array([int(g.idx[i]) if i >= 0 else None for i in place], pa.int64()), pa.array(score)], ["_row", *ids, "label", "idx", "score"])


def _long(g: Golden, t: pa.Table, ids: list[str]) -> pa.Table:
    x, norm, there = matrix(t.column("_v"), g.dim)
    n, m = len(x), len(g.idx)
    score = g.scores(x, norm).ravel()
    at = pa.array(np.repeat(np.arange(n), m))
    scores = pa.array(score, mask=np.repeat(~there, m))
    return pa.table([*(t.column(c).take(at) for c in ids), pa.array(np.tile(g.idx, n)), pa.array(g.labels * n, pa.string()), scores], [*ids, "idx", "golden_label", "score"])


def _meet(rows: DataFrame, items: DataFrame, ids: list[str], size: int, held: int, fn, schema) -> DataFrame:
    """``fn`` of every (chunk of rows, block of golden items), both of bounded size."""
    n = -(-size // held)
    chunks = -(-rows.count() // CHUNK) or 1
    left = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_c", F.pmod(F.xxhash64("_row"), F.lit(chunks)))
    left = left.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    right = items.withColumn("_b", F.pmod(F.xxhash64("idx"), F.lit(n))).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<bigint>")))
    none = to_arrow_schema(schema).empty_table()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows:
            return none
        g = Golden(b.column("idx").to_pylist(), b.column("label").to_pylist(), b.column("vec").combine_chunks() if b.num_rows else pa.array([], pa.list_(pa.float64())))
        return fn(g, a, ids)

    return left.groupBy("_c", "_b").cogroup(right.groupBy("_c", "_b")).applyInArrow(run, schema)
