"""Embedding rows as matrices of integers, for operators 11 and 13."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A component x becomes floor(SCALE * x).  Rows with a component beyond LIMIT
#: count as not finite: below it, sums of up to 1,024 products stay exact in
#: doubles, and squares in 64-bit integers.
SCALE, LIMIT = 256, 1 << 21


def usable(v: Column) -> Column:
    """Whether a vector is there and holds finite numbers only, not beyond LIMIT."""
    fine = lambda x: x.isNotNull() & (F.abs(x.cast("double")) * SCALE < LIMIT)  # noqa: E731 (NaN is above all)
    return v.isNotNull() & F.forall(v, fine)


def common_length(rows: DataFrame, v: str) -> int | None:
    """The commonest length of the vectors (the larger of two as common)."""
    sizes = rows.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return top[0]["d"] if top else None


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) integers of an Arrow list column of usable vectors."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * x).astype(np.int64).reshape(len(column), dim)
