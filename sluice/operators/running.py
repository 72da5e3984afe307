"""Running values per key whose work is split by ranges of the order column.

A key that holds a third of all rows would be one task of a plain window.
Here rows are grouped by (key, range of the order column): one partial
aggregate per range, a window over the ranges' aggregates (one row each),
and a window inside each range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Length of a range, in units of the order column.
WIDTH = 4096


def _ranged(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_r", F.floor(F.col(order) / width).cast("bigint"))


def running_count(df: DataFrame, keys: list[str], order: str, flag: str, out: str, width: int = WIDTH) -> DataFrame:
    """``out``: rows with ``flag`` up to this one (orders are distinct per key)."""
    rows = _ranged(df, order, width)
    per = rows.groupBy(*keys, "_r").agg(F.count_if(flag).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_r", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(per, [*keys, "_r"]).withColumn(out, F.col("_before") + F.sum(F.col(flag).cast("int")).over(inside))
    return rows.drop("_r", "_before")


def next_flagged(df: DataFrame, keys: list[str], order: str, marks: DataFrame, out: str, width: int = WIDTH) -> DataFrame:
    """``out``: the smallest order above this row's own among the rows of
    ``marks`` (keys, order) of the same key."""
    m = _ranged(marks.select(*keys, order), order, width)
    rows = _ranged(df, order, width)
    per = rows.select(*keys, "_r").distinct().join(m.groupBy(*keys, "_r").agg(F.min(order).alias("_m")), [*keys, "_r"], "full_outer")
    after = Window.partitionBy(*keys).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_r", F.min("_m").over(after).alias("_later"))
    both = rows.withColumn("_mark", F.lit(None).cast("bigint")).unionByName(
        m.withColumn("_mark", F.col(order).cast("bigint")), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_r").orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, -1)
    tag = both.withColumn("_is", F.col("_mark").isNotNull()).withColumn("_next", F.min("_mark").over(inside)).where("not _is")
    return tag.join(per, [*keys, "_r"]).withColumn(out, F.coalesce("_next", "_later")).drop("_r", "_mark", "_is", "_next", "_later")


def last_before(df: DataFrame, keys: list[str], order: str, marks: DataFrame, values: list[str], out: str, width: int = WIDTH) -> DataFrame:
    """As-of join: ``out`` is the struct of ``values`` of the last of ``marks``
    (keys, order, values; orders distinct per key) at or before the row's own
    order among those of the same key, or null.  Without keys, over all marks.

    Rows and marks meet by (key, range of the order): one row a range carries
    the last mark before it, so neither a key nor a time is one task.
    """
    value = F.struct(*values)
    m = _ranged(marks.select(*keys, F.col(order).cast("bigint").alias(order), value.alias("_mark")), order, width)
    rows = _ranged(df.withColumn("_row", F.struct(*df.columns)).select(*keys, F.col(order).cast("bigint").alias(order), "_row"), order, width)
    per = rows.select(*keys, "_r").distinct().join(m.groupBy(*keys, "_r").agg(F.max_by("_mark", order).alias("_last")), [*keys, "_r"], "full_outer")
    upto = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_r", F.last("_last", ignorenulls=True).over(upto).alias("_before"))
    both = rows.unionByName(m, allowMissingColumns=True).withColumn("_is", F.col("_row").isNotNull())
    # at equal orders marks come first
    inside = Window.partitionBy(*keys, "_r").orderBy(order, "_is").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_now", F.last("_mark", ignorenulls=True).over(inside)).where("_is")
    return both.join(per, [*keys, "_r"]).select("_row.*", F.coalesce("_now", "_before").alias(out))
