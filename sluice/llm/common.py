"""Small helpers shared by the corpus operators.

Every operator selects the columns it needs by name before it does anything
else, so further columns of its input, whatever they are called, can't clash
with the names it makes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, table

#: Stands for a null doc_id where ids are compared: null ids come last and
#: count as one document.
LAST_ID = 2**63 - 1

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def id_key(c: Column) -> Column:
    return F.coalesce(c.cast("bigint"), F.lit(LAST_ID))


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage at a table that every executor can reach, so a lost
    executor costs the tasks it ran and not the work before them.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch of texts.  Spark's default of 10,000 would hold some
#: ten MB to some hundred MB in the JVM, on its way, and in the Python worker.
ARROW_ROWS = 400


def map_texts(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` for rows that hold whole texts, in small batches."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) > ARROW_ROWS:
        conf.set(key, ARROW_ROWS)
    return df.mapInArrow(fn, schema)


def documents(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")
