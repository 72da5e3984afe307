"""Time helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_micros(df: DataFrame, col: str) -> Column:
    """Microseconds since the epoch for a TIMESTAMP or TIMESTAMP_NTZ column.

    NTZ values are read as UTC wall-clock time (as the oracle does), with no
    dependence on ``spark.sql.session.timeZone``.
    """
    dt = df.schema[col].dataType
    if isinstance(dt, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    return F.unix_micros(F.col(col))
