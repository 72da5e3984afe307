"""Audit sink (S4) and metrics rendering.

Metrics are plain aggregates over decision tables: every counter of the
reference is a ``groupBy().count()`` (partial aggregation before the
shuffle, so hot reason codes cost nothing extra), rendered as long-form
``(metric, label_key, label_value, value)`` rows and, on demand, as the
text exposition format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import formats as FMT

def audit_rows(dec: DataFrame, request_id: Column, *, slot: str, path: str, policy_id: Column,
               policy_version: Column, stream: Column | None = None) -> DataFrame:
    """(final_action, value): the full audit record of every decision other
    than ``allow`` as one JSON string, and the action it is filed under."""
    rec = F.struct(
        request_id.alias("request_id"), F.lit(slot).alias("slot"), F.lit(path).alias("path"),
        (stream if stream is not None else F.lit(False)).alias("stream"),
        policy_id.cast("string").alias("policy_id"), policy_version.cast("int").alias("policy_version"),
        F.col("phase1"), F.col("phase2"), F.col("phase3"),
        F.col("action").alias("final_action"), F.col("reason_code"),
        F.lit(None).cast("double").alias("upstream_latency_ms"),
        F.lit(None).cast("double").alias(FMT.AUDIT_LATENCY_FIELD),
    )
    return dec.where(F.col("action") != "allow").select(F.col("action").alias("final_action"), F.to_json(rec).alias("value"))


def write_audit(audit: DataFrame, path: str) -> None:
    """Append audit records, one JSON text a line, in a folder per final action."""
    audit.write.mode("append").partitionBy("final_action").text(path)


def write_audit_epoch(audit: DataFrame, epoch: int, path: str) -> None:
    """The records of one micro-batch, below its number.  A micro-batch that is
    run again after a failure replaces what it had written."""
    audit.write.mode("overwrite").partitionBy("final_action").text(f"{path}/epoch={epoch}")


# ------------------------------------------------------------------ counters

def request_totals(dec: DataFrame) -> DataFrame:
    """A1: checks counted (well-formed rows only reach a decision table)."""
    return dec.agg(F.count(F.lit(1)).alias("requests"))


def blocks_by_reason(dec: DataFrame) -> DataFrame:
    """A2: blocks per reason (phase-1 blocks and enforced gray blocks)."""
    return dec.where((F.col("action") == "block") & F.col("reason_code").isNotNull()) \
        .groupBy("reason_code").agg(F.count(F.lit(1)).alias("blocks"))


def phase_hits(dec: DataFrame) -> DataFrame:
    """A3: rows that reached each phase (passage, not enablement)."""
    return dec.select(F.explode("reached").alias("phase")).groupBy("phase").agg(F.count(F.lit(1)).alias("hits"))


def final_actions(dec: DataFrame) -> DataFrame:
    """A4: rows per final action."""
    return dec.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def analyzer_latency(lat: DataFrame, name: str = "analyzer", ms: str = "latency_ms") -> DataFrame:
    """A5: sum, count and zero-guarded average per analyzer."""
    return lat.groupBy(name).agg(
        F.sum(ms).alias("latency_ms_sum"), F.count(ms).alias("latency_ms_count"),
    ).withColumn("latency_ms_avg", F.when(F.col("latency_ms_count") > 0,
                                          F.round(F.col("latency_ms_sum") / F.col("latency_ms_count"), 3))
                 .otherwise(F.lit(0.0)))


#: Metric families in the order they are written, with their kind.
FAMILIES = ((FMT.METRIC_REQUESTS, "counter"), (FMT.METRIC_BLOCKS, "counter"), (FMT.METRIC_PHASE_HITS, "counter"),
            (FMT.METRIC_FINAL_ACTIONS, "counter"), (FMT.METRIC_TIMEOUTS, "counter"), (FMT.METRIC_RATE_LIMIT_HITS, "counter"),
            (FMT.METRIC_LATENCY_AVG, "gauge"))


def metric_rows(dec: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """Every counter as long-form (metric, label_key, label_value, value).

    One pass and one partially aggregated ``groupBy``: each decision row emits
    the counters it increments with weight 1; totals that may be zero are rows
    of weight 0, added before the grouping.
    """
    def k(m, lk, lv):
        return F.struct(F.lit(m).alias("metric"), F.lit(lk).cast("string").alias("label_key"), lv.cast("string").alias("label_value"))

    none = F.lit(None)
    keys = F.array_compact(F.array(
        k(FMT.METRIC_REQUESTS, None, none),
        F.when((F.col("action") == "block") & F.col("reason_code").isNotNull(), k(FMT.METRIC_BLOCKS, "reason", F.col("reason_code"))),
        k(FMT.METRIC_FINAL_ACTIONS, "action", F.col("action")),
        F.when(F.col("reason_code") == "RATE_LIMITED", k(FMT.METRIC_RATE_LIMIT_HITS, None, none)),
    ))
    phases = F.transform(F.coalesce("reached", F.array().cast("array<string>")), lambda p: k(FMT.METRIC_PHASE_HITS, "phase", p))
    rows = dec.select(F.explode(F.concat(keys, phases)).alias("m"), F.lit(1.0).alias("w")).select("m.*", "w")
    zeros = dec.sparkSession.createDataFrame(
        [(m, None, None, 0.0) for m in (FMT.METRIC_REQUESTS, FMT.METRIC_RATE_LIMIT_HITS, FMT.METRIC_TIMEOUTS)],
        "metric string, label_key string, label_value string, w double")
    out = rows.unionByName(zeros).groupBy("metric", "label_key", "label_value").agg(F.sum("w").alias("value"))
    if latency is not None:
        lat = latency.groupBy("analyzer").agg(F.sum("latency_ms").alias("s"), F.count("latency_ms").alias("n"))
        out = out.unionByName(lat.select(
            F.lit(FMT.METRIC_LATENCY_AVG).alias("metric"), F.lit("analyzer").alias("label_key"), F.col("analyzer").alias("label_value"),
            F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(F.lit(0.0)).alias("value")))
    return out


def exposition_lines(rows: DataFrame) -> DataFrame:
    """Text exposition, ``name{key="value"} v`` per row (averages at 3
    decimals) and a ``# TYPE`` line per family.  Ordered by (family, label)
    it is the text: label "" sorts the type line and label-free rows first;
    where both exist the type line is the one that starts with ``#``."""
    order = F.create_map(*(x for i, (m, _) in enumerate(FAMILIES) for x in (F.lit(m), F.lit(i))))
    val = F.when(F.col("metric") == FMT.METRIC_LATENCY_AVG, F.format_string("%.3f", F.col("value"))) \
        .otherwise(F.col("value").cast("bigint").cast("string"))
    label = F.when(F.col("label_key").isNull(), F.lit("")).otherwise(
        F.format_string('{%s="%s"}', F.col("label_key"), F.col("label_value")))
    lines = rows.select(order[F.col("metric")].cast("bigint").alias("family"), F.coalesce("label_value", F.lit("")).alias("label"),
                        F.concat(F.col("metric"), label, F.lit(" "), val).alias("line"))
    types = rows.sparkSession.createDataFrame([(i, "", f"# TYPE {m} {kind}") for i, (m, kind) in enumerate(FAMILIES)],
                                              "family long, label string, line string")
    return types.unionByName(lines)
