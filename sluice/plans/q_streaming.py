"""Streaming queries: each drains a file stream of a driver table through a
checkpointed Structured Streaming job and returns the sink's rows, which
must equal the batch operator's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import canon
from ..operators.sinks import audit_rows, write_audit_epoch
from ..streaming import pipelines as S
from .q_conversations import _CONV_ALL, conv_decisions
from .q_events import RL_MAX, RL_WINDOW
from ..operators.ratelimit import rate_limit_sql
from .registry import register


@register("stream_decide", sql=f"SELECT conv_id, turn, stage, action, reason_code, detail FROM ({_CONV_ALL})")
def stream_decide(spark, sf):
    """The routed decision chain over a stream of conversation turns."""
    src = S.file_stream(spark, sf, "conversations")
    c = canon(F.col("text"))
    rows = src.select("conv_id", "turn", "role", c["text"].alias("text"), c["key"].alias("key"))
    dec = conv_decisions(spark, sf, rows=rows).drop("reached")
    return spark.read.parquet(S.run_to_sink(dec, "stream_decide"))


@register("stream_rate_limit", sql=rate_limit_sql("events", "user_id", "ts", "event_id", RL_WINDOW, RL_MAX) + """
SELECT rid AS event_id, k AS user_id, limited FROM r
""")
def stream_rate_limit(spark, sf):
    """The admitted-only window as per-user streaming state."""
    src = S.file_stream(spark, sf, "events")
    out = S.stream_rate_limit(src, key="user_id", ts="ts", order_id="event_id", window_seconds=RL_WINDOW,
                              max_requests=RL_MAX)
    return spark.read.parquet(S.run_to_sink(out, "stream_rate_limit")).select("event_id", "user_id", "limited")


_TS_SQL = "date_trunc('day', TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (conv_id * 11 + turn))"


@register("stream_metrics", sql=f"""
WITH d AS (SELECT *, {_TS_SQL} AS window_start FROM ({_CONV_ALL}))
SELECT window_start, 'requests' AS counter, '' AS label, count(*) AS n FROM d WHERE action <> 'error' GROUP BY ALL
UNION ALL SELECT window_start, 'blocks', reason_code, count(*) FROM d WHERE action = 'block' GROUP BY ALL
UNION ALL SELECT window_start, 'actions', action, count(*) FROM d WHERE action <> 'error' GROUP BY ALL
UNION ALL SELECT window_start, 'phases', 'phase1', count(*) FROM d WHERE stage = 'input' GROUP BY ALL
UNION ALL SELECT window_start, p, q, count(*) FROM d, (VALUES ('phases', 'phase2'), ('phases', 'phase3')) v(p, q)
  WHERE stage IS NOT NULL AND NOT gated GROUP BY ALL
""")
def stream_metrics(spark, sf):
    """Counters of the decision stream (requests, blocks by reason, phases,
    final actions) per day of a derived event time."""
    src = S.file_stream(spark, sf, "conversations")
    c = canon(F.col("text"))
    ts = F.timestamp_seconds(F.lit(1704067200) + 60 * (F.col("conv_id") * 11 + F.col("turn")))
    rows = src.select("conv_id", "turn", "role", c["text"].alias("text"), c["key"].alias("key"), ts.alias("ts"))
    dec = conv_decisions(spark, sf, rows=rows, keep=["ts"])
    out = S.run_to_sink(dec, "stream_metrics", write=S.write_counts("ts", "1 day"))
    return S.total_counts(spark, out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("audit_stream", sql=f"""
SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS request_id, stage, 'default' AS policy_id, CAST(1 AS INTEGER) AS policy_version,
  action AS final_action, reason_code, stage = 'input' AS has_phase1, CASE WHEN gated THEN NULL ELSE 'gray' END AS p3_action
FROM ({_CONV_ALL}) WHERE action IN ('block', 'observe')
""")
def audit_stream(spark, sf):
    """The audit records of the decision stream, once each, filed by
    micro-batch and final action and read back."""
    src = S.file_stream(spark, sf, "conversations")
    c = canon(F.col("text"))
    rows = src.select("conv_id", "turn", "role", c["text"].alias("text"), c["key"].alias("key"))
    dec = conv_decisions(spark, sf, rows=rows, keep=["phase1", "phase2", "phase3"]).where("action <> 'error'")
    audit = audit_rows(dec, F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")), slot="conversations",
                       path="/guardrails/text/check", policy_id=F.lit("default"), policy_version=F.lit(1))
    out = spark.read.schema("value string, epoch long, final_action string").text(S.run_to_sink(audit, "audit_stream", write=write_audit_epoch))
    v = F.parse_json("value")
    get = lambda p, kind: F.variant_get(v, f"$.{p}", kind)
    p1 = get("phase1.action", "string").isNotNull()
    return out.select(get("request_id", "string").alias("request_id"), F.when(p1, "input").otherwise("output").alias("stage"),
                      get("policy_id", "string").alias("policy_id"), get("policy_version", "int").alias("policy_version"), "final_action",
                      get("reason_code", "string").alias("reason_code"), p1.alias("has_phase1"), get("phase3.action", "string").alias("p3_action"))


def _ticks(df):
    return df.select("event_id", "user_id", "ts", (F.col("event_type") != "error").alias("ok"),
                     ((F.col("event_type") == "error") & (F.col("value") > 25)).alias("log_hit"))


def _guard_sql(cooldown=120, window=3600, most=6, threshold=3) -> str:
    """Watchdog replay: the state is the streak and the restarts kept."""
    us = 1_000_000
    ok = lambda h: f"(len({h}) < {most} AND (len({h}) = 0 OR t - list_max({h}) >= {cooldown * us}))"
    return f"""
WITH RECURSIVE ev AS (
  SELECT event_id AS rid, user_id AS k, epoch_us(ts) AS t, event_type <> 'error' AS fine, event_type = 'error' AND value > 25 AS log,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events
),
r(k, rn, rid, attempts, restarts, streak, hits) AS (
  SELECT k, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0, 0, 0, CAST([] AS BIGINT[]) FROM ev WHERE rn = 1
  UNION ALL
  SELECT k, rn, rid, CAST(log AS INTEGER) + CAST(due AS INTEGER), CAST(log AND a AS INTEGER) + CAST(due AND {ok('h1')} AS INTEGER),
         CASE WHEN due THEN 0 ELSE s END, CASE WHEN due AND {ok('h1')} THEN list_append(h1, t) ELSE h1 END
  FROM (SELECT *, s >= {threshold} AS due, CASE WHEN log AND a THEN list_append(h0, t) ELSE h0 END AS h1
        FROM (SELECT *, {ok('h0')} AS a
              FROM (SELECT e.*, CASE WHEN e.fine THEN 0 ELSE r.streak + 1 END AS s, list_filter(r.hits, lambda h: e.t - h <= {window * us}) AS h0
                    FROM r JOIN ev e ON e.k = r.k AND e.rn = r.rn + 1)))
)
SELECT rid AS event_id, k AS user_id, attempts, restarts FROM r WHERE rn > 0"""


@register("stream_guard", sql=_guard_sql())
def stream_guard(spark, sf):
    """T4: watchdog per service (user): log-pattern restarts, then health
    streaks of 3; shared 120 s cooldown and 6-per-hour budget."""
    src = _ticks(S.file_stream(spark, sf, "events"))
    out = S.stream_guard(src, key="user_id", ts="ts", order_id="event_id", ok="ok", log_hit="log_hit")
    return spark.read.parquet(S.run_to_sink(out, "stream_guard")).select("event_id", "user_id", "attempts", "restarts")
