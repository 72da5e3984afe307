"""Queries over ``events``: rate limiting, restart budget, failure streaks,
probe verdicts, request parsing and latency counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ratelimit import rate_limit, rate_limit_sql
from ..session import table
from .registry import register

RL_WINDOW = 86400  # the default 60 s never fires on these tables
RL_MAX = 2


@register("rate_limit", sql=rate_limit_sql("events", "user_id", "ts", "event_id", RL_WINDOW, RL_MAX) + """
SELECT rid AS event_id, k AS user_id, limited FROM r
""")
def rate_limit_q(spark, sf):
    """Admitted-only sliding window per user (86400 s, 2 hits)."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts")
    out = rate_limit(ev, key="user_id", ts="ts", order_id="event_id", window_seconds=RL_WINDOW, max_requests=RL_MAX)
    return out.select("event_id", "user_id", "limited")


# ------------------------------------------------------------------ W2, W3

@register("restart_budget", sql=rate_limit_sql("events", "user_id", "ts", "event_id", 3600, 6, 120,
                                               where="event_type = 'error'") + """
SELECT rid AS event_id, k AS user_id, NOT limited AS allowed FROM r
""")
def restart_budget(spark, sf):
    """A restart request (error event) is allowed when >= 120 s after the
    last restart and fewer than 6 restarts were kept in the last 3600 s;
    refused requests are not recorded."""
    from ..operators.ops import restart_budget as rb

    ev = table(spark, sf, "events").where(F.col("event_type") == "error").select("event_id", "user_id", "ts")
    return rb(ev, key="user_id", ts="ts", order_id="event_id").select("event_id", "user_id", "allowed")


@register("failure_streak", sql="""
WITH f AS (
  SELECT event_id, user_id, ts, event_type = 'error' AS fail,
         sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END)
           OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island
  FROM events
)
SELECT event_id, user_id, fail,
       fail AND (row_number() OVER (PARTITION BY user_id, island, fail ORDER BY ts, event_id) % 3 = 0) AS fired
FROM f
""")
def failure_streak(spark, sf):
    """Consecutive failures per user; every third one fires and resets."""
    from ..operators.ops import failure_streak as fs

    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("fail"))
    return fs(ev, key="user_id", ts="ts", order_id="event_id", fail="fail", threshold=3) \
        .select("event_id", "user_id", "fail", "fired")


# ------------------------------------------------------------------ A5, A6

@register("analyzer_latency", sql="""
SELECT event_type AS analyzer, sum(value) AS latency_ms_sum, count(value) AS latency_ms_count,
       CASE WHEN count(value) > 0 THEN round(sum(value) / count(value), 3) ELSE 0.0 END AS latency_ms_avg
FROM events GROUP BY event_type
""")
def analyzer_latency_q(spark, sf):
    """A5: sum, count and zero-guarded average latency per analyzer."""
    from ..operators.sinks import analyzer_latency

    ev = table(spark, sf, "events").select(F.col("event_type").alias("analyzer"), F.col("value").alias("latency_ms"))
    return analyzer_latency(ev)


@register("probe_summary", sql="""
SELECT CAST(ts AS DATE) AS run_id, count(*) FILTER (WHERE event_type <> 'error') AS pass_count,
       count(*) FILTER (WHERE event_type = 'error') AS fail_count
FROM events GROUP BY CAST(ts AS DATE)
""")
def probe_summary(spark, sf):
    """PASS / FAIL counts per run (a run = one day of probe events)."""
    from ..operators.ops import probe_summary as ps

    ev = table(spark, sf, "events").select(F.to_date("ts").alias("run_id"),
                                            (F.col("event_type") != "error").alias("passed"))
    return ps(ev, run="run_id", passed="passed")


# ------------------------------------------------------------------ D2, S3, F5, P10

@register("probe_verdict", sql="""
SELECT event_id,
  CASE WHEN code = 200 AND kind IN (0, 3, 5) AND has_k THEN 'PASS' ELSE 'FAIL' END AS verdict,
  CASE WHEN code <> 200 THEN 'http 500' WHEN kind = 1 THEN 'error payload: slot ' || CAST(user_id AS VARCHAR) || ' down'
       WHEN kind = 2 THEN 'error payload: {"code":' || CAST(user_id AS VARCHAR) || '}'
       WHEN kind = 4 THEN 'error payload: None' WHEN kind = 6 THEN 'error payload: boom'
       WHEN NOT has_k OR kind = 7 THEN 'missing key: k' END AS reason
FROM (SELECT event_id, user_id, event_id % 8 AS kind, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS code,
             json_valid(props) AND regexp_matches(CAST(json(props) AS VARCHAR), '[{,]"k":') AS has_k FROM events)
""")
def probe_verdict_q(spark, sf):
    """HTTP code, error message, expected key at any depth (key 'k').  By
    event_id the body has no error, an object with or without a message, an
    empty one, null, an empty string, a text, or is no JSON."""
    from ..operators.ops import probe_verdict

    uid, props = F.col("user_id").cast("string"), F.col("props")
    with_error = lambda e: F.concat(F.lit('{"data": '), props, F.lit(', "error": '), e, F.lit("}"))
    kind = F.col("event_id") % 8
    body = (F.when(kind == 1, with_error(F.concat(F.lit('{"message": "slot '), uid, F.lit(' down"}'))))
            .when(kind == 2, with_error(F.concat(F.lit('{"code": '), uid, F.lit("}"))))
            .when(kind == 3, with_error(F.lit('""'))).when(kind == 4, with_error(F.lit("null")))
            .when(kind == 6, with_error(F.lit('"boom"'))).when(kind == 7, F.lit("k is missing"))
            .otherwise(props))
    ev = table(spark, sf, "events").select(
        "event_id", body.alias("body"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("code"), F.lit("k").alias("expect_key"))
    return probe_verdict(ev, code="code", body="body", expect_key="expect_key").select("event_id", "verdict", "reason")


def request_bodies(spark, sf):
    """Check-call bodies as JSON text, derived from the conversation turns:
    messages, parts, text with a role, tools, stream, metadata, and every
    twelfth body broken (not JSON, or a list)."""
    turn, cid = F.col("turn"), F.col("conv_id")
    q = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    js = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)  # noqa: E731  one JSON value
    text = js(F.coalesce("text", F.lit("")))
    shape = (F.when(cid % 3 == 0, q("messages", F.concat(F.lit('[{"role": "user", "content": '), text, F.lit("}]"))))
             .when(cid % 3 == 1, q("messages", F.concat(F.lit('[{"role": "user", "content": [{"type": "text", "text": '), text,
                                                        F.lit('}, {"type": "image", "url": "x"}]}, {"role": "system", "content": "be brief"}]'))))
             .otherwise(F.concat(q("text", text), F.lit(", "), q("role", js(F.col("role"))))))
    tools = q("tools", F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit('{"name": "t"}'), (turn % 6).cast("int")), ", "), F.lit("]")))
    meta = q("metadata", F.concat(F.lit('{"policy_id": "p'), (cid % 5).cast("string"), F.lit('", "trace": "'), cid.cast("string"), F.lit('"}')))
    body = F.concat(F.lit("{"), F.concat_ws(", ", shape, tools, q("stream", F.when(turn % 4 == 0, "true").otherwise("false")), meta), F.lit("}"))
    broken = (cid + turn) % 12
    return table(spark, sf, "conversations").where("role = 'user'").select(
        "conv_id", "turn", F.when(broken == 0, F.concat(F.lit("["), body, F.lit("]"))).when(broken == 6, F.lit("{oops")).otherwise(body).alias("body"))


@register("parse_requests", sql="""
SELECT conv_id, turn, bad AS malformed, CASE WHEN NOT bad AND conv_id % 3 < 2 THEN 1 + conv_id % 3 END AS n_messages,
  CASE WHEN bad THEN NULL WHEN conv_id % 3 = 2 THEN role ELSE 'user' END AS role,
  CASE WHEN NOT bad THEN md5(coalesce(text, '')) END AS content_md5,
  CASE WHEN NOT bad THEN CAST(turn % 6 AS INTEGER) END AS tool_count, CASE WHEN NOT bad THEN turn % 4 = 0 END AS stream,
  CASE WHEN NOT bad THEN 'p' || CAST(conv_id % 5 AS VARCHAR) END AS meta_policy_id,
  CASE WHEN NOT bad THEN CAST(conv_id AS VARCHAR) END AS trace
FROM (SELECT *, (conv_id + turn) % 12 IN (0, 6) AS bad FROM conversations WHERE role = 'user')
""")
def parse_requests(spark, sf):
    """S3: JSON body -> typed check request; non-JSON or non-object -> malformed."""
    from ..sources.requests import parse_check_requests

    p = parse_check_requests(request_bodies(spark, sf), "body")
    r = lambda c: F.col(f"request.{c}")
    first = F.get(r("messages"), F.lit(0))
    content = F.coalesce(first["content"], F.get(first["parts"], F.lit(0))["text"], r("text"))
    return p.select("conv_id", "turn", "malformed", F.when(r("messages").isNotNull(), F.size(r("messages")).cast("bigint")).alias("n_messages"),
                    r("role").alias("role"), F.md5(content).alias("content_md5"), r("tool_count").alias("tool_count"),
                    r("stream").alias("stream"), r("meta_policy_id").alias("meta_policy_id"), r("metadata")["trace"].alias("trace"))


@register("stream_tool_gate", sql="""
SELECT event_id, stream, tool_count, stream AND tool_count > 4 AS blocked
FROM (SELECT event_id, event_type IN ('view', 'click') AS stream, CAST(floor(value / 5) AS INTEGER) AS tool_count
      FROM events)
""")
def stream_tool_gate(spark, sf):
    """streamed requests with more than max(1, max_tool_count // 2) tools."""
    from ..operators.decide import stream_tool_blocked
    from ..settings import DEFAULTS, settings_struct

    ev = table(spark, sf, "events").select(
        "event_id", F.col("event_type").isin("view", "click").alias("stream"),
        F.floor(F.col("value") / 5).cast("int").alias("tool_count"))
    return ev.select("event_id", "stream", "tool_count",
                     stream_tool_blocked(F.col("stream"), F.col("tool_count"), settings_struct(DEFAULTS)).alias("blocked"))


@register("rate_key", sql="""
SELECT event_id, coalesce(nullif(trim(explicit), ''), api_key, host, 'anonymous') AS rate_key
FROM (SELECT event_id,
        CASE WHEN event_type = 'signup' THEN '   ' WHEN event_type = 'view' THEN ' u' || CAST(user_id AS VARCHAR) || ' ' END AS explicit,
        CASE WHEN event_type IN ('click', 'signup') THEN 'key-' || CAST(user_id AS VARCHAR) END AS api_key,
        CASE WHEN event_type <> 'purchase' THEN 'h' || CAST(user_id AS VARCHAR) END AS host
      FROM events)
""")
def rate_key_q(spark, sf):
    """P10: explicit non-blank key, else API key, else client host, else anonymous."""
    from ..operators.ops import rate_key

    uid = F.col("user_id").cast("string")
    ev = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "signup", F.lit("   "))
        .when(F.col("event_type") == "view", F.concat(F.lit(" u"), uid, F.lit(" "))).alias("explicit"),
        F.when(F.col("event_type").isin("click", "signup"), F.concat(F.lit("key-"), uid)).alias("api_key"),
        F.when(F.col("event_type") != "purchase", F.concat(F.lit("h"), uid)).alias("host"))
    return ev.select("event_id", rate_key(F.col("explicit"), F.col("api_key"), F.col("host")).alias("rate_key"))
