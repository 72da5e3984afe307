"""The whole input check as one query: JSON bodies -> policy of each request
(J1) -> that version's rules and settings (J3, P9) -> phase 1 with the rate
limit (W1) -> PII and relevance (F7, F9) -> ladder and final action."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.chat import flatten_chat, input_messages
from ..functions.rules import DEFAULT_PATTERNS, DEFAULT_TERMS
from ..functions.spans import let
from ..functions.text import canon
from ..functions.vectors import best_match, norm
from ..operators import policy as P
from ..operators.decide import Analyzers, Rules, count_gate, decide, gates, rate_gate
from ..operators.ops import rate_key
from ..operators.ratelimit import rate_limit, rate_limit_sql
from ..session import materialize, table
from ..settings import DEFAULTS, settings_struct_from_map
from ..sources.requests import parse_check_requests
from .chains import sql_casefold, sql_pii_count
from .q_events import request_bodies
from .q_policy import _REPLAY, AS_OF, AS_OF_SQL, policy_tables, request_rules
from .registry import register

WINDOW, MAX_HITS = 3600, 4


def overrides(version):
    """Settings overrides of a policy version, derived from its number."""
    pairs = [("max_input_chars", F.when(version % 2 == 0, F.lit("250"))), ("phase3_mode", F.when(version % 3 == 0, F.lit("enforce"))),
             ("phase1_enabled", F.when(version % 7 == 0, F.lit("false"))), ("relevance_enabled", F.when(version % 5 < 3, F.lit("true"))),
             ("max_tool_count", F.lit("4"))]
    return F.map_filter(F.create_map(*(x for k, v in pairs for x in (F.lit(k), v))), lambda _, v: v.isNotNull())


def requests(spark, sf):
    """Parsed check calls with their resolved policy; every 13th conversation
    names a missing policy, every 9th a version that is no integer or 0."""
    cid = F.col("conv_id")
    p = parse_check_requests(request_bodies(spark, sf), "body")
    r = p.select(
        "conv_id", "turn", "malformed", "request",
        F.when(cid % 13 == 5, "nowhere").otherwise(F.col("request.policy_id")).alias("policy_id"),
        F.when(cid % 9 == 4, F.when(F.col("turn") % 2 == 0, "0").otherwise("v1")).when(cid % 4 == 1, (cid % 50 + 1).cast("string"))
        .otherwise(F.col("request.policy_version_text")).alias("policy_version_text"),
        F.when(cid % 6 != 3, F.col("request.meta_policy_id")).alias("meta_policy_id"), F.col("request.meta_version_text").alias("meta_version_text"))
    accepted, intervals = policy_tables(spark, sf)
    return materialize(P.resolve_policy_at(r.withColumn("as_of", F.expr(AS_OF)), accepted, "p0").drop("as_of"), "requests"), intervals


_SQL = f"""
{_REPLAY},
req AS (
  SELECT c.*, (conv_id + turn) % 12 IN (0, 6) AS broken, CASE WHEN conv_id % 3 = 1 THEN 2 ELSE 1 END AS n_messages,
    CASE WHEN conv_id % 13 = 5 THEN 'nowhere' END AS policy_id,
    CASE WHEN conv_id % 9 = 4 THEN CASE WHEN turn % 2 = 0 THEN '0' ELSE 'v1' END WHEN conv_id % 4 = 1 THEN CAST(conv_id % 50 + 1 AS VARCHAR) END AS vt,
    CASE WHEN conv_id % 6 <> 3 AND NOT ((conv_id + turn) % 12 IN (0, 6)) THEN 'p' || CAST(conv_id % 5 AS VARCHAR) END AS meta_policy_id
  FROM conversations c WHERE role = 'user'
),
asked AS (SELECT req.*, {AS_OF} AS as_of, coalesce(policy_id, meta_policy_id) AS pid, TRY_CAST(vt AS INTEGER) AS v FROM req),
{AS_OF_SQL.replace('settled AS', 'q4 AS')},
live AS (SELECT conv_id, turn, i.* FROM q4 JOIN intervals i ON i.policy_id = tpid AND valid_from <= ver AND coalesce(valid_to, 2147483647) > ver WHERE status = 200),
rules AS (SELECT conv_id, turn, list_distinct(list(value) FILTER (list = 'blocklist')) AS terms,
            list(value ORDER BY valid_from, entry_id) FILTER (list = 'prompt_patterns') AS pats,
            list(value ORDER BY valid_from, entry_id) FILTER (list = 'golden_set') AS golden FROM live GROUP BY ALL),
j AS (SELECT q4.*, trim(CASE WHEN conv_id % 3 = 1 THEN CASE WHEN text = '' THEN '' ELSE text || chr(10) END || 'be brief' ELSE text END) AS body,
        coalesce(terms, [{', '.join("'" + t + "'" for t in DEFAULT_TERMS)}]) AS terms,
        coalesce(pats, [{', '.join("'" + t.replace("'", "''") + "'" for t in DEFAULT_PATTERNS)}]) AS pats, coalesce(golden, []) AS golden
      FROM q4 LEFT JOIN rules USING (conv_id, turn)),
m AS (SELECT *, CASE WHEN broken THEN 'Request body must be a JSON object' WHEN trim(text) = '' AND conv_id % 3 = 2 THEN 'messages or text must be provided'
             WHEN turn % 6 > 4 THEN 'tools exceeds max count 4' END AS bad,
        ver % 7 <> 0 AS p1_on, CASE WHEN turn % 4 = 0 THEN 6000 WHEN ver % 2 = 0 THEN 250 ELSE 12000 END AS lim FROM j WHERE status = 200),
elig AS (SELECT conv_id * 100 + turn AS rid, 'k' || CAST(conv_id % 3 AS VARCHAR) AS k, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (conv_id * 11 + turn) AS ts
         FROM m WHERE bad IS NULL AND p1_on),
{re.sub(r'(?<![.a-z_])r(?=[ .(])', 'rl', rate_limit_sql('elig', 'k', 'ts', 'rid', WINDOW, MAX_HITS).strip()[len('WITH RECURSIVE'):])},
scored AS (SELECT m.*, rl.limited, {sql_casefold('body')} AS ckey FROM m LEFT JOIN rl ON rl.rid = m.conv_id * 100 + m.turn),
rel AS (SELECT m.conv_id, m.turn, max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(g.embedding AS DOUBLE[]))) AS best
        FROM (SELECT conv_id, turn, unnest(golden) AS v FROM m) m JOIN embeddings e ON e.vec_id = m.conv_id
        JOIN embeddings g ON g.vec_id = CASE m.v WHEN 'g1' THEN 1 WHEN 'g2' THEN 2 ELSE 3 END GROUP BY ALL),
f AS (SELECT scored.*, list_sort(list_filter(terms, lambda t: contains(ckey, replace(lower(t), 'ß', 'ss')))) AS hits,
        list_filter(pats, lambda p: regexp_matches(body, '(?i)' || p))[1] AS pat, rel.best
      FROM scored LEFT JOIN rel USING (conv_id, turn)),
g AS (SELECT *, CASE WHEN bad IS NOT NULL THEN 'MALFORMED_INPUT' WHEN NOT p1_on THEN NULL WHEN limited THEN 'RATE_LIMITED'
                 WHEN length(body) > lim THEN 'INPUT_TOO_LONG' WHEN len(hits) > 0 THEN 'BLOCKLIST_MATCH' WHEN pat IS NOT NULL THEN 'PROMPT_INJECTION_PATTERN'
                 WHEN turn % 4 = 0 AND turn % 6 > 2 THEN 'STREAM_TOOL_LIMIT' END AS gate FROM f),
d AS (SELECT *, CASE WHEN gate IS NOT NULL THEN NULL WHEN body = '' THEN NULL WHEN {sql_pii_count('body')} > 0 THEN 'PII_DETECTED'
                 WHEN ver % 5 < 3 AND len(golden) > 0 AND coalesce(best, 0) < 0.5 THEN 'RELEVANCE_LOW' END AS gray FROM g)
SELECT conv_id, turn, 200 AS status, tpid AS policy_id, CAST(ver AS INTEGER) AS policy_version,
  CASE WHEN bad IS NOT NULL THEN 'error' WHEN gate IS NOT NULL THEN 'block' WHEN gray IS NULL THEN 'allow' WHEN ver % 3 = 0 THEN 'block' ELSE 'observe' END AS action,
  coalesce(gate, gray) AS reason_code FROM d
UNION ALL SELECT conv_id, turn, status, NULL, NULL, 'error', 'POLICY' FROM q4 WHERE status <> 200
"""


@register("full_check", sql=_SQL)
def full_check(spark, sf):
    """Every user turn as a check call under its own policy version, as of the
    call's place in the policy log.

    The source is read once, parsed and written with each call's policy; the
    text is judged under its version's rules in one projection and dropped, and
    the narrow result is written, so that the rate limit, which needs to know
    which calls reach it, joins narrow rows.
    """
    calls, intervals = requests(spark, sf)
    rules = materialize(request_rules(calls, intervals), "request-rules").select(
        F.col("policy_id").alias("applied_policy_id"), F.col("version").alias("applied_version"), "terms", "patterns", "golden",
        settings_struct_from_map(DEFAULTS, overrides(F.col("version"))).alias("req"))
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    named = emb.where("vec_id in (1, 2, 3)").agg(F.map_from_entries(F.collect_list(F.struct(
        F.when(F.col("vec_id") == 1, "g1").when(F.col("vec_id") == 2, "g2").otherwise("replaced"), "v"))))
    r = calls.join(rules, ["applied_policy_id", "applied_version"], "left")
    msgs = input_messages(F.col("request.messages"), F.col("request.text"), F.col("request.role"))
    r = r.withColumn("_m", msgs).withColumn("_c", canon(flatten_chat(F.col("_m"))))
    bad = (F.when(F.col("malformed"), F.lit("Request body must be a JSON object"))
           .when(F.col("_m").isNull(), F.lit("messages or text must be provided"))
           .otherwise(count_gate(F.size("_m"), F.col("request.tool_count"), F.col("req"))))
    r = r.where("status = 200").select(
        "conv_id", "turn", F.col("applied_policy_id").alias("policy_id"), F.col("applied_version").alias("policy_version"), "req", "terms", "patterns",
        "golden", F.coalesce("_c.text", F.lit("")).alias("text"), F.coalesce("_c.key", F.lit("")).alias("key"),
        F.coalesce("request.stream", F.lit(False)).alias("stream"), F.coalesce("request.tool_count", F.lit(0)).alias("tool_count"), bad.alias("bad"),
        rate_key(F.col("request.rate_key"), F.concat(F.lit("k"), (F.col("conv_id") % 3).cast("string")), F.lit(None).cast("string")).alias("rate_key"))
    narrow = gates(r, F.lit("input"), stream="stream", tool_count="tool_count", malformed=F.col("bad"), req=F.col("req"), rules=Rules(), drop_text=True)
    narrow = materialize(narrow.drop("terms", "patterns"), "check-gates")
    when = F.timestamp_seconds(F.lit(1704067200) + 60 * (F.col("conv_id") * 11 + F.col("turn"))).cast("timestamp_ntz")
    asked = narrow.where("bad is null and req.phase1_enabled").select((F.col("conv_id") * 100 + F.col("turn")).alias("rid"), "conv_id", "turn", "rate_key", when.alias("ts"))
    hits = rate_limit(asked, key="rate_key", ts="ts", order_id="rid", window_seconds=WINDOW, max_requests=MAX_HITS).select("conv_id", "turn", "limited")
    items = F.transform("golden", lambda g: F.struct(g.alias("label"), F.col("_vecs")[g].alias("vec")))
    golden = F.transform(items, lambda g: F.struct(g["label"].alias("label"), g["vec"].alias("vec"), norm(g["vec"]).alias("norm")))
    out = narrow.join(hits, ["conv_id", "turn"], "left").join(emb.withColumnRenamed("vec_id", "conv_id"), "conv_id", "left")
    match = let(norm(F.col("v")), lambda n: best_match(F.col("v"), n, F.col("_g")))
    out = out.withColumn("_vecs", named.scalar()).withColumn("_g", golden).withColumn("relevance", match).withColumn("golden_size", F.size("golden"))
    out = decide(rate_gate(out, "limited", F.col("req")), req=F.col("req"), analyzers=Analyzers(relevance="relevance", golden_size="golden_size"))
    failed = calls.where("status <> 200").select(
        "conv_id", "turn", "status", F.lit(None).cast("string").alias("policy_id"), F.lit(None).cast("int").alias("policy_version"),
        F.lit("error").alias("action"), F.lit("POLICY").alias("reason_code"))
    return out.select("conv_id", "turn", F.lit(200).alias("status"), "policy_id", "policy_version", "action", "reason_code").unionByName(failed)
