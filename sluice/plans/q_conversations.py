"""Queries over ``conversations``: chat flattening, payload shapes, count
gates, phase 1 and the direction-routed text chain with its counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chat import (assistant_text, conversation_messages, flatten_chat, input_messages,
                              output_text, segment_concat)
from ..functions.rules import RuleSet
from ..functions.text import canon
from ..operators.decide import Rules, count_gate, evaluate, phase1
from ..operators.sinks import phase_hits as phase_hits_agg
from ..session import table
from ..settings import DEFAULTS, settings_struct
from .chains import chain_sql, sql_casefold, sql_first_pattern, sql_term_hits
from .registry import register

# Words and patterns that occur in the generated conversations.
CONV_RULES = RuleSet(terms=("nicht", "über", "with the"), patterns=(r"de\s+la", r"und\s+(der|die)"))
CONV_REQ = DEFAULTS.with_(max_input_chars=300, max_stream_input_chars=150,
                          max_non_stream_output_chars=1500, max_message_count=4)


def _conv(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations")


def _canon_rows(spark, sf) -> DataFrame:
    c = canon(F.col("text"))
    return _conv(spark, sf).select("conv_id", "turn", "role", c["text"].alias("text"), c["key"].alias("key"))


_AGG_TEXT = "string_agg(CASE WHEN text <> '' THEN text END, chr(10) ORDER BY turn)"


@register("flatten_chat", sql=f"""
SELECT conv_id, count(*) AS message_count, CASE WHEN count(*) > 4 THEN 'MALFORMED_INPUT' ELSE 'ok' END AS status,
       CASE WHEN count(*) <= 4 THEN CAST(length({_AGG_TEXT}) AS BIGINT) END AS n_chars,
       CASE WHEN count(*) <= 4 THEN md5({_AGG_TEXT}) END AS text_md5
FROM conversations GROUP BY conv_id
""")
def flatten_chat_q(spark, sf):
    """Messages in turn order -> canonical segments joined by newline;
    above the policy's message limit the request is malformed."""
    m = conversation_messages(_conv(spark, sf), conv_id="conv_id", turn="turn", role="role", text="text",
                              max_messages=CONV_REQ.max_message_count)
    bad = count_gate(F.col("message_count"), None, settings_struct(CONV_REQ)).isNotNull()
    t = flatten_chat(F.col("messages"))
    return m.select("conv_id", "message_count", F.when(bad, "MALFORMED_INPUT").otherwise("ok").alias("status"),
                    F.length(t).cast("bigint").alias("n_chars"), F.md5(t).alias("text_md5"))


@register("count_gates", sql="""
SELECT conv_id, count(*) AS message_count,
       CASE WHEN count(*) = 0 THEN 'messages must be a non-empty array'
            WHEN count(*) > 4 THEN 'messages exceeds max count 4'
            WHEN conv_id % 11 > 8 THEN 'tools exceeds max count 8' END AS malformed_detail
FROM conversations GROUP BY conv_id
""")
def count_gates(spark, sf):
    """message count must be 1..max_message_count (4 here), and the tool
    count (conv_id mod 11 here) at most max_tool_count -> MALFORMED_INPUT."""
    m = _conv(spark, sf).groupBy("conv_id").agg(F.count(F.lit(1)).alias("message_count"))
    gate = count_gate(F.col("message_count"), F.col("conv_id") % 11, settings_struct(CONV_REQ))
    return m.select("conv_id", "message_count", gate.alias("malformed_detail"))


@register("input_payload", sql="""
SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 2 WHEN turn % 3 = 0 OR trim(text) = '' THEN NULL ELSE 1 END AS message_count,
       CASE WHEN turn % 5 <> 0 AND turn % 3 <> 0 AND trim(text) <> '' THEN CASE WHEN turn % 2 = 0 THEN role ELSE 'user' END
            WHEN turn % 5 = 0 THEN 'system' END AS first_role,
       CASE WHEN turn % 5 <> 0 AND turn % 3 <> 0 AND trim(text) <> '' THEN md5(text) WHEN turn % 5 = 0 THEN md5('be brief') END AS first_md5,
       turn % 5 <> 0 AND (turn % 3 = 0 OR trim(text) = '') AS malformed
FROM conversations
""")
def input_payload(spark, sf):
    """``messages`` win (every fifth turn here), else ``text`` becomes one
    message with its role, ``user`` by default; neither, or blank text (every
    third turn here), is malformed."""
    kind = "array<struct<role:string,content:string,parts:array<struct<type:string,text:string>>>>"
    parts = F.lit(None).cast("array<struct<type:string,text:string>>").alias("parts")
    given = F.array(F.struct(F.lit("system").alias("role"), F.lit("be brief").alias("content"), parts),
                    F.struct(F.col("role"), F.col("text").alias("content"), parts))
    turn = F.col("turn")
    msgs = input_messages(F.when(turn % 5 == 0, given.cast(kind)), F.when(turn % 3 == 0, F.lit(" \t")).otherwise(F.col("text")),
                          F.when(turn % 2 == 0, F.col("role")))
    c = _conv(spark, sf).select("conv_id", "turn", msgs.alias("m"))
    return c.select("conv_id", "turn", F.when(F.col("m").isNotNull(), F.size("m")).alias("message_count"),
                    F.get("m", F.lit(0))["role"].alias("first_role"), F.md5(F.get("m", F.lit(0))["content"]).alias("first_md5"),
                    F.col("m").isNull().alias("malformed"))


@register("assistant_text", sql="""
SELECT conv_id, count(*) AS n_choices,
       CAST(length(string_agg(CASE WHEN text <> '' THEN text END, chr(10) ORDER BY turn)) AS BIGINT) AS n_chars,
       md5(string_agg(CASE WHEN text <> '' THEN text END, chr(10) ORDER BY turn)) AS text_md5
FROM conversations WHERE role = 'assistant' GROUP BY conv_id
""")
def assistant_text_q(spark, sf):
    """P5: every assistant message of a conversation as one choice; contents joined."""
    a = _conv(spark, sf).where(F.col("role") == "assistant")
    m = conversation_messages(a, conv_id="conv_id", turn="turn", role="role", text="text")
    resp = F.struct(F.transform("messages", lambda x: F.struct(x.alias("message"))).alias("choices"))
    t = assistant_text(resp)
    return m.select("conv_id", F.col("message_count").alias("n_choices"), F.length(t).cast("bigint").alias("n_chars"),
                    F.md5(t).alias("text_md5"))


@register("output_payload", sql="""
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'response' ELSE 'text' END AS source,
       text IS NULL OR trim(text) = '' AS malformed,
       CASE WHEN text IS NULL OR trim(text) = '' THEN NULL ELSE CAST(length(text) AS BIGINT) END AS n_chars
FROM (SELECT conv_id, turn, role, CASE WHEN turn % 4 = 0 THEN '  ' ELSE text END AS text FROM conversations)
""")
def output_payload(spark, sf):
    """Assistant rows carry a ``response`` (wins), others plain ``text``;
    blank ones (every fourth turn here) are malformed."""
    c = _conv(spark, sf).withColumn("text", F.when(F.col("turn") % 4 == 0, "  ").otherwise(F.col("text")))
    parts_t = "array<struct<type:string,text:string>>"
    resp = F.when(F.col("role") == "assistant", F.struct(F.array(F.struct(F.struct(
        F.col("role").alias("role"), F.col("text").alias("content"), F.lit(None).cast(parts_t).alias("parts"))
        .alias("message"))).alias("choices")))
    t = output_text(resp, F.when(F.col("role") != "assistant", F.col("text")))
    return c.select("conv_id", "turn",
                    F.when(F.col("role") == "assistant", "response").otherwise("text").alias("source"),
                    t.isNull().alias("malformed"), F.length(t).cast("bigint").alias("n_chars"))


@register("phase1", sql=f"""
SELECT conv_id, turn,
  CASE WHEN length(text) > lim OR len(hits) > 0 OR pat IS NOT NULL OR (stream AND turn > 4) THEN 'block' ELSE 'pass' END AS p1_action,
  CASE WHEN length(text) > lim THEN 'INPUT_TOO_LONG' WHEN len(hits) > 0 THEN 'BLOCKLIST_MATCH'
       WHEN pat IS NOT NULL THEN 'PROMPT_INJECTION_PATTERN' WHEN stream AND turn > 4 THEN 'STREAM_TOOL_LIMIT' END AS reason_code,
  CASE WHEN length(text) > lim THEN 'Input exceeded max chars ' || CAST(lim AS VARCHAR)
       WHEN len(hits) > 0 THEN 'Input matched blocklist terms: ' || array_to_string(hits[1:5], ', ')
       WHEN pat IS NOT NULL THEN 'Input matched pattern ' || pat
       WHEN stream AND turn > 4 THEN 'Streaming requests allow fewer tools' ELSE 'phase1_pass' END AS detail
FROM (SELECT conv_id, turn, text, turn >= 4 AS stream, CASE WHEN turn >= 4 THEN 150 ELSE 300 END AS lim,
             {sql_term_hits(sql_casefold('text'), CONV_RULES.terms)} AS hits,
             {sql_first_pattern('text', CONV_RULES.patterns)} AS pat
      FROM conversations WHERE role = 'user')
""")
def phase1_q(spark, sf):
    """user turns; from turn 4 on the request is streamed with ``turn`` tools."""
    u = _canon_rows(spark, sf).where(F.col("role") == "user")
    stream = F.col("turn") >= 4
    p1 = phase1(F.col("text"), F.col("key"), stream, F.col("turn").cast("int"), F.lit(False),
                settings_struct(CONV_REQ), Rules(CONV_RULES.effective()))
    return u.select("conv_id", "turn", p1["action"].alias("p1_action"), p1["reason_code"].alias("reason_code"),
                    p1["detail"].alias("detail"))


def conv_decisions(spark, sf, rows: DataFrame | None = None, keep: list[str] = []) -> DataFrame:
    """F13 evaluate_text: user rows take the input chain, assistant rows the
    output chain, other roles give an error row; one scan, one projection."""
    rows = _canon_rows(spark, sf) if rows is None else rows
    direction = F.when(F.col("role") == "user", "input").when(F.col("role") == "assistant", "output").otherwise("other")
    dec = evaluate(rows, direction, req=CONV_REQ, glob=DEFAULTS, rules=Rules(CONV_RULES.effective()), drop_text=True)
    return dec.select("conv_id", "turn", "stage", "action", "reason_code", "detail", "reached", *keep)


_CONV_IN = chain_sql("SELECT conv_id, turn, text FROM conversations WHERE role = 'user'", "conv_id, turn",
                     "input", CONV_RULES, 300, False)
_CONV_OUT = chain_sql("SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'", "conv_id, turn",
                      "output", CONV_RULES, 1500, False)
_CONV_BAD = ("SELECT conv_id, turn, NULL AS stage, 'error' AS action, 'MALFORMED_INPUT' AS reason_code, "
             "'direction must be input or output' AS detail, false AS gated "
             "FROM conversations WHERE role NOT IN ('user', 'assistant')")
_CONV_ALL = f"({_CONV_IN}) UNION ALL ({_CONV_OUT}) UNION ALL ({_CONV_BAD})"


@register("evaluate_text", sql=f"SELECT conv_id, turn, stage, action, reason_code, detail FROM ({_CONV_ALL})")
def evaluate_text(spark, sf):
    """direction-routed chains over every conversation turn."""
    return conv_decisions(spark, sf).drop("reached")


@register("request_totals", sql=f"SELECT count(*) AS requests FROM ({_CONV_ALL}) WHERE action <> 'error'")
def request_totals(spark, sf):
    """A1: checks counted; malformed (error) rows are not requests.  Whether a
    row is well-formed shows without judging it, so no text is read."""
    return _conv(spark, sf).where(F.col("role").isin("user", "assistant")).agg(F.count(F.lit(1)).alias("requests"))


@register("phase_hits", sql=f"""
SELECT phase, count(*) AS hits FROM (
  SELECT 'phase1' AS phase FROM ({_CONV_ALL}) WHERE stage = 'input'
  UNION ALL SELECT 'phase2' FROM ({_CONV_ALL}) WHERE stage IS NOT NULL AND NOT gated
  UNION ALL SELECT 'phase3' FROM ({_CONV_ALL}) WHERE stage IS NOT NULL AND NOT gated
) GROUP BY phase
""")
def phase_hits(spark, sf):
    """A3: rows that reached each phase; output checks never count phase 1."""
    return phase_hits_agg(conv_decisions(spark, sf))


@register("segment_concat", sql="""
SELECT conv_id, CAST(length(trim(string_agg(text, '' ORDER BY turn))) AS BIGINT) AS n_chars,
       md5(trim(string_agg(text, '' ORDER BY turn))) AS text_md5
FROM conversations GROUP BY conv_id
""")
def segment_concat_q(spark, sf):
    """Transcript segments concatenated in order and stripped."""
    s = segment_concat(_conv(spark, sf), key="conv_id", order="turn", text="text")
    return s.select("conv_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))
