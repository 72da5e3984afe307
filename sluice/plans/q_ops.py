"""Operations and source queries: config upsert, payload kinds, log scans,
key inserts, generation validation, term/rule/run-file sources, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import formats as FMT
from ..functions.rules import DEFAULT_PATTERNS
from ..operators import ops as O
from ..operators.sinks import exposition_lines, metric_rows
from ..session import scratch_path, table
from ..sources.files import latest_run_files, load_rules, load_terms, rules_from_json
from .chains import doc_decision_sql, doc_output_decisions, sql_str
from .registry import register


@register("kv_upsert", sql="""
WITH b AS (SELECT 'N' || CAST(c_nationkey AS VARCHAR) AS k, arg_max(c_name, c_custkey) AS last_v,
                  arg_min(c_name, c_custkey) AS first_v, count(*) AS n FROM customer WHERE c_nationkey < 20 GROUP BY 1),
     u AS (SELECT 'N' || CAST(s_nationkey AS VARCHAR) AS k, arg_max(s_name, s_suppkey) AS upd FROM supplier WHERE s_nationkey > 4 GROUP BY 1)
SELECT coalesce(b.k, u.k) AS "key", coalesce(upd, last_v) AS last_value, coalesce(upd, first_v) AS first_value,
       CAST(coalesce(n, 1) AS BIGINT) AS n_lines,
       CASE WHEN n IS NULL THEN 'appended' WHEN upd IS NOT NULL THEN 'updated' ELSE 'kept' END AS status
FROM b FULL OUTER JOIN u ON b.k = u.k
""")
def kv_upsert(spark, sf):
    """Customer rows as KEY=VALUE lines (nations below 20), supplier rows as
    upserts (above 4), so keys are kept, updated and appended."""
    base = table(spark, sf, "customer").where("c_nationkey < 20").select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("key"),
                                               F.col("c_name").alias("value"), F.col("c_custkey").alias("line_no"))
    upd = table(spark, sf, "supplier").where("s_nationkey > 4").select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("key"),
                                              F.col("s_name").alias("value"), F.col("s_suppkey").alias("ord"))
    return O.kv_upsert(base, upd, key="key", value="value", line_no="line_no", order="ord")


@register("payload_kind", sql="""
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'empty' WHEN 1 THEN 'json_error' WHEN 2 THEN 'wav' WHEN 3 THEN 'mp3' ELSE 'other' END AS kind
FROM documents WHERE text IS NOT NULL
""")
def payload_kind(spark, sf):
    """D3: response bodies classified by leading bytes.  By doc_id a document
    is emptied, wrapped as a JSON error, given an audio header, wrapped as JSON
    with an empty error, or left as it is."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    kind, text = F.col("doc_id") % 7, F.col("text")
    json = lambda e: F.to_json(F.struct(text.alias("data"), F.lit(e).alias("error")))
    body = (F.when(kind == 0, F.lit("")).when(kind == 1, json("no such model")).when(kind == 2, F.concat(F.lit("RIFF"), text))
            .when(kind == 3, F.concat(F.lit("ID3"), text)).when(kind == 4, json("")).otherwise(text))
    return d.select("doc_id", O.payload_kind(body).alias("kind"))


LOG_PATTERN = "(license|token|reserved)"
#: Matches in few services only, so others pass the scan.
RARE_PATTERN = "gnu general public license"
_LINES_SQL = """
lines AS (
  SELECT source AS service, doc_id, i - 1 AS line_idx, parts[i] AS line
  FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents),
       LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)
)"""


def _lines(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "text")
    return O.log_lines(d, service="source", doc="doc_id", text="text").withColumnRenamed("source", "service")


@register("log_scan", sql=f"""
WITH {_LINES_SQL}
SELECT service, count(*) FILTER (hit) AS hit_lines,
       arg_max(regexp_extract(line, '(?i){RARE_PATTERN}', 0), doc_id * 100000 + line_idx) FILTER (hit) AS last_match,
       count(*) FILTER (hit) > 0 AS failed
FROM (SELECT *, regexp_matches(line, '(?i){RARE_PATTERN}') AS hit FROM lines) GROUP BY service
""")
def log_scan(spark, sf):
    """Per service (document source), lines matching the error regex;
    services without a hit are reported as passed."""
    return O.log_scan(_lines(spark, sf), service="service", pattern=RARE_PATTERN, order=["doc_id", "line_idx"]) \
        .select("service", "hit_lines", "last_match", "failed")


@register("first_log_hits", sql=f"""
WITH {_LINES_SQL}
SELECT service, doc_id, CAST(line_idx AS INTEGER) AS line_idx, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY service ORDER BY doc_id, line_idx) AS rn
  FROM lines WHERE regexp_matches(line, '(?i){LOG_PATTERN}')) WHERE rn <= 20
""")
def first_log_hits(spark, sf):
    """O2: the first 20 matching lines per service with their position."""
    h = O.first_log_hits(_lines(spark, sf), service="service", pattern=LOG_PATTERN, order=["doc_id", "line_idx"])
    return h.select("service", "doc_id", "line_idx", F.col("rn").cast("bigint").alias("rn"))


@register("new_keys_only", sql="""
SELECT c_custkey AS "key", c_name AS name, 'existing' AS source FROM customer
UNION ALL
SELECT p_partkey, p_name, 'inserted' FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)
""")
def new_keys_only(spark, sf):
    """Part keys inserted into the customer key space only when absent."""
    ex = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    cand = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    return O.new_keys_only(ex, cand, "key").select("key", "name", "source")


_GEN_SQL_CHECKS = ", ".join(
    f"CASE WHEN {cond.replace('RLIKE', 'SIMILAR TO').replace('^(b64_json)$', '(b64_json)')} THEN '{name}' END"
    for name, cond in O.GEN_RULES)


@register("validate_generation", sql=f"""
SELECT p_partkey, CAST(len(v) AS INTEGER) AS n_violations, array_to_string(v, ',') AS violations
FROM (SELECT p_partkey, list_filter([{_GEN_SQL_CHECKS}], lambda x: x IS NOT NULL) AS v
      FROM (SELECT p_partkey, repeat(p_name, p_size * 10) AS prompt, NULL AS negative_prompt, p_size * 16 AS height,
                   1024 - p_size * 16 AS width, p_size + 5 AS num_inference_steps, p_retailprice / 100 AS guidance_scale,
                   1 + p_size // 20 AS num_images, CASE WHEN p_type = 'PROMO' THEN 'url' ELSE 'b64_json' END AS response_format
            FROM part))
""")
def validate_generation(spark, sf):
    """Image-generation request rules over requests derived from ``part``."""
    p = table(spark, sf, "part")
    req = p.select("p_partkey", F.expr("repeat(p_name, p_size * 10)").alias("prompt"),
                   F.lit(None).cast("string").alias("negative_prompt"), (F.col("p_size") * 16).alias("height"),
                   (1024 - F.col("p_size") * 16).alias("width"), (F.col("p_size") + 5).alias("num_inference_steps"),
                   (F.col("p_retailprice") / 100).alias("guidance_scale"),
                   (1 + F.floor(F.col("p_size") / 20)).alias("num_images"),
                   F.when(F.col("p_type") == "PROMO", "url").otherwise("b64_json").alias("response_format"))
    v = O.validate_generation(req)
    return v.select("p_partkey", F.size("violations").alias("n_violations"),
                    F.array_join("violations", ",").alias("violations"))


@register("load_terms", sql="""
SELECT regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS term, count(*) AS n
FROM (SELECT unnest(string_split(CASE item_id % 3 WHEN 0 THEN '# ' WHEN 1 THEN '  ' ELSE '' END || text || chr(10) || '  ', chr(10))) AS line
      FROM benchmark)
WHERE length(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) > 0 AND NOT starts_with(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '#')
GROUP BY ALL
""")
def load_terms_q(spark, sf):
    """Phrase files (strip, drop blank and '#' lines) written from the
    ``benchmark`` texts to the shared folder and read back."""
    path = scratch_path(spark, "terms")
    lead = F.when(F.col("item_id") % 3 == 0, "# ").when(F.col("item_id") % 3 == 1, "  ").otherwise("")
    table(spark, sf, "benchmark").select(F.concat(lead, F.col("text"), F.lit("\n  "))).write.text(path)
    return load_terms(spark, path).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@register("load_rules", sql=f"""
SELECT event_id % 4 AS doc_kind, count(*) AS n_docs,
       CAST(sum(CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE {len(DEFAULT_PATTERNS)} END) AS BIGINT) AS n_patterns
FROM events GROUP BY 1
""")
def load_rules_q(spark, sf):
    """Rule documents made of the events' ``props``: with two patterns, an
    empty list, no such key, or broken; each file read as one document."""
    e = table(spark, sf, "events")
    kind = F.col("event_id") % 4
    doc = (F.when(kind == 0, F.concat(F.lit('{"a": '), F.col("props"), F.lit(', "prompt_injection_patterns": ["x\\\\s+y", "z"]}')))
           .when(kind == 1, F.lit('{"prompt_injection_patterns": []}')).when(kind == 2, F.col("props")).otherwise(F.lit("{not json")))
    rules = e.select(kind.alias("doc_kind"), rules_from_json(doc).alias("p"))
    return rules.groupBy("doc_kind").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("p")).cast("bigint").alias("n_patterns"))


@register("load_rule_files", sql=f"""
SELECT CASE item_id % 4 WHEN 0 THEN coalesce(text, '') || '|z' WHEN 1 THEN '' ELSE {sql_str('|'.join(DEFAULT_PATTERNS))} END AS patterns, count(*) AS n_files
FROM benchmark GROUP BY 1
""")
def load_rule_files_q(spark, sf):
    """S2 through its reader: every ``benchmark`` item becomes a rules file of
    its own (two patterns, an empty list, no such key, or broken)."""
    path = scratch_path(spark, "rules")
    kind, key = F.col("item_id") % 4, "prompt_injection_patterns"
    given = lambda *p: F.to_json(F.struct(F.array(*p).cast("array<string>").alias(key)))
    doc = (F.when(kind == 0, given(F.coalesce("text", F.lit("")), F.lit("z"))).when(kind == 1, given())
           .when(kind == 2, F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("note")))).otherwise(F.lit("{not json")))
    table(spark, sf, "benchmark").select(doc.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return load_rules(spark, path).groupBy(F.array_join(key, "|").alias("patterns")).agg(F.count(F.lit(1)).alias("n_files"))


@register("latest_run_files", sql="""
SELECT source AS run_id, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS total_bytes
FROM documents WHERE source = (SELECT min(source) FROM documents) GROUP BY source
""")
def latest_run_files_q(spark, sf):
    """Documents written as probe-run directories (one per source) into
    the shared checkpoint folder by Spark's writer, the run of the smallest name
    last, read back with the binaryFile source; bytes of the newest run's files."""
    root = scratch_path(spark, "runs")
    docs = table(spark, sf, "documents").select("source", "text").where("source is not null")
    last = docs.agg(F.min("source")).scalar()
    docs.where(F.col("source") > last).write.partitionBy("source").text(root)
    docs.where(F.col("source") == last).write.mode("append").partitionBy("source").text(root)
    f = latest_run_files(spark, root)
    return f.groupBy("run_id").agg(F.sum("length").cast("bigint").alias("total_bytes"))


_COUNTERS = (FMT.METRIC_REQUESTS, FMT.METRIC_BLOCKS, FMT.METRIC_PHASE_HITS, FMT.METRIC_FINAL_ACTIONS, FMT.METRIC_TIMEOUTS,
             FMT.METRIC_RATE_LIMIT_HITS)


@register("metrics_rows", sql=f"""
WITH {doc_decision_sql('output')},
m AS (
  SELECT 0 AS family, '{FMT.METRIC_REQUESTS}' AS metric, NULL AS label_key, NULL AS label_value, CAST(count(*) AS DOUBLE) AS value FROM dec
  UNION ALL SELECT 1, '{FMT.METRIC_BLOCKS}', 'reason', reason_code, CAST(count(*) AS DOUBLE) FROM dec
            WHERE action = 'block' AND reason_code IS NOT NULL GROUP BY reason_code
  UNION ALL SELECT 2, '{FMT.METRIC_PHASE_HITS}', 'phase', 'phase2', CAST(count(*) AS DOUBLE) FROM dec WHERE NOT gated
  UNION ALL SELECT 2, '{FMT.METRIC_PHASE_HITS}', 'phase', 'phase3', CAST(count(*) AS DOUBLE) FROM dec WHERE NOT gated
  UNION ALL SELECT 3, '{FMT.METRIC_FINAL_ACTIONS}', 'action', action, CAST(count(*) AS DOUBLE) FROM dec GROUP BY action
  UNION ALL SELECT 4, '{FMT.METRIC_TIMEOUTS}', NULL, NULL, 0.0
  UNION ALL SELECT 5, '{FMT.METRIC_RATE_LIMIT_HITS}', NULL, NULL, 0.0
  UNION ALL SELECT 6, '{FMT.METRIC_LATENCY_AVG}', 'analyzer', event_type, CASE WHEN count(value) > 0 THEN sum(value) / count(value) ELSE 0.0 END
            FROM events GROUP BY event_type
),
t AS (SELECT unnest(range(0, 7)) AS family, unnest([{', '.join("'" + c + "'" for c in _COUNTERS)}, '{FMT.METRIC_LATENCY_AVG}']) AS metric)
SELECT family, '' AS label, '# TYPE ' || metric || CASE WHEN family = 6 THEN ' gauge' ELSE ' counter' END AS line FROM t
UNION ALL
SELECT family, coalesce(label_value, '') AS label,
       metric || CASE WHEN label_key IS NULL THEN '' ELSE '{{' || label_key || '="' || label_value || '"}}' END
              || ' ' || CASE WHEN family = 6 THEN printf('%.3f', value) ELSE CAST(CAST(value AS BIGINT) AS VARCHAR) END AS line
FROM m
""")
def metrics_rows(spark, sf):
    """The full exposition text of the documents output chain, with the
    events' values as analyzer latencies; (family, label) is the line order."""
    dec = doc_output_decisions(spark, sf)
    lat = table(spark, sf, "events").select(F.col("event_type").alias("analyzer"), F.col("value").alias("latency_ms"))
    return exposition_lines(metric_rows(dec, lat)).select("family", "label", "line")
