"""Queries over ``documents`` (and ``labels``): canonicalisation, detection,
the input/output chains and their aggregates and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import formats as FMT

from ..functions.pii import DEFAULT_RECOGNIZERS, pii_spans
from ..functions.rules import term_entries
from ..operators.decide import toxicity_score
from ..operators.detect import blocklist_hits, first_pattern_literal, hits_detail, pattern_ranks_literal, \
    term_hits, terms_literal, with_term_hits
from ..operators.sinks import audit_rows, write_audit
from ..session import scratch_path, table
from .chains import (DOC_RULES, PII_SQL, canon_docs, doc_decision_sql, doc_input_decisions,
                     doc_output_decisions, sql_casefold, sql_first_pattern, sql_str, sql_term_hits)
from .registry import register


# ------------------------------------------------------------------ P1, P2

@register("normalize_text", sql="""
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5
FROM (SELECT doc_id, regexp_replace(nfc_normalize(text), '^\\s+|\\s+$', '', 'g') AS t FROM documents)
""")
def normalize_text(spark, sf):
    """NFC + Unicode strip; length and digest of the canonical text."""
    d = canon_docs(spark, sf)
    return d.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("casefold_key", sql=f"""
SELECT doc_id, CAST(length(k) AS BIGINT) AS key_chars, md5(k) AS key_md5, contains(k, 'dass') AS has_dass
FROM (SELECT doc_id, {sql_casefold('text')} AS k FROM documents)
""")
def casefold_key(spark, sf):
    """Full casefold key (sharp s folds to 'ss')."""
    d = canon_docs(spark, sf)
    return d.select("doc_id", F.length("key").cast("bigint").alias("key_chars"), F.md5("key").alias("key_md5"),
                    (F.instr("key", "dass") > 0).alias("has_dass"))


# ------------------------------------------------------------------ F2, F3, F4, O1, J4, J5

@register("length_gate", sql="""
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars,
       length(text) > 12000 AS input_too_long, length(text) > 6000 AS stream_input_too_long,
       length(text) > 12000 AS output_too_long
FROM documents
""")
def length_gate(spark, sf):
    """strictly-longer-than limits (12000 input/output, 6000 streamed input)."""
    d = canon_docs(spark, sf)
    n = F.length("text")
    return d.select("doc_id", n.cast("bigint").alias("n_chars"), (n > 12000).alias("input_too_long"),
                    (n > 6000).alias("stream_input_too_long"), (n > 12000).alias("output_too_long"))


@register("blocklist_match", sql=f"""
SELECT doc_id, CAST(len(hits) AS BIGINT) AS n_hits,
       'Input matched blocklist terms: ' || array_to_string(hits[1:5], ', ') AS detail
FROM (SELECT doc_id, {sql_term_hits(sql_casefold('text'), DOC_RULES.terms)} AS hits FROM documents)
WHERE len(hits) > 0
""")
def blocklist_match(spark, sf):
    """casefold containment of a phrase table, sorted hits, first five in detail."""
    hits = with_term_hits(canon_docs(spark, sf), ["doc_id"], "key", _term_table(spark, DOC_RULES.terms))
    return (hits.where(F.size("hits") > 0)
            .select("doc_id", F.size("hits").cast("bigint").alias("n_hits"),
                    hits_detail(F.col("hits"), "Input matched blocklist terms: ").alias("detail")))


@register("pattern_match", sql=f"""
SELECT doc_id, pat AS pattern
FROM (SELECT doc_id, {sql_first_pattern('text', DOC_RULES.patterns)} AS pat FROM documents)
WHERE pat IS NOT NULL
""")
def pattern_match(spark, sf):
    """first pattern in list order with a case-insensitive hit."""
    d = canon_docs(spark, sf)
    pat = first_pattern_literal(F.col("text"), DOC_RULES.patterns)
    return d.select("doc_id", pat.alias("pattern")).where(F.col("pattern").isNotNull())


@register("sorted_hits", sql=f"""
SELECT doc_id, array_to_string(hits[1:5], ', ') AS first_hits
FROM (SELECT doc_id, {sql_term_hits(sql_casefold('text'), DOC_RULES.terms)} AS hits FROM documents)
WHERE len(hits) > 0
""")
def sorted_hits(spark, sf):
    """O1: distinct hits sorted by code point, first five joined."""
    d = canon_docs(spark, sf)
    hits = blocklist_hits(F.col("key"), terms_literal(DOC_RULES.terms))
    return (d.select("doc_id", hits.alias("hits")).where(F.size("hits") > 0)
            .select("doc_id", F.array_join(F.slice("hits", 1, 5), ", ").alias("first_hits")))


def _term_table(spark, terms):
    return spark.createDataFrame([(t, k) for t, k in term_entries(terms)], "term string, key string")


@register("terms_theta", sql=f"""
SELECT doc_id, unnest(hits) AS term
FROM (SELECT doc_id, {sql_term_hits(sql_casefold('text'), DOC_RULES.terms)} AS hits FROM documents)
""")
def terms_theta(spark, sf):
    """Text x terms containment, one row per hit, over the anchors of a term
    table (never a nested loop)."""
    d = canon_docs(spark, sf)
    return term_hits(d, ["doc_id"], "key", _term_table(spark, DOC_RULES.terms))


_PAT_UNION = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS rank, {sql_str(p)} AS pattern FROM documents "
    f"WHERE regexp_matches(text, {sql_str('(?i)' + p)})"
    for i, p in enumerate(DOC_RULES.patterns))


@register("patterns_theta", sql=_PAT_UNION)
def patterns_theta(spark, sf):
    """Every matching pattern with its list rank, long form."""
    d = canon_docs(spark, sf)
    return (d.select("doc_id", F.explode(pattern_ranks_literal(F.col("text"), DOC_RULES.patterns)).alias("p"))
            .select("doc_id", "p.rank", "p.pattern"))


# ------------------------------------------------------------------ F7, U1

def _pii_sql_one(entity: str, pat: str, score: float) -> str:
    p = sql_str("(?i)" + pat)
    return f"""
SELECT doc_id, {sql_str(entity)} AS entity_type,
  CAST(coalesce(list_sum(list_transform(gs[1:i], lambda g: length(g))), 0)
     + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start,
  CAST(coalesce(list_sum(list_transform(gs[1:i], lambda g: length(g))), 0)
     + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0) AS INTEGER) AS "end",
  CAST({score!r} AS DOUBLE) AS score
FROM (SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS ms, regexp_split_to_array(text, {p}) AS gs
            FROM documents) WHERE len(ms) > 0)"""


PII_LONG_SQL = " UNION ALL ".join(
    _pii_sql_one(r.entity_type, sql_pat, r.score) for r, sql_pat in zip(DEFAULT_RECOGNIZERS, PII_SQL))


@register("pii_spans", sql=PII_LONG_SQL)
def pii_spans_q(spark, sf):
    """every recogniser hit with code-point offsets, long form."""
    d = canon_docs(spark, sf)
    return (d.select("doc_id", F.explode(pii_spans(F.col("text"))).alias("s"))
            .select("doc_id", "s.entity_type", "s.start", "s.end", "s.score"))


@register("regex_recognizer", sql=f"""
SELECT entity_type, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM ({PII_LONG_SQL}) GROUP BY entity_type
""")
def regex_recognizer(spark, sf):
    """The recogniser table drives the span finder; hits and documents per entity."""
    d = canon_docs(spark, sf)
    spans = d.select("doc_id", F.explode(pii_spans(F.col("text"), DEFAULT_RECOGNIZERS)).alias("s"))
    return spans.groupBy(F.col("s.entity_type").alias("entity_type")).agg(
        F.count(F.lit(1)).alias("hits"), F.countDistinct("doc_id").alias("docs"))


# ------------------------------------------------------------------ F8, F10, F11, F12

@register("toxicity_score", sql="""
SELECT doc_id, greatest(CAST(toxic AS DOUBLE), CAST(1 - quality AS DOUBLE)) AS score FROM labels
""")
def toxicity_score_q(spark, sf):
    """F8: max over the label scores of each scored document."""
    lab = table(spark, sf, "labels")
    scores = F.create_map(F.lit("toxic"), F.col("toxic").cast("double"),
                          F.lit("low_quality"), (1 - F.col("quality")).cast("double"))
    return lab.select("doc_id", toxicity_score(scores).alias("score"))


@register("phase2", sql=f"""
SELECT doc_id, NOT gated AS ran,
       CAST(CASE WHEN gated THEN 0 ELSE npii END AS BIGINT) AS n_pii,
       CASE WHEN gated THEN NULL ELSE CAST(coalesce(toxic, 0) AS DOUBLE) END AS tox_score
FROM (WITH {doc_decision_sql('input')}
      SELECT dec.doc_id, dec.gated, l.toxic,
        (SELECT count(*) FROM ({PII_LONG_SQL}) p WHERE p.doc_id = dec.doc_id) AS npii
      FROM dec LEFT JOIN labels l ON l.doc_id = dec.doc_id)
""")
def phase2_q(spark, sf):
    """analyzers gathered for rows that passed phase 1."""
    dec = doc_input_decisions(spark, sf)
    ran = F.coalesce(F.col("phase2.ran"), F.lit(False))
    return dec.select(
        "doc_id", ran.alias("ran"),
        F.coalesce(F.size("phase2.pii.results"), F.lit(0)).cast("bigint").alias("n_pii"),
        F.when(ran, F.col("phase2.toxicity.score")).alias("tox_score"))


@register("phase3", sql=f"""
WITH {doc_decision_sql('input')}
SELECT doc_id, CASE WHEN reason_code IS NULL THEN 'pass' ELSE 'gray' END AS p3_action,
       CASE WHEN reason_code IS NULL THEN 'safe' ELSE substr(detail, {len(FMT.MSG_ENFORCED)} + 1) END AS decision,
       reason_code
FROM dec WHERE NOT gated
""")
def phase3_q(spark, sf):
    """the banding ladder for rows that reached phase 3."""
    dec = doc_input_decisions(spark, sf)
    return dec.where(F.col("phase3").isNotNull()).select(
        "doc_id", F.col("phase3.action").alias("p3_action"), F.col("phase3.decision").alias("decision"),
        F.col("phase3.reason_code").alias("reason_code"))


@register("final_action", sql=f"""
WITH {doc_decision_sql('output', enforce=False)}
SELECT doc_id, action, reason_code, detail FROM dec
""")
def final_action_q(spark, sf):
    """F12 under observe mode: gray rows are observed, not blocked (output chain)."""
    from ..operators.decide import Analyzers, Rules, evaluate_output
    from .chains import DOC_GLOB, DOC_REQ, with_doc_labels

    dec = evaluate_output(canon_docs(spark, sf), req=DOC_REQ.with_(phase3_mode="observe"), glob=DOC_GLOB,
                          rules=Rules(DOC_RULES), analyzers=Analyzers(tox_scores="tox"), drop_text=True,
                          enrich=with_doc_labels(spark, sf))
    return dec.select("doc_id", "action", "reason_code", "detail")


_FAULT_SQL = "CASE WHEN d.doc_id % 10 = 1 THEN 'timeout' WHEN d.doc_id % 10 = 2 THEN 'model not ready' END"


@register("analyzer_outcomes", sql=f"""
SELECT doc_id, CASE WHEN failed THEN 'allow' ELSE action END AS action,
       CASE WHEN NOT failed THEN reason_code WHEN fault = 'timeout' THEN 'ANALYZER_TIMEOUT_OBSERVE' END AS reason_code,
       CASE WHEN NOT failed THEN detail WHEN fault = 'timeout' THEN {sql_str(FMT.MSG_TIMEOUT + 'toxicity')} ELSE {sql_str(FMT.MSG_ALLOW)} END AS detail,
       CASE WHEN NOT gated AND fault = 'timeout' THEN 'toxicity' ELSE '' END AS timeouts,
       CASE WHEN NOT gated AND fault <> 'timeout' THEN 'toxicity: ' || fault ELSE '' END AS errors
FROM (WITH {doc_decision_sql('output', enforce=False)}
      SELECT dec.*, {_FAULT_SQL} AS fault, NOT gated AND fault IS NOT NULL AND coalesce(reason_code, '') <> 'PII_DETECTED' AS failed
      FROM dec JOIN documents d ON d.doc_id = dec.doc_id)
""")
def analyzer_outcomes(spark, sf):
    """Toxicity comes from a model hook that fails on some rows and
    times out on others; what the others found decides, and a timeout alone
    allows with a reason."""
    from ..operators.decide import Analyzers, Rules, evaluate_output
    from ..operators.semantic import make_outcome_udf
    from .chains import DOC_GLOB, DOC_REQ

    def load():
        def model(batch):
            for fault in batch["fault"].dropna():
                raise TimeoutError("timeout") if fault == "timeout" else RuntimeError(fault)
            return batch[["toxic"]].fillna(0.0)
        return model

    outcome = make_outcome_udf(["toxic"], load)
    fault = F.when(F.col("doc_id") % 10 == 1, "timeout").when(F.col("doc_id") % 10 == 2, "model not ready")
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("double").alias("toxic"))

    def enrich(df):
        out = df.join(labels, "doc_id", "left").withColumn("_o", outcome(F.struct("toxic", fault.alias("fault"))))
        return out.withColumns({"tox": F.col("_o.scores"), "tox_error": F.col("_o.error")}).drop("_o")

    dec = evaluate_output(canon_docs(spark, sf), req=DOC_REQ.with_(phase3_mode="observe"), glob=DOC_GLOB, rules=Rules(DOC_RULES),
                          analyzers=Analyzers(tox_scores="tox", tox_error="tox_error"), drop_text=True, enrich=enrich)
    none = F.array().cast("array<string>")
    errors = F.transform("phase2.errors", lambda e: F.concat(e["analyzer"], F.lit(": "), e["error"]))
    return dec.select("doc_id", "action", "reason_code", "detail", F.array_join(F.coalesce("phase2.timeouts", none), ", ").alias("timeouts"),
                      F.array_join(F.coalesce(errors, none), ", ").alias("errors"))


# ------------------------------------------------------------------ A2 (flagship), A4, S4, P11

@register("blocks_by_reason", sql=f"""
WITH {doc_decision_sql('input')}
SELECT reason_code, count(*) AS blocks FROM dec WHERE action = 'block' GROUP BY reason_code
""")
def blocks_by_reason(spark, sf):
    """A2: blocks per reason code (documents through the input chain, enforce mode)."""
    dec = doc_input_decisions(spark, sf)
    return dec.where(F.col("action") == "block").groupBy("reason_code").agg(F.count(F.lit(1)).alias("blocks"))


@register("final_actions", sql=f"""
WITH {doc_decision_sql('output')}
SELECT action, count(*) AS n FROM dec GROUP BY action
""")
def final_actions(spark, sf):
    """A4: rows per final action (documents through the output chain)."""
    dec = doc_output_decisions(spark, sf)
    return dec.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@register("audit_sink", sql=f"""
WITH {doc_decision_sql('output')}
SELECT CAST(doc_id AS VARCHAR) AS request_id, 'documents' AS slot, '/guardrails/output/check' AS path, false AS stream,
       'default' AS policy_id, CAST(1 AS INTEGER) AS policy_version, action AS final_action, reason_code,
       CASE WHEN gated THEN NULL ELSE 'gray' END AS p3_action, NOT gated AS has_phase2
FROM dec WHERE action <> 'allow'
""")
def audit_sink(spark, sf):
    """One full audit record per non-allow decision, appended as JSON lines
    to the shared folder and read back."""
    path = scratch_path(spark, "audit")
    dec = doc_output_decisions(spark, sf)
    write_audit(audit_rows(dec, F.col("doc_id").cast("string"), slot="documents", path="/guardrails/output/check",
                           policy_id=F.lit("default"), policy_version=F.lit(1)), path)
    v = F.parse_json("value")
    get = lambda p, kind: F.variant_get(v, f"$.{p}", kind)
    return spark.read.text(path).select(
        *(get(c, "string").alias(c) for c in ("request_id", "slot", "path")), get("stream", "boolean").alias("stream"),
        get("policy_id", "string").alias("policy_id"), get("policy_version", "int").alias("policy_version"),
        get("final_action", "string").alias("final_action"), get("reason_code", "string").alias("reason_code"),
        get("phase3.action", "string").alias("p3_action"), get("phase2.ran", "boolean").isNotNull().alias("has_phase2"))


@register("decision_struct", sql=f"""
WITH {doc_decision_sql('output')}
SELECT CAST(doc_id AS VARCHAR) AS request_id, 'output' AS stage, action, reason_code, detail,
       'default' AS applied_policy_id, '1' AS applied_policy_version,
       CAST(NULL AS VARCHAR) AS p1_action, CASE WHEN gated THEN NULL WHEN reason_code IS NULL THEN 'pass' ELSE 'gray' END AS p3_action,
       (SELECT CAST(length(text) AS BIGINT) FROM documents d WHERE d.doc_id = dec.doc_id) AS n_output_chars
FROM dec
""")
def decision_struct_q(spark, sf):
    """Result shape with metadata merged with the applied policy id/version."""
    from ..operators.decide import decision_struct

    dec = doc_output_decisions(spark, sf)
    out = decision_struct(dec, "doc_id", F.lit("default"), F.lit(1), F.struct(F.col("n_output_chars")))
    return out.select(
        F.col("decision.request_id").alias("request_id"), F.col("decision.stage").alias("stage"),
        F.col("decision.action").alias("action"), F.col("decision.reason_code").alias("reason_code"),
        F.col("decision.detail").alias("detail"),
        F.col("decision.metadata").getItem("applied_policy_id").alias("applied_policy_id"),
        F.col("decision.metadata").getItem("applied_policy_version").alias("applied_policy_version"),
        F.col("decision.phase1.action").alias("p1_action"), F.col("decision.phase3.action").alias("p3_action"),
        F.col("decision.normalized.n_output_chars").alias("n_output_chars"))
