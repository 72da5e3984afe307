"""Shared chain set-ups over the driver tables, in Spark and in DuckDB SQL.

Rule parameters are chosen from words that occur in the generated prose
(the shipped phrases and patterns never occur in it), so every reason code
is exercised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import formats as FMT
from ..functions.pii import DEFAULT_RECOGNIZERS
from ..functions.rules import RuleSet
from ..functions.text import canon
from ..operators.decide import Analyzers, Rules, evaluate_input, evaluate_output
from ..session import table
from ..settings import DEFAULTS

DOC_RULES = RuleSet(
    terms=("daß", "license", "all rights reserved", "token"),
    patterns=(r"on\s+the\s+by", r"und\s+(der|die)"),
)
DOC_REQ = DEFAULTS.with_(phase3_mode="enforce")
DOC_GLOB = DEFAULTS


def canon_docs(spark: SparkSession, sf: str, name: str = "documents", id_col: str = "doc_id") -> DataFrame:
    c = canon(F.col("text"))
    return table(spark, sf, name).select(id_col, "text").select(id_col, c.alias("c")).select(
        id_col, "c.text", "c.key", F.length("c.text").cast("bigint").alias("n_output_chars"))


def with_doc_labels(spark: SparkSession, sf: str):
    """Late join of label-derived toxicity scores onto narrow rows."""
    labels = table(spark, sf, "labels").select(
        "doc_id", F.create_map(F.lit("toxic"), F.col("toxic").cast("double")).alias("tox"))

    def enrich(df: DataFrame) -> DataFrame:
        return df.join(labels, "doc_id", "left")

    return enrich


def doc_input_decisions(spark: SparkSession, sf: str, drop_text: bool = True) -> DataFrame:
    """Documents judged as input texts (no request time, so no rate limit)."""
    return evaluate_input(
        canon_docs(spark, sf), req=DOC_REQ, glob=DOC_GLOB, rules=Rules(DOC_RULES),
        analyzers=Analyzers(tox_scores="tox"), drop_text=drop_text, enrich=with_doc_labels(spark, sf),
    )


def doc_output_decisions(spark: SparkSession, sf: str, drop_text: bool = True) -> DataFrame:
    return evaluate_output(
        canon_docs(spark, sf), req=DOC_REQ, glob=DOC_GLOB, rules=Rules(DOC_RULES),
        analyzers=Analyzers(tox_scores="tox"), drop_text=drop_text, enrich=with_doc_labels(spark, sf),
    )


# ------------------------------------------------------------------ SQL side

def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_casefold(col: str) -> str:
    # Exact for the generated tables: the only casefold/lower difference in
    # them is sharp s.
    return f"replace(lower({col}), 'ß', 'ss')"


PII_SQL = tuple(r.regex for r in DEFAULT_RECOGNIZERS)


def sql_term_hits(key: str, terms) -> str:
    """Sorted list of original spellings whose casefold key occurs in ``key``."""
    from ..functions.rules import term_entries

    items = ", ".join(f"CASE WHEN contains({key}, {sql_str(k)}) THEN {sql_str(t)} END"
                      for t, k in term_entries(terms))
    return f"list_sort(list_filter([{items}], lambda x: x IS NOT NULL))"


def sql_first_pattern(text: str, patterns) -> str:
    whens = " ".join(f"WHEN regexp_matches({text}, {sql_str('(?i)' + p)}) THEN {sql_str(p)}" for p in patterns)
    return f"(CASE {whens} END)"


def sql_pii_count(text: str) -> str:
    parts = [f"len(regexp_extract_all({text}, {sql_str('(?i)' + p)}))" for p in PII_SQL]
    return "(" + " + ".join(parts) + ")"


def doc_decision_sql(direction: str = "input", rules: RuleSet = DOC_RULES, enforce: bool = True) -> str:
    """DuckDB CTE body 'dec' with doc_id, action, reason_code, detail, phase_n."""
    terms = sql_term_hits("key", rules.terms)
    mode_block = "'block'" if enforce else "'observe'"
    gray_detail = sql_str(FMT.MSG_ENFORCED if enforce else FMT.MSG_OBSERVED)
    if direction == "input":
        gate = f"""CASE WHEN length(text) > 12000 THEN 'INPUT_TOO_LONG'
                        WHEN len(hits) > 0 THEN 'BLOCKLIST_MATCH'
                        WHEN pat IS NOT NULL THEN 'PROMPT_INJECTION_PATTERN' END"""
        gate_detail = """CASE WHEN length(text) > 12000 THEN 'Input exceeded max chars 12000'
                        WHEN len(hits) > 0 THEN 'Input matched blocklist terms: ' || array_to_string(hits[1:5], ', ')
                        WHEN pat IS NOT NULL THEN 'Input matched pattern ' || pat END"""
    else:
        gate = """CASE WHEN length(text) > 12000 THEN 'OUTPUT_TOO_LONG'
                       WHEN len(hits) > 0 THEN 'BLOCKLIST_MATCH' END"""
        gate_detail = """CASE WHEN length(text) > 12000 THEN 'Output exceeded non-stream character limit'
                        WHEN len(hits) > 0 THEN 'Output matched blocklist terms: ' || array_to_string(hits[1:5], ', ') END"""
    pat = sql_first_pattern("text", rules.patterns) if direction == "input" else "NULL"
    return f"""
    base AS (
      SELECT d.doc_id, d.text, {sql_casefold('d.text')} AS key, l.toxic
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    ),
    feat AS (
      SELECT *, {terms} AS hits, {pat} AS pat FROM base
    ),
    g AS (
      SELECT doc_id, text, toxic, {gate} AS gate, {gate_detail} AS gate_detail FROM feat
    ),
    p3 AS (
      SELECT *, CASE WHEN gate IS NOT NULL THEN NULL
                     WHEN length(trim(text)) = 0 THEN 'safe'
                     WHEN {sql_pii_count('text')} > 0 THEN 'pii_detected'
                     WHEN coalesce(toxic, 0) >= 0.7 THEN 'toxicity_high'
                     WHEN coalesce(toxic, 0) <= 0.3 THEN 'safe'
                     ELSE 'review' END AS decision
      FROM g
    ),
    dec AS (
      SELECT doc_id,
        CASE WHEN gate IS NOT NULL THEN 'block' WHEN decision = 'safe' THEN 'allow' ELSE {mode_block} END AS action,
        CASE WHEN gate IS NOT NULL THEN gate
             WHEN decision = 'pii_detected' THEN 'PII_DETECTED'
             WHEN decision = 'toxicity_high' THEN 'TOXICITY_HIGH'
             WHEN decision = 'review' THEN 'GRAY_ZONE' END AS reason_code,
        CASE WHEN gate IS NOT NULL THEN gate_detail
             WHEN decision = 'safe' THEN {sql_str(FMT.MSG_ALLOW)}
             ELSE {gray_detail} || decision END AS detail,
        gate IS NOT NULL AS gated
      FROM p3
    )"""


def chain_sql(src: str, ids: str, direction: str, rules: RuleSet, max_len: int, enforce: bool,
              tox: str = "NULL") -> str:
    """Generic DuckDB decision chain over ``src`` (a SELECT with ``ids``, text
    and a toxicity score expression ``tox``), no rate limit, non-stream.

    Returns the SELECT body with ids, stage, action, reason_code, detail, gated.
    """
    hits = sql_term_hits(sql_casefold("text"), rules.terms)
    if direction == "input":
        pat = sql_first_pattern("text", rules.patterns)
        gate = f"""CASE WHEN length(text) > {max_len} THEN 'INPUT_TOO_LONG'
                        WHEN len(hits) > 0 THEN 'BLOCKLIST_MATCH'
                        WHEN pat IS NOT NULL THEN 'PROMPT_INJECTION_PATTERN' END"""
        gate_detail = f"""CASE WHEN length(text) > {max_len} THEN 'Input exceeded max chars {max_len}'
                        WHEN len(hits) > 0 THEN 'Input matched blocklist terms: ' || array_to_string(hits[1:5], ', ')
                        WHEN pat IS NOT NULL THEN 'Input matched pattern ' || pat END"""
    else:
        pat = "NULL"
        gate = f"""CASE WHEN length(text) > {max_len} THEN 'OUTPUT_TOO_LONG'
                       WHEN len(hits) > 0 THEN 'BLOCKLIST_MATCH' END"""
        gate_detail = f"""CASE WHEN length(text) > {max_len} THEN 'Output exceeded non-stream character limit'
                        WHEN len(hits) > 0 THEN 'Output matched blocklist terms: ' || array_to_string(hits[1:5], ', ') END"""
    gray_action = "'block'" if enforce else "'observe'"
    return f"""
SELECT {ids}, '{direction}' AS stage,
  CASE WHEN gate IS NOT NULL THEN 'block' WHEN decision = 'safe' THEN 'allow' ELSE {gray_action} END AS action,
  CASE WHEN gate IS NOT NULL THEN gate WHEN decision = 'pii_detected' THEN 'PII_DETECTED'
       WHEN decision = 'toxicity_high' THEN 'TOXICITY_HIGH' WHEN decision = 'review' THEN 'GRAY_ZONE' END AS reason_code,
  CASE WHEN gate IS NOT NULL THEN gate_detail WHEN decision = 'safe' THEN {sql_str(FMT.MSG_ALLOW)}
       ELSE {sql_str(FMT.MSG_ENFORCED if enforce else FMT.MSG_OBSERVED)} || decision END AS detail,
  gate IS NOT NULL AS gated
FROM (
  SELECT *, CASE WHEN gate IS NOT NULL THEN NULL
                 WHEN length(trim(text)) = 0 THEN 'safe'
                 WHEN {sql_pii_count('text')} > 0 THEN 'pii_detected'
                 WHEN coalesce(tox, 0) >= 0.7 THEN 'toxicity_high'
                 WHEN coalesce(tox, 0) <= 0.3 THEN 'safe'
                 ELSE 'review' END AS decision
  FROM (SELECT *, {gate} AS gate, {gate_detail} AS gate_detail
        FROM (SELECT *, {hits} AS hits, {pat} AS pat, {tox} AS tox FROM ({src})))
)"""
