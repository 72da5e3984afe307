"""The decision chain: F1 count_gates, F2 length_gate, F5 stream_tool_gate,
F6 phase1, F8 toxicity_score, F10 phase2, F11 phase3, F12 final_action,
F13 evaluate_input / evaluate_output / evaluate_text, P11 decision_struct.

Every step is a Column expression over one row, so a whole chain is one
narrow projection: no shuffle, whole-stage codegen for the JVM parts, and
CASE short-circuiting keeps the analyzers off rows already blocked.  The
only wide step of an input chain is the rate limiter (W1), which the caller
joins in as a ``limited`` boolean.

``req`` is the request-policy settings struct, ``glob`` the global-active
one (see ``sluice.settings``); both are Columns so they can be literals or
come per row from the policy join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import formats as FMT
from ..functions.pii import SPAN_TYPE, pii_spans
from ..functions.rules import RuleSet
from ..functions.text import is_blank
from ..settings import DEFAULTS, Settings, settings_struct
from .detect import (blocklist_hits, first_pattern_column, first_pattern_literal, hits_detail,
                     terms_literal)

P1_TYPE = "struct<action:string,reason_code:string,detail:string>"
P3_TYPE = "struct<action:string,decision:string,reason_code:string>"
TOX_TYPE = "struct<enabled:boolean,scores:map<string,double>,score:double,error:string>"
REL_TYPE = "struct<enabled:boolean,score:double,error:string,matched_label:string>"
PII_TYPE = f"struct<enabled:boolean,results:{SPAN_TYPE},error:string>"
ERR_TYPE = "array<struct<analyzer:string,error:string>>"
#: The error of an analyzer that gave no result in time (fixed value).
TIMEOUT = "timeout"


def _p1(action: str, reason, detail) -> Column:
    return F.struct(
        F.lit(action).alias("action"),
        (reason if isinstance(reason, Column) else F.lit(reason)).cast("string").alias("reason_code"),
        (detail if isinstance(detail, Column) else F.lit(detail)).cast("string").alias("detail"),
    )


@dataclass(frozen=True)
class Rules:
    """Where a chain gets its rules: a literal RuleSet or per-row columns."""

    literal: RuleSet | None = None
    terms_col: str = "terms"        # ARRAY<STRUCT<term,key>>
    patterns_col: str = "patterns"  # ARRAY<STRING>

    def term_array(self) -> Column:
        return terms_literal(self.literal.terms) if self.literal else F.col(self.terms_col)

    def first_pattern(self, text: Column) -> Column:
        if self.literal:
            return first_pattern_literal(text, self.literal.patterns)
        return first_pattern_column(text, F.col(self.patterns_col))


def lit_settings(s: Settings | Column) -> Column:
    return s if isinstance(s, Column) else settings_struct(s)


# ---------------------------------------------------------------- phase 1

def length_limit(req: Column, stream: Column) -> Column:
    return F.when(stream, req["max_stream_input_chars"]).otherwise(req["max_input_chars"])


def count_gate(message_count: Column, tool_count: Column | None, req: Column) -> Column:
    """MALFORMED_INPUT detail for bad message/tool counts, else null."""
    out = F.when(message_count.isNull() | (message_count == 0), F.lit(FMT.MSG_NO_MESSAGES)) \
        .when(message_count > req["max_message_count"],
              F.concat(F.lit(FMT.MSG_MANY_MESSAGES), req["max_message_count"].cast("string")))
    if tool_count is not None:
        out = out.when(tool_count > req["max_tool_count"],
                       F.concat(F.lit(FMT.MSG_MANY_TOOLS), req["max_tool_count"].cast("string")))
    return out


def stream_tool_blocked(stream: Column, tool_count: Column, req: Column) -> Column:
    """streaming with more than max(1, max_tool_count // 2) tools."""
    cap = F.greatest(F.lit(1), F.floor(req["max_tool_count"] / 2).cast("int"))
    return F.coalesce(stream, F.lit(False)) & (F.coalesce(tool_count, F.lit(0)) > cap)


def phase1(text: Column, key: Column, stream: Column, tool_count: Column, limited: Column,
           req: Column, rules: Rules) -> Column:
    """disabled -> rate -> length -> terms -> patterns -> stream/tool -> pass."""
    limit = length_limit(req, stream)
    hits = blocklist_hits(key, rules.term_array())
    pat = rules.first_pattern(text)
    return (
        F.when(~req["phase1_enabled"], _p1("pass", None, FMT.MSG_PHASE1_DISABLED))
        .when(F.coalesce(limited, F.lit(False)),
              _p1("block", "RATE_LIMITED", FMT.MSG_RATE_LIMITED))
        .when(F.length(text) > limit,
              _p1("block", "INPUT_TOO_LONG", F.concat(F.lit(FMT.MSG_INPUT_TOO_LONG), limit.cast("string"))))
        .when(F.size(hits) > 0, _p1("block", "BLOCKLIST_MATCH", hits_detail(hits, FMT.MSG_INPUT_TERMS)))
        .when(pat.isNotNull(), _p1("block", "PROMPT_INJECTION_PATTERN", F.concat(F.lit(FMT.MSG_INPUT_PATTERN), pat)))
        .when(stream_tool_blocked(stream, tool_count, req),
              _p1("block", "STREAM_TOOL_LIMIT", FMT.MSG_STREAM_TOOLS))
        .otherwise(_p1("pass", None, FMT.MSG_PHASE1_PASS))
    )


# ---------------------------------------------------------------- phase 2

def toxicity_score(scores: Column) -> Column:
    """F8: max label score, 0.0 when there are none."""
    return F.coalesce(F.array_max(F.map_values(scores)), F.lit(0.0))


@dataclass(frozen=True)
class Analyzers:
    """Where analyzer inputs come from (columns; None = analyzer has no input)."""

    tox_scores: str | None = None        # MAP<STRING,DOUBLE>
    relevance: str | None = None         # STRUCT<score,label> from best_match
    golden_size: str | None = None       # INT, size of the policy's golden set
    pii: bool = True
    # STRING columns: why an analyzer gave no result (null: it did; "timeout")
    pii_error: str | None = None
    tox_error: str | None = None
    relevance_error: str | None = None

    def error(self, name: str) -> Column:
        c = getattr(self, f"{name}_error")
        return F.col(c) if c else F.lit(None).cast("string")


def text_features(text: Column, req: Column, glob: Column, an: "Analyzers") -> Column:
    """The text-dependent half of phase 2: whether it runs, and the PII hits.

    Evaluated while the text is still in the row; everything after it works
    on these small columns, so side inputs can be joined once the wide text
    column has been dropped.
    """
    run = req["phase2_enabled"] & ~is_blank(text)
    pii_on = glob["pii_enabled"] & F.lit(an.pii)
    return F.struct(
        run.alias("run"),
        F.when(run & pii_on, pii_spans(text)).otherwise(F.array().cast(SPAN_TYPE)).alias("pii"),
    )


def phase2(feat: Column, req: Column, glob: Column, an: "Analyzers") -> Column:
    """analyzers gathered into one struct; skipped -> empty parts.

    An analyzer that failed is not enabled and has its error and no result; the
    names of those that timed out are ``timeouts``, other failures ``errors``.
    """
    run = feat["run"]
    nothing = F.lit(None)
    no_spans, no_scores = F.array().cast(SPAN_TYPE), F.create_map().cast("map<string,double>")

    def unless_failed(name, ok, **failed):
        """``ok``, or where the analyzer failed its error and ``failed``, in the
        order of the fields of ``ok``."""
        error = an.error(name)
        return F.when(error.isNotNull(), F.struct(F.lit(False).alias("enabled"), *(
            (error if f == "error" else c).alias(f) for f, c in failed.items()))).otherwise(ok)

    pii_on = glob["pii_enabled"] & F.lit(an.pii)
    pii = unless_failed("pii", F.struct(
        pii_on.alias("enabled"), F.when(pii_on, feat["pii"]).otherwise(no_spans).alias("results"), nothing.cast("string").alias("error")),
        results=no_spans, error=None)
    tox_on = glob["toxicity_enabled"] & F.lit(an.tox_scores is not None)
    scores = F.col(an.tox_scores) if an.tox_scores else no_scores
    tox = unless_failed("tox", F.struct(
        tox_on.alias("enabled"), F.when(tox_on, F.coalesce(scores, no_scores)).otherwise(no_scores).alias("scores"),
        F.when(tox_on, toxicity_score(scores)).otherwise(F.lit(0.0)).alias("score"), nothing.cast("string").alias("error")),
        scores=no_scores, score=nothing.cast("double"), error=None)
    gsize = F.col(an.golden_size) if an.golden_size else F.lit(0)
    rel_col = F.col(an.relevance) if an.relevance else nothing.cast("struct<score:double,label:string>")
    part = lambda on, score, error, label: F.struct(F.lit(on).alias("enabled"), score.cast("double").alias("score"),
                                                    error.cast("string").alias("error"), label.cast("string").alias("matched_label"))
    rel = unless_failed("relevance", (
        F.when(~req["relevance_enabled"], part(False, nothing, nothing, nothing))
        .when(F.coalesce(gsize, F.lit(0)) == 0, part(False, nothing, F.lit("golden_set_empty"), nothing))
        .otherwise(part(True, rel_col["score"], nothing, rel_col["label"]))),
        score=nothing.cast("double"), error=None, matched_label=nothing.cast("string"))
    failures = F.array(
        F.struct(F.lit("pii").alias("analyzer"), pii["error"].alias("error")),
        F.struct(F.lit("toxicity").alias("analyzer"), tox["error"].alias("error")),
        F.struct(F.lit("relevance").alias("analyzer"), rel["error"].alias("error")),
    )
    errors = F.filter(failures, lambda e: e["error"].isNotNull() & (e["error"] != TIMEOUT))
    timeouts = F.transform(F.filter(failures, lambda e: e["error"] == TIMEOUT), lambda e: e["analyzer"])
    return F.when(run, F.struct(
        req["phase2_mode"].alias("mode"), pii.alias("pii"), tox.alias("toxicity"), rel.alias("relevance"),
        timeouts.alias("timeouts"), errors.alias("errors"), F.lit(True).alias("ran"),
    )).otherwise(F.struct(
        req["phase2_mode"].alias("mode"), nothing.cast(PII_TYPE).alias("pii"),
        nothing.cast(TOX_TYPE).alias("toxicity"), nothing.cast(REL_TYPE).alias("relevance"),
        F.array().cast("array<string>").alias("timeouts"), F.array().cast(ERR_TYPE).alias("errors"),
        F.lit(False).alias("ran"),
    ))


# ---------------------------------------------------------------- phase 3 and final

def _p3(action, decision, reason) -> Column:
    return F.struct(F.lit(action).alias("action"), F.lit(decision).alias("decision"),
                    F.lit(reason).cast("string").alias("reason_code"))


def phase3(p2: Column, glob: Column) -> Column:
    """PII -> tox >= danger -> relevance < safe -> tox <= safe pass -> review."""
    n_pii = F.coalesce(F.size(p2["pii"]["results"]), F.lit(0))
    tox = F.coalesce(p2["toxicity"]["score"], F.lit(0.0))
    rel = p2["relevance"]["score"]
    return (
        F.when(~glob["phase3_enabled"], _p3("pass", "phase3_disabled", None))
        .when(n_pii > 0, _p3("gray", "pii_detected", "PII_DETECTED"))
        .when(tox >= glob["toxicity_danger_threshold"], _p3("gray", "toxicity_high", "TOXICITY_HIGH"))
        .when(rel.isNotNull() & (rel < glob["relevance_safe_threshold"]), _p3("gray", "relevance_low", "RELEVANCE_LOW"))
        .when(tox <= glob["toxicity_safe_threshold"], _p3("pass", "safe", None))
        .otherwise(_p3("gray", "review", "GRAY_ZONE"))
    )


def final_action(p2: Column, p3: Column, req: Column) -> Column:
    """gray+enforce -> block, gray -> observe, timeout -> allow+reason, else allow."""
    timeouts = F.coalesce(p2["timeouts"], F.array().cast("array<string>"))
    return (
        F.when((p3["action"] == "gray") & (req["phase3_mode"] == "enforce"), _p1(
            "block", F.coalesce(p3["reason_code"], F.lit("GRAY_ZONE")),
            F.concat(F.lit(FMT.MSG_ENFORCED), p3["decision"])))
        .when(p3["action"] == "gray", _p1(
            "observe", p3["reason_code"], F.concat(F.lit(FMT.MSG_OBSERVED), p3["decision"])))
        .when(F.size(timeouts) > 0, _p1(
            "allow", "ANALYZER_TIMEOUT_OBSERVE",
            F.concat(F.lit(FMT.MSG_TIMEOUT), F.array_join(timeouts, ", "))))
        .otherwise(_p1("allow", None, FMT.MSG_ALLOW))
    )


# ---------------------------------------------------------------- chains

def output_gate(text: Column, key: Column, req: Column, rules: Rules) -> Column:
    """Output checks before phase 2: length, then terms where enforced."""
    hits = blocklist_hits(key, rules.term_array())
    return (
        F.when(F.length(text) > req["max_non_stream_output_chars"], _p1("block", "OUTPUT_TOO_LONG", FMT.MSG_OUTPUT_TOO_LONG))
        .when((F.size(hits) > 0) & req["output_blocklist_enforce"],
              _p1("block", "BLOCKLIST_MATCH", hits_detail(hits, FMT.MSG_OUTPUT_TERMS)))
    )


def gates(df: DataFrame, direction: Column, *, text: str = "text", key: str = "key", stream: str | None = None,
          tool_count: str | None = None, limited: str | None = None, malformed: Column | None = None,
          req: Settings | Column = DEFAULTS, glob: Settings | Column = DEFAULTS,
          rules: Rules = Rules(RuleSet().effective()), analyzers: Analyzers = Analyzers(),
          drop_text: bool = False) -> DataFrame:
    """The part of F13 that reads the text, for both chains in one projection:
    adds ``_dir``, ``_bad`` (error message), ``phase1``, ``_gate`` (the block of
    phase 1 or of the output checks) and ``_feat`` (see ``text_features``).

    CASE takes a row down its own direction's branch: ``input`` rows through
    phase 1, ``output`` rows through length and terms (no rate limit, no
    patterns).  Any other direction, or a non-null ``malformed`` message, is
    bad.  With ``drop_text`` the text and key columns go, so whatever is joined
    afterwards shuffles narrow rows only.
    """
    req_c, glob_c = lit_settings(req), lit_settings(glob)
    t, k = F.col(text), F.col(key)
    s = F.coalesce(F.col(stream), F.lit(False)) if stream else F.lit(False)
    tc = F.col(tool_count) if tool_count else F.lit(0)
    lim = F.col(limited) if limited else F.lit(False)
    bad = F.when(~F.coalesce(direction.isin("input", "output"), F.lit(False)), F.lit(FMT.MSG_DIRECTION))
    bad = bad if malformed is None else F.coalesce(bad, malformed)
    cols = [F.col(c) for c in df.columns if not (drop_text and c in (text, key))]
    out = df.select("*", direction.alias("_dir"), bad.alias("_bad"))
    ok = F.col("_bad").isNull()
    out = out.select(
        "*", F.when(ok & (F.col("_dir") == "input"), phase1(t, k, s, tc, lim, req_c, rules)).alias("phase1"),
        F.when(ok & (F.col("_dir") == "output"), output_gate(t, k, req_c, rules)).alias("_gate"))
    gate = F.coalesce(F.when(F.col("phase1.action") == "block", F.col("phase1")), F.col("_gate"))
    return out.select(*cols, "_dir", "_bad", "phase1", gate.alias("_gate"),
                      F.when(ok & gate.isNull(), text_features(t, req_c, glob_c, analyzers)).alias("_feat"))


def rate_gate(out: DataFrame, limited: str, req: Settings | Column = DEFAULTS) -> DataFrame:
    """Applies the rate limit to rows that went through ``gates`` without it:
    it comes before every other check of phase 1, so it takes their place."""
    hit = (F.coalesce(F.col(limited), F.lit(False)) & F.col("_bad").isNull() & (F.col("_dir") == "input")
           & lit_settings(req)["phase1_enabled"])
    block = _p1("block", "RATE_LIMITED", FMT.MSG_RATE_LIMITED)
    return out.withColumns({c: F.when(hit, block).otherwise(F.col(c)) for c in ("phase1", "_gate")})


def decide(out: DataFrame, *, req: Settings | Column = DEFAULTS, glob: Settings | Column = DEFAULTS,
           analyzers: Analyzers = Analyzers()) -> DataFrame:
    """The rest of F13, on the narrow rows of ``gates``: phases 2 and 3 and the
    final action; adds phase2, phase3, stage, action, reason_code, detail and
    ``reached``."""
    req_c, glob_c = lit_settings(req), lit_settings(glob)
    goes_on = F.col("_bad").isNull() & F.col("_gate").isNull()
    out = out.select("*", F.when(goes_on, phase2(F.col("_feat"), req_c, glob_c, analyzers)).alias("phase2"))
    out = out.select("*", F.when(goes_on, phase3(F.col("phase2"), glob_c)).alias("phase3"))
    fin = (F.when(F.col("_bad").isNotNull(), F.struct(F.lit("error").alias("action"), F.lit("MALFORMED_INPUT").alias("reason_code"),
                                                      F.col("_bad").alias("detail")))
           .when(F.col("_gate").isNotNull(), F.col("_gate")).otherwise(final_action(F.col("phase2"), F.col("phase3"), req_c)))
    out = out.select("*", fin.alias("_fin"))
    none = F.array().cast("array<string>")
    reached = F.concat(F.when(F.col("phase1").isNotNull(), F.array(F.lit("phase1"))).otherwise(none),
                       F.when(goes_on, F.array(F.lit("phase2"), F.lit("phase3"))).otherwise(none))
    keep = [c for c in out.columns if c not in ("_dir", "_bad", "_gate", "_feat", "_fin", "phase2", "phase3")]
    return out.select(
        *keep, "phase2", "phase3", F.when(F.col("_bad").isNull(), F.col("_dir")).alias("stage"),
        F.col("_fin.action").alias("action"), F.col("_fin.reason_code").alias("reason_code"),
        F.col("_fin.detail").alias("detail"), reached.alias("reached"))


def evaluate(df: DataFrame, direction: Column, *, req: Settings | Column = DEFAULTS, glob: Settings | Column = DEFAULTS,
             analyzers: Analyzers = Analyzers(), enrich=None, **how) -> DataFrame:
    """``gates``, then ``enrich`` (DataFrame -> DataFrame, joins side inputs
    once the text is dropped), then ``decide``; one scan, one projection."""
    out = gates(df, direction, req=req, glob=glob, analyzers=analyzers, **how)
    return decide(enrich(out) if enrich else out, req=req, glob=glob, analyzers=analyzers)


def evaluate_input(df: DataFrame, **how) -> DataFrame:
    """F13 input chain (see ``evaluate``)."""
    return evaluate(df, F.lit("input"), **how)


def evaluate_output(df: DataFrame, **how) -> DataFrame:
    """F13 output chain (see ``evaluate``)."""
    return evaluate(df, F.lit("output"), **how)


def decision_struct(df: DataFrame, request_id: str, applied_policy: Column, applied_version: Column,
                    normalized: Column, metadata: Column | None = None) -> DataFrame:
    """The serialised result shape: the request as it was read
    (``normalized``), metadata merged with the applied policy."""
    meta = metadata if metadata is not None else F.create_map().cast("map<string,string>")
    applied = F.create_map(F.lit("applied_policy_id"), applied_policy.cast("string"),
                           F.lit("applied_policy_version"), applied_version.cast("string"))
    merged = F.map_concat(F.map_filter(meta, lambda k_, v: ~k_.isin("applied_policy_id", "applied_policy_version")),
                          applied)
    return df.withColumn("decision", F.struct(
        F.col(request_id).cast("string").alias("request_id"), F.col("stage"), F.col("action"),
        F.col("reason_code"), F.col("detail"), F.col("phase1"), F.col("phase2"), F.col("phase3"),
        normalized.alias("normalized"), merged.alias("metadata"),
    ))
