"""PII span finding (F7 pii_spans, U1 regex_recognizer) in pure Catalyst.

Offsets are code points, like Python string offsets (see ``spans``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import java_regex
from .spans import match_spans


@dataclass(frozen=True)
class Recognizer:
    entity_type: str
    regex: str  # Python dialect
    score: float
    # A literal every hit contains; rows without it skip the regex scans.
    hint: str | None = None


# The three shipped recognisers, in evaluation order.
DEFAULT_RECOGNIZERS = (
    Recognizer("KR_PHONE_NUMBER", r"(?:\+82[- ]?)?0?1[0-9][- ]?\d{3,4}[- ]?\d{4}", 0.7),
    Recognizer("KR_RRN", r"\b\d{6}-?[1-4]\d{6}\b", 0.85),
    Recognizer("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.75, hint="@"),
)

# The recogniser library compiles with DOTALL | MULTILINE | IGNORECASE.
RECOGNIZER_FLAGS = "smiU"

SPAN_TYPE = "array<struct<entity_type:string,start:int,end:int,score:double>>"


def recognizer_spans(text: Column, rec: Recognizer) -> Column:
    spans = F.transform(match_spans(text, java_regex(rec.regex, RECOGNIZER_FLAGS)), lambda s: F.struct(
        F.lit(rec.entity_type).alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"),
        F.lit(float(rec.score)).alias("score")))
    if not rec.hint:
        return spans
    return F.when(F.instr(text, rec.hint) > 0, spans).otherwise(F.array().cast(SPAN_TYPE))


def pii_spans(text: Column, recognizers=DEFAULT_RECOGNIZERS) -> Column:
    """All hits of every recogniser, recogniser order then text order."""
    parts = [recognizer_spans(text, r) for r in recognizers]
    if not parts:
        return F.array().cast(SPAN_TYPE)
    return F.when(text.isNull(), F.array().cast(SPAN_TYPE)).otherwise(F.concat(*parts))
