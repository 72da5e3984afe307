"""Policy settings: the declared defaults and their typed Spark form.

A request is judged under two settings scopes at once (see README):

* ``req``  - base settings + active-policy overrides + the request's own
  policy-version overrides: lengths, terms, patterns, phase-2 switch,
  phase-3 mode, golden set, relevance switch.
* ``glob`` - base settings + active-policy overrides only: rate limit,
  phase-3 switch, the three score thresholds, PII/toxicity switches.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults and field names that must equal the reference's.
MUTABLE_FIELDS = (
    "analyzer_timeout_seconds",
    "phase1_enabled",
    "phase2_enabled",
    "phase3_enabled",
    "phase4_enabled",
    "phase2_mode",
    "phase3_mode",
    "fail_open_on_analyzer_timeout",
    "output_semantic_non_stream_only",
    "relevance_enabled",
    "toxicity_enabled",
    "pii_enabled",
    "max_input_chars",
    "max_stream_input_chars",
    "max_tool_count",
    "max_message_count",
    "max_non_stream_output_chars",
    "rate_limit_window_seconds",
    "rate_limit_max_requests",
    "output_blocklist_enforce",
    "toxicity_safe_threshold",
    "toxicity_danger_threshold",
    "relevance_safe_threshold",
)


@dataclass(frozen=True)
class Settings:
    # Default settings.
    analyzer_timeout_seconds: float = 1.5
    phase1_enabled: bool = True
    phase2_enabled: bool = True
    phase3_enabled: bool = True
    phase4_enabled: bool = False
    phase2_mode: str = "observe"
    phase3_mode: str = "observe"
    fail_open_on_analyzer_timeout: bool = True
    output_semantic_non_stream_only: bool = True
    relevance_enabled: bool = False
    toxicity_enabled: bool = True
    pii_enabled: bool = True
    max_input_chars: int = 12000
    max_stream_input_chars: int = 6000
    max_tool_count: int = 8
    max_message_count: int = 64
    max_non_stream_output_chars: int = 12000
    rate_limit_window_seconds: int = 60
    rate_limit_max_requests: int = 30
    output_blocklist_enforce: bool = True
    toxicity_safe_threshold: float = 0.3
    toxicity_danger_threshold: float = 0.7
    relevance_safe_threshold: float = 0.5
    metrics_enabled: bool = True

    def with_(self, **kw) -> "Settings":
        return replace(self, **kw)

    def as_dict(self) -> dict:
        return asdict(self)


DEFAULTS = Settings()


def field_kind(name: str) -> str:
    """'bool' | 'int' | 'float' | 'str' for a settings field."""
    for f in fields(Settings):
        if f.name == name:
            return {bool: "bool", int: "int", float: "float", str: "str"}[type(getattr(DEFAULTS, name))]
    raise KeyError(name)


def _spark_type(kind: str) -> str:
    return {"bool": "boolean", "int": "int", "float": "double", "str": "string"}[kind]


def settings_struct(s: Settings) -> Column:
    """The settings as one literal STRUCT column (constant-folded by Catalyst)."""
    return F.struct(*[
        F.lit(getattr(s, f.name)).cast(_spark_type(field_kind(f.name))).alias(f.name)
        for f in fields(Settings)
    ])


def settings_struct_from_map(base: Settings, overrides: Column) -> Column:
    """Typed settings struct from ``base`` plus a MAP<STRING,STRING> of overrides.

    Only mutable fields take an override; values were validated by
    ``coerce_settings`` before they reached the table.
    """
    cols = []
    for f in fields(Settings):
        kind = field_kind(f.name)
        default = F.lit(getattr(base, f.name)).cast(_spark_type(kind))
        if f.name in MUTABLE_FIELDS:
            typed = overrides.getItem(f.name).try_cast(_spark_type(kind))
            cols.append(F.coalesce(typed, default).alias(f.name))
        else:
            cols.append(default.alias(f.name))
    return F.struct(*cols)
