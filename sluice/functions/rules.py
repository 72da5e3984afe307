"""Rule lists (terms, patterns, golden set) and their fixed shipped values."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Runtime fallbacks used when a term file is empty or the
# pattern key is missing from the rules document.
DEFAULT_TERMS = (
    "ignore previous instructions",
    "system prompt",
    "developer message",
)
DEFAULT_PATTERNS = (
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"reveal\s+(the\s+)?system\s+prompt",
    r"show\s+(the\s+)?developer\s+message",
    r"bypass\s+(all\s+)?safety",
)

# The shipped phrase list and regex list.
SHIPPED_TERMS = (
    "ignore previous instructions",
    "ignore all previous instructions",
    "disregard previous instructions",
    "reveal the system prompt",
    "show the developer message",
    "show hidden instructions",
    "print the hidden prompt",
    "dump internal instructions",
    "bypass all safety",
    "disable safety filters",
    "leak all secrets",
    "dump environment variables",
    "show the api key",
    "show the access token",
)
SHIPPED_PATTERNS = (
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"disregard\s+(all\s+)?(previous|above)\s+instructions",
    r"forget\s+(all\s+)?(prior|previous)\s+instructions",
    r"reveal\s+(the\s+)?system\s+prompt",
    r"show\s+(the\s+)?developer\s+message",
    r"(show|print|dump)\s+(the\s+)?(hidden|internal)\s+(prompt|instructions)",
    r"bypass\s+(all\s+)?safety",
    r"(disable|turn\s+off)\s+(all\s+)?safety(\s+filters?)?",
    r"(act|respond)\s+as\s+(the\s+)?system",
    r"(pretend|roleplay)\s+you\s+are\s+(the\s+)?(system|developer)",
    r"(leak|dump|exfiltrate)\s+(all\s+)?(secrets|credentials|tokens?)",
    r"(output|show)\s+(the\s+)?(api\s*key|access\s*token|environment\s+variables?)",
)

def java_regex(py_pattern: str, flags: str = "iU") -> str:
    """Python ``re`` pattern -> Java pattern with Python's Unicode semantics.

    Python's ``\\s \\d \\b \\w`` are Unicode-aware for str patterns; Java's
    are ASCII unless UNICODE_CHARACTER_CLASS (``(?U)``) is on.  Named groups
    ``(?P<n>`` become ``(?<n>``.
    """
    body = re.sub(r"\(\?P<", "(?<", py_pattern)
    body = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", body)
    return f"(?{flags}){body}" if flags else body


def clean_list(values) -> list[str]:
    """strip, drop blank (the term/pattern list normaliser, literal form)."""
    return [v.strip() for v in values if isinstance(v, str) and v.strip()]


def term_entries(terms) -> list[tuple[str, str]]:
    """(term, casefold key), one per key, later spelling wins, first-seen order."""
    by_key: dict[str, str] = {}
    for t in clean_list(terms):
        by_key[t.casefold()] = t
    return [(t, k) for k, t in by_key.items()]


@dataclass(frozen=True)
class RuleSet:
    """One policy version's effective rules (after runtime fallback)."""

    terms: tuple = ()
    patterns: tuple = ()
    golden: tuple = field(default=())  # ((label, vector tuple), ...)

    def effective(self, runtime: "RuleSet | None" = None) -> "RuleSet":
        rt = runtime or RuleSet(DEFAULT_TERMS, DEFAULT_PATTERNS)
        return RuleSet(
            tuple(clean_list(self.terms)) or tuple(rt.terms),
            tuple(clean_list(self.patterns)) or tuple(rt.patterns),
            self.golden,
        )
