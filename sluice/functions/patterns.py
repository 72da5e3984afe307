"""F4 with a pattern list per row: programs compiled once per list.

Rows carry the patterns of their policy version.  A Python worker keeps one
program per distinct list, its patterns compiled once whatever the number of
rows, with Python's own meaning of each (case ignored, search anywhere).  A
pattern is tried only where the literal that all its matches hold occurs.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _parser

from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Programs that a worker keeps, and the patterns it has compiled so far.
PROGRAMS = 4096
compiled = 0


def required_literal(pattern: str) -> str | None:
    """The longest run of characters, in lower case, that every match holds;
    None where there is none, or case folding could miss it (not ASCII)."""
    best, run = "", ""
    for op, arg in _parser.parse(pattern):
        if str(op) == "LITERAL" and arg < 128:
            run += chr(arg).lower()
            best = max(best, run, key=len)
        else:
            run = ""
    return best or None


class Program:
    """The compiled patterns of one list, in order."""

    def __init__(self, patterns: tuple[str, ...]):
        global compiled
        compiled += len(patterns)
        self.steps = [(p, re.compile(p, re.IGNORECASE), required_literal(p)) for p in patterns]

    def first(self, text: str) -> str | None:
        """The first pattern of the list that occurs in ``text``."""
        lower = text.lower() if text.isascii() else None
        for p, regex, literal in self.steps:
            if (lower is None or literal is None or literal in lower) and regex.search(text):
                return p
        return None


@lru_cache(PROGRAMS)
def program(patterns: tuple[str, ...]) -> Program:
    return Program(patterns)


@F.udf(returnType=T.StringType(), useArrow=False)  # see ``text``
def first_pattern_of(text: str | None, patterns: list[str | None] | None) -> str | None:
    if text is None or patterns is None:
        return None
    return program(tuple(x for x in patterns if x is not None)).first(text)
