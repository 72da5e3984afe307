"""Operator 1: license scan by ordered signature rules.

A text is lower-cased (A-Z), cut into words and joined by single blanks.  One
Aho-Corasick pass finds which rule keywords occur; only the rules with a
keyword there run their regex.  Detections are intervals of words.  They are
taken by falling priority, then length, then start; one that lies inside a
taken interval is suppressed, so "gnu general public license version 3"
leaves no "gnu general public license" hint.  Base phrases are rules of the
highest priority that nothing suppresses; each of their places counts.

One narrow map over the documents: no shuffle, one Arrow batch in memory at a
time.  Regexes have bounded repetitions only, so a text costs time linear in
its length for each rule that is tried.

Defined cases: null text is empty: no words, no labels, score 0; repeated
rows are scanned each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts
from .license_rules import BASE, KINDS, RULES
from .words import letter_words

#: Base phrases rank above all kinds.
BASE_PRIORITY, BASE_CONFIDENCE = 9, 1.0


@lru_cache(1)
def compiled():
    """(rules, keyword automaton); a rule is (label, priority, confidence, is
    base, regex), the automaton maps a keyword to the rules it gates."""
    rules, gates = [], {}
    for label, phrase in BASE:
        gates.setdefault(phrase, []).append(len(rules))
        rules.append((label, BASE_PRIORITY, BASE_CONFIDENCE, True, re.compile(rf"(?<![^ ])(?={phrase}(?![^ ]))")))
    for line in RULES.strip().splitlines():
        label, kind, keywords, regex = line.split(" | ")
        for keyword in keywords.split("; "):
            gates.setdefault(keyword, []).append(len(rules))
        rules.append((label, *KINDS[kind], False, re.compile(rf"(?<![^ ])(?:{regex})(?![^ ])")))
    auto = ahocorasick.Automaton()
    for keyword, ids in gates.items():
        auto.add_word(keyword, tuple(ids))
    auto.make_automaton()
    return rules, auto


def detect(text: str | None) -> tuple[int, list[tuple[int, int, str, float, bool]]]:
    """Number of words, and the kept detections (first word, end word, label,
    confidence, is base) in order of their place."""
    words = letter_words(text)
    joined = b" ".join(words).decode("utf-8", "surrogatepass")
    rules, auto = compiled()
    tried = sorted({i for _, ids in auto.iter(joined) for i in ids})
    found = []
    for i in tried:
        label, priority, confidence, base, regex = rules[i]
        size = len(BASE[i][1]) if base else 0
        for m in regex.finditer(joined):
            found.append((m.start(), m.end() + size, priority, label, confidence, base))
    if not found:
        return len(words), []
    # characters to words, in one pass over the places in order
    marks, at, n = {}, 0, 0
    for p in sorted({x for f in found for x in f[:2]}):
        n += joined.count(" ", at, p)
        at, marks[p] = p, n
    out = [(marks[f[0]], marks[f[1]] + 1, *f[2:]) for f in found]
    out.sort(key=lambda d: (-d[2], d[0] - d[1], d[0], d[3]))
    kept, cover = [], _Cover()
    for first, end, _, label, confidence, base in out:
        if base or not cover.holds(first, end):
            kept.append((first, end, label, confidence, base))
            cover.add(first, end)
    return len(words), sorted(kept)


class _Cover:
    """Intervals none of which holds another: starts and ends both rise, so
    the last start at or before a place has the furthest end there."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, first: int, end: int) -> bool:
        i = bisect_right(self.starts, first) - 1
        return i >= 0 and self.ends[i] >= end

    def add(self, first: int, end: int) -> None:
        if self.holds(first, end):
            return
        i = j = bisect_left(self.starts, first)
        while j < len(self.starts) and self.ends[j] <= end:
            j += 1
        self.starts[i:j], self.ends[i:j] = [first], [end]


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id, n_words,
    detections`` array<struct<first, end, label, confidence, base>>."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("confidence", pa.float64()), ("base", pa.bool_())]))
    names = ("first", "end", "label", "confidence", "base")

    def batches(parts):
        for part in parts:
            got = [detect(t.as_py()) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([n for n, _ in got], pa.int64()), pa.array([[dict(zip(names, d)) for d in ds] for _, ds in got], kind)],
                ["doc_id", "n_words", "detections"],
            )

    df = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text")
    return map_texts(df, batches, "doc_id bigint, n_words bigint, detections array<struct<first: bigint, end: bigint, label: string, confidence: double, base: boolean>>")
