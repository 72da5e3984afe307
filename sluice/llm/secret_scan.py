"""Operator 2: secret scan with a randomness test battery (DataFrame functions only).

Base kinds are three patterns, matched leftmost without overlaps.  Match
positions come from splitting the text at the pattern: the lengths of gaps
and matches, summed up.

Method kind ``random``: tokens of 20 or more base64/url characters.  The
smallest alphabet that holds a token is its inferred encoding (single-case
letters alone are a word and not tested).  Three tests ask whether a token
could be uniform draws from that alphabet: chi-squared of the symbol counts,
the runs test on upper and lower halves of the alphabet, and lag-1 serial
correlation of the symbol ranks.  A token's p is three times the smallest of
the three (Bonferroni).  Short tokens have little power, so tokens are
controlled within classes of length: Benjamini-Hochberg over the whole
corpus' p-values of a class, read off a histogram of -10 log10 p (at most
CLASSES x BINS rows).  Tokens that the procedure rejects as non-random are
dropped; the others are reported.

Defined cases: null text is empty: no spans, the hash of the empty string;
repeated rows are scanned each by itself; an empty table gives an empty
result.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
MIN_ASSIGN = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: False-discovery rate of each class of length, classes and histogram bins.
FDR, CLASSES, BINS = 0.05, 16, 400
#: Encodings in the order they are tried: a pattern and the alphabet in order.
_D, _L, _U = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("^[0-9]+$", _D),
    ("^[0-9a-f]+$", _D + _L[:6]),
    ("^[0-9A-F]+$", _D + _U[:6]),
    ("^[A-Z2-7]+$", _U + "234567"),
    ("^[0-9a-z]+$", _D + _L),
    ("^[0-9A-Z]+$", _D + _U),
    ("^[0-9A-Za-z]+$", _U + _L + _D),
    ("^[0-9A-Za-z+/]+$", _U + _L + _D + "+/"),
    ("^[0-9A-Za-z_-]+$", _U + _L + _D + "-_"),
    ("^[0-9A-Za-z+/_-]+$", _U + _L + _D + "+/-_"),
)


def prefix_sums(x: Column) -> Column:
    """Inclusive running sums of an array of numbers, by blocks of the square
    root of its size: n^1.5 steps, so that 100,000 matches in one text cost
    some seconds and not hours."""
    n = F.size(x)
    b = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, v: s + v)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / b).cast("int")), lambda i: F.slice(x, i * b + 1, b))
    sums = F.transform(blocks, total)
    run = lambda blk, i: F.transform(blk, lambda _, j: total(F.slice(blk, F.lit(1), j + 1)) + total(F.slice(sums, F.lit(1), i)))
    return F.when(n > 0, F.flatten(F.transform(blocks, run))).otherwise(F.array().cast("array<bigint>"))


def with_spans(df: DataFrame, name: str, text: str, pattern: str) -> DataFrame:
    """Adds ``{name}_m`` (matches) and ``{name}_s`` (their starts)."""
    df = df.withColumn(f"{name}_m", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    m = F.col(f"{name}_m")
    df = df.withColumn(f"{name}_g", F.when(F.size(m) > 0, F.transform(F.split(F.col(text), pattern, -1), F.char_length)))
    steps = F.transform(
        m, lambda x, i: (F.get(F.col(f"{name}_g"), i) + F.when(i == 0, F.lit(0)).otherwise(F.char_length(F.get(m, i - 1)))).cast("bigint"))
    df = df.withColumn(f"{name}_x", F.when(F.size(m) > 0, steps).otherwise(F.array().cast("array<bigint>")))
    return df.withColumn(f"{name}_s", prefix_sums(F.col(f"{name}_x"))).drop(f"{name}_g", f"{name}_x")


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, to about 1 %."""
    a = F.abs(z)
    q = 2 / (a + F.sqrt(a * a + 2.5464790894703255)) * F.exp(-a * a / 2) * 0.3989422804014327
    return F.when(z >= 0, q).otherwise(1 - q)


def _encoding(s: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, letters in reversed(ENCODINGS):
        out = F.when(s.rlike(pattern), F.lit(letters)).otherwise(out)
    return F.when(s.rlike("^([a-z]+|[A-Z]+)$"), F.lit(None).cast("string")).otherwise(out)


def randomness(tokens: Column) -> Column:
    """array<struct<start, end, word>> -> array<struct<start, end, class, bin>>
    of the tokens with an encoding; ``bin`` is -10 log10 p, cut at BINS."""
    st = F.struct
    x = F.transform(tokens, lambda t: st(t.start.alias("start"), t.end.alias("end"), t.word.alias("s"), _encoding(t.word).alias("abc")))
    x = F.filter(x, lambda t: t.abc.isNotNull())
    # ranks of the symbols from 1; the alphabet's halves as 0 and 1
    halves = lambda abc: F.concat(F.repeat(F.lit("0"), (F.length(abc) / 2).cast("int")), F.repeat(F.lit("1"), F.length(abc) - (F.length(abc) / 2).cast("int")))
    x = F.transform(x, lambda t: st(
        t.start.alias("start"), t.end.alias("end"), F.length(t.s).cast("double").alias("n"), F.length(t.abc).cast("double").alias("a"),
        F.aggregate(F.split(t.abc, ""), F.lit(0.0), lambda acc, ch: acc + F.when(ch == "", F.lit(0.0)).otherwise(
            F.pow(F.length(t.s) - F.length(F.replace(t.s, ch, F.lit(""))), F.lit(2.0)))).alias("sq"),
        F.call_function("translate", t.s, t.abc, halves(t.abc)).alias("b"),
        F.transform(F.filter(F.split(t.s, ""), lambda c: c != ""), lambda c: F.instr(t.abc, c).cast("double")).alias("r"),
    ))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    x = F.transform(x, lambda t: st(
        t.start.alias("start"), t.end.alias("end"), t.n.alias("n"), t.a.alias("a"),
        (t.a / t.n * t.sq - t.n).alias("chi"),
        F.length(F.replace(t.b, F.lit("0"), F.lit(""))).cast("double").alias("ones"),
        (1 + (t.n - F.length(F.replace(t.b, F.lit("01"), F.lit("")))) / 2 + (t.n - F.length(F.replace(t.b, F.lit("10"), F.lit("")))) / 2).alias("runs"),
        (total(t.r) / t.n).alias("mean"), t.r.alias("r"),
    ))
    x = F.transform(x, lambda t: st(
        t.start.alias("start"), t.end.alias("end"), t.n.alias("n"),
        # Wilson-Hilferty
        ((F.pow(F.greatest(t.chi, F.lit(0.0)) / (t.a - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (t.a - 1)))) / F.sqrt(2 / (9 * (t.a - 1)))).alias("z1"),
        (2 * t.ones * (t.n - t.ones) / t.n + 1).alias("mu"), t.runs.alias("runs"),
        total(F.transform(t.r, lambda v: (v - t.mean) * (v - t.mean))).alias("var"),
        total(F.zip_with(F.slice(t.r, F.lit(1), F.greatest(t.n - 1, F.lit(0.0)).cast("int")), F.slice(t.r, F.lit(2), F.greatest(t.n - 1, F.lit(0.0)).cast("int")),
                         lambda u, v: (u - t.mean) * (v - t.mean))).alias("cov"),
    ))
    spread = lambda t: F.sqrt(F.greatest((t.mu - 1) * (t.mu - 2) / (t.n - 1), F.lit(1e-9)))
    x = F.transform(x, lambda t: st(
        t.start.alias("start"), t.end.alias("end"), t.n.alias("n"),
        F.least(
            F.lit(1.0), 3 * _tail(t.z1),
            # all symbols in one half: no runs test statistic, but no chance either
            F.when(t.mu <= 1, F.lit(1e-9)).otherwise(6 * _tail(F.abs((t.runs - t.mu) / spread(t)))),
            F.when(t["var"] <= 0, F.lit(1e-9)).otherwise(6 * _tail(F.abs((t.cov / t["var"] + 1 / t.n) * F.sqrt(t.n)))),
        ).alias("p"),
    ))
    return F.transform(x, lambda t: st(
        t.start.alias("start"), t.end.alias("end"),
        F.least(F.floor(t.n / 8), F.lit(CLASSES - 1)).cast("int").alias("class"),
        F.least(F.floor(-10 * F.log10(F.greatest(t.p, F.lit(1e-300)))), F.lit(BINS - 1)).cast("int").alias("bin"),
    ))


def rejection_bins(scored: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """class -> smallest bin that Benjamini-Hochberg rejects there.  The
    driver gets the histogram, CLASSES x BINS rows at most."""
    hist = scored.select(F.explode("random").alias("t")).groupBy("t.class", "t.bin").agg(F.count(F.lit(1)).alias("n")).collect()
    cuts = {}
    for c in {r["class"] for r in hist}:
        bins = {r["bin"]: r["n"] for r in hist if r["class"] == c}
        total, seen = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            seen += bins[b]
            if 10 ** (-b / 10) <= fdr * seen / total:
                cuts[c] = b
    return cuts


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id`` and ``spans``,
    array<struct<start, rank, end>> by start and kind (rank into KINDS)."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for name, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN)):
        df = with_spans(df, name, "text", pattern)
    values = F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))
    df = df.withColumn("assign_v", F.when(F.size("assign_m") > 0, values))
    span = lambda name, rank: F.zip_with(f"{name}_s", f"{name}_m", lambda s, m: F.struct(
        s.cast("bigint").alias("start"), F.lit(rank).alias("rank"), (s + F.char_length(m)).cast("bigint").alias("end")))
    kept = F.filter(span("assign", 0), lambda _, i: F.char_length(F.get("assign_v", i)) >= MIN_ASSIGN)
    tokens = F.zip_with("random_s", "random_m", lambda s, m: F.struct(s.alias("start"), (s + F.char_length(m)).alias("end"), m.alias("word")))
    df = df.select("doc_id", F.concat(kept, span("access", 1), span("hex", 2)).alias("base"), tokens.alias("tokens"))
    df = materialize(df.select("doc_id", "base", randomness(F.col("tokens")).alias("random")), "secret-spans")
    cuts = rejection_bins(df, fdr)
    limits = F.array(*(F.lit(cuts.get(c, BINS)) for c in range(CLASSES)))
    random = F.transform(F.filter("random", lambda t: t.bin < F.get(limits, t["class"])),
                         lambda t: F.struct(t.start.cast("bigint").alias("start"), F.lit(3).alias("rank"), t.end.cast("bigint").alias("end")))
    return df.select("doc_id", F.array_sort(F.concat("base", random)).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s.start.cast("string"), s.end.cast("string"))), ",")
