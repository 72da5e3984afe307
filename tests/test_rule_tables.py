"""Term tables, golden sets and pattern lists of any size."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sluice.functions import patterns
from sluice.operators.detect import first_pattern_column, term_hits, with_term_hits

BIG = 1 << 30


def _docs(spark, n=300):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdé ßо") for _ in range(rng.randrange(1, 7)))
    rows = [(i % 250 if i % 9 else None, " ".join(word() for _ in range(rng.randrange(0, 30)))) for i in range(n)] + [(7, None), (8, ""), (8, "")]
    terms = {word() for _ in range(400)} | {"a", "é", "ab", "abc", "abcd", "never", "not there at all"}
    table = [(t.upper(), t) for t in sorted(terms) if t.strip()] + [("  ", "  "), ("A", "a")]
    return rows, table


@pytest.mark.parametrize("known,held", [(BIG, BIG), (3, BIG), (BIG, 0), (3, 0)])
def test_term_hits_equal_plain_containment(spark, known, held):
    rows, table = _docs(spark)
    docs, terms = spark.createDataFrame(rows, "id int, key string"), spark.createDataFrame(table, "term string, key string")
    got = sorted(((r.id or -1, r.hits) for r in with_term_hits(docs, ["id"], "key", terms, known, held).collect()), key=repr)
    plain = [(i or -1, sorted({t for t, k in table if k.strip() and k in (x or "")})) for i, x in rows]
    assert got == sorted(plain, key=repr)
    long = term_hits(docs, ["id"], "key", terms, known, held)
    assert long.columns == ["id", "term"] and long.count() == sum(len(h) for _, h in plain)


def test_no_terms_and_no_texts(spark):
    docs, terms = spark.createDataFrame([(1, "a")], "id int, key string"), spark.createDataFrame([("A", "a")], "term string, key string")
    assert [r.hits for r in with_term_hits(docs, ["id"], "key", terms.limit(0)).collect()] == [[]]
    assert with_term_hits(docs.limit(0), ["id"], "key", terms).count() == 0


def test_a_hundred_thousand_terms(spark):
    """Terms that don't occur cost (almost) nothing on the texts."""
    text = " ".join(f"word{i % 977}" for i in range(2000))
    docs = spark.createDataFrame([(i, f"{text} term{i * 37:06d}x") for i in range(200)], "id int, key string").repartition(4)

    def run(n):
        terms = spark.range(n).select(F.format_string("term%06dx", "id").alias("term")).withColumn("key", F.col("term"))
        began = time.time()
        got = sorted((r.id, r.term) for r in term_hits(docs, ["id"], "key", terms).collect())
        return got, time.time() - began

    few, _ = run(100)
    some, quick = run(1000)
    many, slow = run(100_000)
    assert few == [(i, f"term{i * 37:06d}x") for i in range(200) if i * 37 < 100]
    assert many == [(i, f"term{i * 37:06d}x") for i in range(200)]
    assert slow < quick + 20


def test_patterns_compile_once_per_list():
    lists = [("a+b", r"x\s+y"), ("(?P<n>q)(?P=n)",), ("never seen", "straße")]
    patterns.program.cache_clear()
    before = patterns.compiled
    for i in range(3000):
        p = patterns.program(lists[i % 3])
        assert p.first(f"{i} nothing here") is None
    assert patterns.compiled - before == 5
    assert patterns.program(lists[0]).first("X \n Y then AAB") == "a+b"
    assert patterns.program(lists[1]).first("QQ") == lists[1][0] and patterns.program(lists[2]).first("STRASSE Straße") == "straße"


def test_required_literals():
    assert patterns.required_literal(r"ignore\s+(all\s+)?previous") == "previous"
    assert patterns.required_literal("a|b") is None and patterns.required_literal("(ab)?") is None
    # a letter whose other case is not ASCII: tried without the literal
    assert patterns.Program(("ski",)).first("ſKI") == "ski"


def test_first_pattern_column(spark):
    rows = [(1, "Hello World", ["zzz", r"w\w+d", "hello"]), (2, "Hello", []), (3, None, ["a"]), (4, "Hello", None), (5, "ÜBER", ["über"])]
    df = spark.createDataFrame(rows, "id int, t string, p array<string>")
    got = {r.id: r.f for r in df.select("id", first_pattern_column(F.col("t"), F.col("p")).alias("f")).collect()}
    assert got == {1: r"w\w+d", 2: None, 3: None, 4: None, 5: "über"}


def _vectors(spark):
    rng = random.Random(3)
    vec = lambda n=6: [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(n)]
    golden = [(i, f"g{i}", vec()) for i in range(1, 400)]
    golden += [(i + 1000, f"again{i}", list(v)) for i, _, v in golden[:50]] + [(2000, "none", None), (2001, None, [1.0, 1.0]), (2002, "zero", [0.0] * 6)]
    rows = [(i % 90, vec()) for i in range(200)] + [(500, None), (501, [0.0] * 6), (502, [1.0, None, 2.0]), (503, vec(9)), (504, []), (505, [float("nan")] * 6)]
    return rows, golden


def _fold(v, golden):
    """The running arg-max in list order."""
    best, label = -1.0, None
    for _, name, g in golden:
        if g is None or v is None:
            continue
        a, b = [x or 0.0 for x in v], [x or 0.0 for x in g]
        dot, na, nb = sum(x * y for x, y in zip(a, b)), sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
        s = 0.0 if na == 0 or nb == 0 else dot / (na * nb)
        if s > best or (s != s and best == best):
            best, label = s, name
    return best, label


@pytest.mark.parametrize("held", [BIG, 3000])
def test_golden_blocks_equal_the_fold(spark, held, monkeypatch):
    from sluice.operators import golden as G

    monkeypatch.setattr(G, "CHUNK", 60)
    rows, golden = _vectors(spark)
    df, g = spark.createDataFrame(rows, "id int, v array<double>"), spark.createDataFrame(golden, "idx int, label string, vec array<double>")
    got = sorted(repr((r.id, round(r.score, 9), r.matched_label)) for r in G.best(df, "v", g, ["id"], held).collect())
    want = [(i, *_fold(v, golden)) for i, v in rows]
    assert got == sorted(repr((i, round(s, 9), label)) for i, s, label in want)
    long = G.cross(df, "v", g, ["id"], held)
    assert long.columns == ["id", "idx", "golden_label", "score"] and long.count() == len(rows) * (len(golden) - 1)
    assert long.where("id = 500 and score is not null").count() == 0
    assert G.best(df, "v", g.limit(0), ["id"], held).where("score <> -1.0 or matched_label is not null").count() == 0
    assert G.best(df.limit(0), "v", g, ["id"], held).count() == 0


def test_a_hundred_thousand_golden_items(spark):
    from sluice.operators.semantic import relevance

    items = spark.range(100_000).select(F.col("id").alias("idx"), F.concat(F.lit("g"), F.col("id")).alias("label"),
                                        F.array(*(F.cos(F.col("id") * (k + 1)) for k in range(16))).alias("vec"))
    rows = items.where("idx % 5000 = 7").select(F.col("idx").alias("id"), F.col("vec").alias("v"))
    got = {r.id: (r.matched_label, round(r.score, 9)) for r in relevance(rows, "v", items, ["id"]).collect()}
    assert got == {i: (f"g{i}", 1.0) for i in range(7, 100_000, 5000)}
