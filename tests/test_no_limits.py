"""Rule sets, messages and texts of any size take the same path, in time
linear in their size."""

import time

from pyspark.sql import functions as F

from sluice.functions.chat import assistant_text, conversation_messages
from sluice.functions.pii import DEFAULT_RECOGNIZERS, pii_spans
from sluice.functions.text import canon, is_blank, strip
from sluice.operators.detect import blocklist_hits, term_hits, terms_literal
from sluice.operators.semantic import best_label, golden_cross, golden_rows, relevance


def test_five_thousand_golden_items(spark):
    items = spark.range(5000).select("id", F.concat(F.lit("g"), F.col("id")).alias("label"),
                                     F.array(F.cos("id"), F.sin("id"), F.lit(0.0)).alias("v"))
    golden = golden_rows(items, "label", "v", "id")
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0])], "id int, v array<double>")
    got = {r.id: (r.matched_label, r.score) for r in relevance(rows, "v", golden, ["id"]).collect()}
    assert got == {1: ("g0", 1.0), 2: ("g0", 0.0)}
    assert {r.id: r.best_label for r in best_label(rows, "v", golden, ["id"]).collect()} == {1: "g0", 2: "g0"}
    assert golden_cross(rows, "v", golden, ["id"]).count() == 10000


def test_five_thousand_terms(spark):
    terms = [f"term{i:04d}x" for i in range(5000)]
    docs = spark.createDataFrame([(1, "a term0007x and term4999x here"), (2, "none")], "id int, key string")
    table = spark.createDataFrame([(t, t) for t in terms], "term string, key string")
    assert sorted(r.term for r in term_hits(docs, ["id"], "key", table).collect()) == ["term0007x", "term4999x"]
    hits = docs.select("id", blocklist_hits(F.col("key"), terms_literal(terms)).alias("h")).collect()
    assert {r.id: r.h for r in hits} == {1: ["term0007x", "term4999x"], 2: []}


def test_seventy_choices(spark):
    conv = spark.createDataFrame([(1, i, "assistant", f"part {i}") for i in range(70)], "c int, t int, r string, x string")
    m = conversation_messages(conv, conv_id="c", turn="t", role="r", text="x")
    text = assistant_text(F.struct(F.transform("messages", lambda x: F.struct(x.alias("message"))).alias("choices")))
    assert m.select(text.alias("x")).first().x == "\n".join(f"part {i}" for i in range(70))


def test_a_million_inner_blanks(spark):
    df = spark.createDataFrame([("x" + " " * 1_000_000 + "y ",), (" " * 1_000_000,)], "t string")
    began = time.time()
    got = df.select(F.length(strip(F.col("t"))).alias("n"), is_blank(F.col("t")).alias("b"), F.length(canon(F.col("t"))["text"]).alias("c")).collect()
    assert [(r.n, r.b, r.c) for r in got] == [(1_000_002, False, 1_000_002), (0, True, 0)]
    assert time.time() - began < 20


def test_a_hundred_thousand_hits(spark):
    df = spark.createDataFrame([("a@b.co " * 100_000,)], "t string")
    began = time.time()
    spans = df.select(pii_spans(F.col("t"), DEFAULT_RECOGNIZERS).alias("s")).select(F.size("s").alias("n"), F.get("s", F.lit(99_999)).alias("z")).first()
    assert (spans.n, spans.z.start, spans.z.end) == (100_000, 699_993, 699_999)
    assert time.time() - began < 60
