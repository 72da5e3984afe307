"""Long transcripts in two levels."""

import random

from pyspark.sql import functions as F

from sluice.functions import chat


def test_edges(spark):
    rows = [(None, 1, "a"), (None, 2, "b"), (1, 3, " z "), (1, 1, "\t x"), (1, 2, None), (2, 1, None), (3, None, "first"), (3, 0, "then"),
            (4, 1, "b"), (4, 1, "a"), (4, 1, "a"), (2**62 + 1, 1, "big"), (5, 1, "")]
    df = spark.createDataFrame(rows, "k long, o int, t string").withColumn("s", F.lit(1)).withColumn("part", F.lit("x"))
    got = {r.k: r.text for r in chat.segment_concat(df, key="k", order="o", text="t").collect()}
    assert got == {None: "ab", 1: "x z", 2: "", 3: "firstthen", 4: "aab", 2**62 + 1: "big", 5: ""}
    assert chat.segment_concat(df.where("false"), key="k", order="o", text="t").count() == 0


def test_one_transcript_of_a_million_segments(spark):
    """It is dealt over tasks by its order, and joined from pieces."""
    n = 1_000_000
    df = spark.range(n).select(F.when(F.col("id") % 1000 == 0, F.col("id") + 1).otherwise(0).alias("k"),
                               ((F.col("id") * 7919) % n).alias("o"), F.concat(((F.col("id") * 7919) % n).cast("string"), F.lit(";")).alias("t"))
    out = chat.segment_concat(df, key="k", order="o", text="t")
    got = out.where("k = 0").first().text
    want = "".join(f"{o};" for o in sorted((i * 7919) % n for i in range(n) if i % 1000))
    assert got == want
    assert out.count() == 1001
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan.lower()
    spread = df.where("k = 0").repartitionByRange(8, "k", "o", "t").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < n // 4


def test_pieces_cut_at_any_size(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(rnd.randrange(4), i, "x" * rnd.randrange(9)) for i in range(500)]
    monkeypatch.setattr(chat, "PIECE", 10)
    got = {r.k: r.text for r in chat.segment_concat(spark.createDataFrame(rows, "k int, o int, t string"), key="k", order="o", text="t").collect()}
    assert got == {k: "".join(t for kk, _, t in rows if kk == k) for k in range(4)}
