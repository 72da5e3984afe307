"""Operator 4: mix sources to target weights (DataFrame functions only).

Each document gets a hash-random key.  Fixed equal ranges of that key split
every source, however large, into buckets; sums per (source, bucket) give
each bucket's offset, and a running sum inside the bucket gives each
document's place in its source's shuffled token stream.  The stream is cut at
the source's exact word budget, after as many whole epochs as the budget
holds.  No window spans more than one bucket's documents, or one source's
buckets.

Targets: sources in code-point order (null last) weigh ``weights``,
repeating, and share all words.  A target stops at ``max_epochs`` times its
source's size, and the excess goes to the others by weight.  Sorted by
size/weight, the sources that stop are a prefix, so one window over the
per-source sums finds the water level; all comparisons are in integers.

Defined cases: null or blank text has size 0 and takes 0; a null source is a
source of its own, after all others; repeated rows are mixed row by row (rows
alike in every way share their places in any order, with the same multiset of
results); a null doc_id is keyed by its text; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_key, materialize

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Hex digits of the key that name a bucket: 16**3 buckets per source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes``: one row per source (``_null``, ``_src``, ``source_size``).
    Adds ``target`` (double), ``_epochs`` and ``_rest`` (words of the last,
    broken epoch).  The table has one row per source."""
    lcm = math.lcm(*weights)
    whole = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy("_null", "_src"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("bigint")
    s = sizes.select("_null", "_src", "source_size", weight.alias("_w"))
    s = s.withColumn("_cap", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("source_size").cast("decimal(38,0)") * F.lit(lcm) / F.col("_w"), "_null", "_src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    s = s.select(
        "*",
        F.sum("source_size").over(whole).alias("_all"),
        F.sum("_w").over(whole).alias("_wall"),
        F.coalesce(F.sum("_cap").over(before), zero).alias("_capb"),
        F.coalesce(F.sum("_w").over(before), zero).alias("_wb"),
    )
    wide = lambda c: c.cast("decimal(19,0)")
    full = wide(F.col("_cap")) * wide(F.col("_wall") - F.col("_wb")) < wide(F.col("_all") - F.col("_capb")) * wide(F.col("_w"))
    s = s.withColumn("_full", full)
    s = s.select(
        "*",
        (F.col("_all") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(whole), zero)).alias("_left"),
        F.sum(F.when(~F.col("_full"), F.col("_w"))).over(whole).alias("_wleft"),
    )
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(
        (F.col("_w") * F.col("_left")).cast("double") / F.col("_wleft").cast("double")
    )
    s = s.withColumn("target", target).withColumn("_budget", F.floor("target").cast("bigint"))
    some = F.col("source_size") > 0
    return s.select(
        "_null", "_src", "source_size", "target",
        F.when(some, F.expr("_budget div source_size")).otherwise(zero).alias("_epochs"),
        F.when(some, F.col("_budget") % F.col("source_size")).otherwise(zero).alias("_rest"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): ``doc_id, source,
    size, source_size, target, epochs, taken``, and ``extra`` columns of the
    input rows."""
    extra = extra or {}
    rows = docs.select(
        "doc_id", "source",
        F.col("source").isNull().alias("_null"),
        F.coalesce("source", F.lit("")).alias("_src"),
        word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))).alias("_key"),
        *(v.alias(k) for k, v in extra.items()),
    )
    rows = materialize(rows.withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS)), "mix-rows")
    per = rows.groupBy("_null", "_src", "_bucket").agg(F.sum("size").alias("_sum"))
    sizes = per.groupBy("_null", "_src").agg(F.sum("_sum").alias("source_size"))
    upto = Window.partitionBy("_null", "_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = per.join(source_targets(sizes, weights, max_epochs), ["_null", "_src"]).select(
        "_null", "_src", "_bucket", "source_size", "target", "_epochs", "_rest",
        F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy("_null", "_src", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(places, ["_null", "_src", "_bucket"]).withColumn(
        "_start", F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    )
    rest = F.least(F.col("size"), F.greatest(F.lit(0).cast("bigint"), F.col("_rest") - F.col("_start")))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", F.col("_epochs").alias("epochs"),
        (F.col("_epochs") * F.col("size") + rest).alias("taken"), *extra,
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with their own columns and
    ``mix_size``, ``mix_target`` and ``mix_taken`` (which replace columns of
    those names).  Rows alike in doc_id, source and text all get the largest
    share among them."""
    keys = {"_i": id_key(F.col("doc_id")), "_s": F.coalesce("source", F.lit("")), "_t": F.xxhash64("text")}
    took = mix(docs, weights, max_epochs, keys).where(F.col("taken") > 0)
    took = took.groupBy(*keys).agg(F.max("size").alias("_size"), F.max("target").alias("_target"), F.max("taken").alias("_taken"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *(v.alias(k) for k, v in keys.items()))
    rows = rows.join(took, list(keys)).select("_row.*", F.col("_size").alias("_mix1"), F.col("_target").alias("_mix2"), F.col("_taken").alias("_mix3"))
    new = ["mix_size", "mix_target", "mix_taken"]
    return rows.drop(*new).withColumnsRenamed(dict(zip(["_mix1", "_mix2", "_mix3"], new)))
