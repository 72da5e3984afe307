"""Queries over ``embeddings`` (and ``labels``): golden-set relevance, its
long form, arg-max, rerank top-n and the model-hook UDFs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.semantic import (best_label, golden_cross, golden_rows, make_embed_udf, make_score_udf,
                                  relevance, rerank_topn)
from ..session import table
from .registry import register

# The golden set: the lowest vec_id of each label, in vec_id order.
_GOLDEN_SQL = """golden AS (
  SELECT vec_id AS idx, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS vec
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn = 1
),
scored AS (
  SELECT e.vec_id, g.idx, g.label AS golden_label,
         list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), g.vec) AS score
  FROM embeddings e, golden g
)"""


def _golden(spark, sf):
    emb = table(spark, sf, "embeddings")
    first = emb.groupBy("label").agg(F.min("vec_id").alias("vec_id"),
                                     F.min_by("embedding", "vec_id").alias("embedding"))
    return golden_rows(first, "label", "embedding", "vec_id")


def _emb(spark, sf):
    return table(spark, sf, "embeddings")


@register("golden_relevance", sql=f"""
WITH {_GOLDEN_SQL}
SELECT vec_id, golden_label AS matched_label, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, idx) AS r FROM scored) WHERE r = 1
""")
def golden_relevance(spark, sf):
    """best cosine match against the golden set (strictly better wins)."""
    r = relevance(_emb(spark, sf), "embedding", _golden(spark, sf), ["vec_id"])
    return r.select("vec_id", "matched_label", F.round("score", 6).alias("score"))


@register("golden_cross", sql=f"""
WITH {_GOLDEN_SQL}
SELECT vec_id, golden_label, round(score, 6) AS score FROM scored
""")
def golden_cross_q(spark, sf):
    """Every vector scored against every golden vector (long form)."""
    long = golden_cross(_emb(spark, sf), "embedding", _golden(spark, sf), ["vec_id"])
    return long.select("vec_id", "golden_label", F.round("score", 6).alias("score"))


@register("best_label", sql=f"""
WITH {_GOLDEN_SQL}
SELECT vec_id, arg_max(golden_label, [score, -idx]) AS best_label FROM scored GROUP BY vec_id
""")
def best_label_q(spark, sf):
    """O3: first-best arg-max over the golden set, in the row."""
    return best_label(_emb(spark, sf), "embedding", _golden(spark, sf), ["vec_id"]).select("vec_id", "best_label")


@register("rerank_topn", sql="""
WITH q AS (
  SELECT label, CAST(embedding AS DOUBLE[]) AS qv
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn = 1
),
s AS (
  SELECT e.label, e.vec_id, list_cosine_similarity(q.qv, CAST(e.embedding AS DOUBLE[])) AS score
  FROM embeddings e JOIN q ON q.label = e.label
)
SELECT label, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""")
def rerank_topn_q(spark, sf):
    """Per label, the label's golden vector is the query; its candidates
    are that label's vectors; keep the top 5 with their rank."""
    emb = _emb(spark, sf).select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = _golden(spark, sf).select(F.col("label").cast("int").alias("label"), F.col("vec").alias("qv"))
    out = rerank_topn(q, emb, group="label", qvec="qv", cvec="v", cand_id="vec_id", top_n=5)
    return out.select("label", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("score_udf", sql="""
SELECT doc_id, greatest(CAST(toxic AS DOUBLE), CAST(1 - quality AS DOUBLE)) AS score FROM labels
""")
def score_udf_q(spark, sf):
    """Label scores through the pluggable Arrow scorer (default: stored scores)."""
    udf = make_score_udf(["toxic", "low_quality"])
    lab = table(spark, sf, "labels")
    inp = F.struct(F.col("toxic").cast("double").alias("toxic"), (1 - F.col("quality")).cast("double").alias("low_quality"))
    s = lab.select("doc_id", udf(inp).alias("s"))
    return s.select("doc_id", F.greatest("s.toxic", "s.low_quality").alias("score"))


@register("embed_udf", sql="""
SELECT vec_id, CAST(len(v) AS INTEGER) AS dim, CASE WHEN len(v) = 64 THEN list_sum(v) END AS vector_sum,
       CASE WHEN len(v) = 64 THEN NULL ELSE 'embedding_shape_mismatch' END AS error
FROM (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN CAST(embedding AS DOUBLE[])[1:63] ELSE CAST(embedding AS DOUBLE[]) END AS v FROM embeddings)
""")
def embed_udf_q(spark, sf):
    """Vectors from the pluggable embedder (default: stored), shape-checked;
    every seventh comes one component short."""
    udf = make_embed_udf(64)
    v = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    e = _emb(spark, sf).select("vec_id", v.alias("v")).select("vec_id", F.size("v").alias("dim"), udf(F.col("v")).alias("r"))
    total = F.aggregate("r.vector", F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", "dim", total.alias("vector_sum"), F.col("r.error").alias("error"))
