"""Semantic analyzers: F9 golden_relevance, J6 golden_cross, O3 best_label,
O4 rerank_topn, U2 score_udf, U3 embed_udf.

The golden set is a table of any size, scored in blocks (see ``golden``).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.vectors import cosine
from .decide import TIMEOUT
from .golden import best, cross


def golden_rows(df: DataFrame, label: str, vec: str, order: str) -> DataFrame:
    """(idx, label, vec); ``idx`` (the list order) is the ``order`` column."""
    return df.select(F.col(order).alias("idx"), F.col(label).cast("string").alias("label"),
                     F.col(vec).cast("array<double>").alias("vec"))


def golden_cross(df: DataFrame, vec: str, golden: DataFrame, id_cols: list[str]) -> DataFrame:
    """One row per (row, golden item) with the cosine score, the long form
    that the query asks for."""
    return cross(df, vec, golden, id_cols)


def relevance(df: DataFrame, vec: str, golden: DataFrame, id_cols: list[str]) -> DataFrame:
    """(score, label) of the best golden match for every row."""
    return best(df, vec, golden, id_cols)


def best_label(df: DataFrame, vec: str, golden: DataFrame, id_cols: list[str]) -> DataFrame:
    """O3: first-best arg-max: highest score, then lowest index; a best of
    exactly -1.0 (never beaten) gives a null label."""
    return best(df, vec, golden, id_cols).withColumnRenamed("matched_label", "best_label")


def rerank_topn(queries: DataFrame, candidates: DataFrame, *, group: str, qvec: str, cvec: str,
                cand_id: str, top_n: int) -> DataFrame:
    """Per query, candidates ordered by score desc then original index,
    top ``top_n`` kept with their rank.  Candidates meet only their own
    query (equi-join on the group key); ``row_number() <= n`` lets Spark cut
    each group to n rows before the shuffle (window group limit)."""
    j = candidates.join(queries.select(group, F.col(qvec).alias("_q")), group)
    scored = j.select(group, cand_id, cosine(F.col("_q"), F.col(cvec)).alias("score"))
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), F.col(cand_id))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


# ------------------------------------------------------------------ model hooks

ScoreFn = Callable[[pd.Series], pd.DataFrame]


def column_scorer() -> ScoreFn:
    """Default scorer: inputs are already label->score structs (stored scores)."""
    def score(s: pd.DataFrame) -> pd.DataFrame:
        return s
    return score


def make_score_udf(labels: list[str], loader: Callable[[], ScoreFn] = column_scorer):
    """Pandas UDF over Arrow batches; the model is loaded once per Python
    worker (on the first batch), like a lazily initialised analyzer."""
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in labels])

    @pandas_udf(schema)
    def score_udf(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in it:
            if model is None:
                model = loader()
            yield model(batch)[labels].astype("float64")

    return score_udf


def make_outcome_udf(labels: list[str], loader: Callable[[], ScoreFn] = column_scorer, deadline: float | None = None, rows: int = 64):
    """U2 with outcomes: (scores, error) per row, one of the two null.

    ``rows`` inputs go to the model at a time.  If it raises, they are asked one
    by one, so that only the rows at fault carry the error's text (a TimeoutError
    is ``timeout``).  With a ``deadline``, in seconds an Arrow batch, rows whose
    answer isn't there by then are ``timeout``; a call under way is left behind,
    not interrupted.
    """
    schema = T.StructType([T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())), T.StructField("error", T.StringType())])

    @pandas_udf(schema)
    def outcome_udf(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in it:
            if model is None:
                model = loader()
            out = outcomes(model, batch, labels, None if deadline is None else time.monotonic() + deadline, rows)
            yield pd.DataFrame(out, columns=["scores", "error"], index=batch.index)

    return outcome_udf


def outcomes(model: ScoreFn, batch: pd.DataFrame, labels: list[str], until: float | None, rows: int) -> list[tuple]:
    """(scores, error) of every row of a batch (see ``make_outcome_udf``)."""
    late, out, calls = (None, TIMEOUT), [], ThreadPoolExecutor(1)

    def ask(part):
        if until is None:
            return model(part)
        left = until - time.monotonic()
        if left <= 0:
            raise TimeoutError
        return calls.submit(model, part).result(left)

    def some(part):
        try:
            got = ask(part)
            return [(dict(zip(labels, map(float, r))), None) for r in got[labels].itertuples(index=False)]
        except Exception as exc:  # whatever a model raises is the row's outcome
            if until is not None and time.monotonic() >= until:
                return [late] * len(part)
            if len(part) > 1:
                return [o for i in range(len(part)) for o in some(part.iloc[i : i + 1])]
            return [late if isinstance(exc, TimeoutError) else (None, str(exc))]

    try:
        for lo in range(0, len(batch), rows):
            out += some(batch.iloc[lo : lo + rows])
    finally:
        calls.shutdown(wait=False, cancel_futures=True)
    return out


def make_embed_udf(dim: int, embed: Callable[[pd.Series], pd.Series] | None = None):
    """Batch of inputs -> vectors; a vector of the wrong length becomes an
    ``embedding_shape_mismatch`` error instead of a value.  Default ``embed``
    passes stored vectors through."""
    schema = T.StructType([T.StructField("vector", T.ArrayType(T.DoubleType())),
                           T.StructField("error", T.StringType())])

    @pandas_udf(schema)
    def embed_udf(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fn = embed or (lambda s: s)
        for batch in it:
            vecs = fn(batch)
            ok = vecs.map(lambda v: v is not None and len(v) == dim)
            yield pd.DataFrame({"vector": vecs.where(ok, None), "error": ok.map({True: None, False: "embedding_shape_mismatch"})})

    return embed_udf
