"""Operator 5: nearest neighbours by inner product over rotated one-bit codes.

A vector is padded to BITS dimensions and turned by one random rotation; its
code is the signs, packed, with two scalars: its length and the inner product
of the unit vector with its own code.  Their quotient corrects the estimate
of an inner product taken from the code; the error is at most EPS deviations
of the known error law (the same for every vector and query).  A vector is
reranked with its original components, in double precision, when its upper
bound reaches the k-th best exact score found so far.

Queries are a stated set.  Queries and candidates are dealt into blocks of
bounded size; each pair of blocks is one group that returns at most k rows a
query, and a ranked window merges the blocks.  The full scan of the codes is
part of the method: no candidate list is capped.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do vectors of another length than the commonest
(the larger, if two are as common), nor rows without an id; of rows that
repeat an id the smallest vector counts; ties go to the smaller id; with
fewer candidates than k all are returned; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K, EVERY = 20, 20
BITS, EPS, SEED = 256, 4.0, 11
#: Rows of a candidate block and of a query block, about.
BLOCK, QUERY_BLOCK = 16384, 4096


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """First ``dim`` rows of a random orthogonal BITS x BITS matrix."""
    bits = max(BITS, dim)
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim].astype(np.float32)


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed codes, lengths, inner products of units and their codes)."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    y = (x / norm[:, None]).astype(np.float32) @ turn
    return np.packbits(y > 0, axis=1), norm, np.abs(y).sum(1, dtype=np.float64) / np.sqrt(turn.shape[1])


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with q, summed from the first component
    to the last, whatever the block."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * q[j]
    return out


def block_search(qid, q, cid, x, code, norm, fit, k: int, turn: np.ndarray):
    """Best k of the block for each query: lists of (query row, candidate row,
    score), by score and id."""
    bits = turn.shape[1]
    signs = np.unpackbits(code, axis=1, count=bits).astype(np.float32) * 2 - 1
    err = EPS * np.sqrt(np.maximum(1 - fit * fit, 0)) / fit / np.sqrt(bits - 1)
    turned = q.astype(np.float32) @ turn / np.float32(np.sqrt(bits))
    out = []
    for lo in range(0, len(q), 256):
        est = (turned[lo : lo + 256] @ signs.T) / fit
        for i, e in enumerate(est, lo):
            qn = np.sqrt(q[i] @ q[i])
            upper, e = (e + err * qn) * norm, e * norm
            own = cid == qid[i]
            upper[own], e[own] = -np.inf, -np.inf
            first = np.argpartition(-e, min(2 * k, len(e) - 1))[: 2 * k] if len(e) > 2 * k else np.arange(len(e))
            first = first[~own[first]]
            score = exact(x[first], q[i])
            # the rest whose bound reaches the k-th best so far
            at = np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -np.inf
            more = upper >= at - 1e-5 * abs(at)
            more[first] = False
            more = np.flatnonzero(more & ~own)
            rows = np.concatenate((first, more))
            score = np.concatenate((score, exact(x[more], q[i])))
            best = np.lexsort((cid[rows], -score))[:k]
            out.append((np.full(len(best), i), rows[best], score[best]))
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """``id, v``: one valid vector per id, all of one length."""
    v = F.transform(F.col("v"), lambda c: c.cast("double"))
    ok = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    one = vectors.where(F.col("id").isNotNull() & F.col("v").isNotNull()).select(F.col("id").cast("bigint").alias("id"), v.alias("v")).where(ok)
    one = one.groupBy("id").agg(F.min("v").alias("v"))
    return one


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """``vectors``: id, v.  Queries are the ids divisible by ``every``.
    Returns ``query_id, rank, vec_id, score``."""
    spark = vectors.sparkSession
    rows = materialize(usable(vectors), "ann-vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("id") % every == 0).cast("int")).alias("q"))
    top = sizes.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    kind = "query_id bigint, rank int, vec_id bigint, score double"
    if not top:
        return spark.createDataFrame([], kind)
    dim, n, nq = top[0]["d"], top[0]["n"], top[0]["q"]
    rows = rows.where(F.size("v") == dim)
    turn = rotation(dim)

    def codes(parts):
        for p in parts:
            if len(p):
                x = np.stack(p["v"].to_numpy()).astype(np.float64)
                code, norm, fit = encode(x, turn)
                yield pd.DataFrame({"id": p["id"], "v": p["v"], "code": [c.tobytes() for c in code], "norm": norm, "fit": fit})

    coded = rows.mapInPandas(codes, "id bigint, v array<double>, code binary, norm double, fit double")
    coded = materialize(coded, "ann-codes")
    n_c, n_q = -(-n // BLOCK), max(1, -(-nq // QUERY_BLOCK))
    block = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    cands = coded.withColumn("cb", block(n_c)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    queries = rows.where(F.col("id") % every == 0).withColumn("qb", block(n_q)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))

    def search(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, x = (np.stack(f["v"].to_numpy()).astype(np.float64) for f in (left, right))
        code = np.stack([np.frombuffer(c, np.uint8) for c in right["code"]])
        qid, cid = left["id"].to_numpy(), right["id"].to_numpy()
        got = block_search(qid, q, cid, x, code, right["norm"].to_numpy(), right["fit"].to_numpy(), k, turn)
        i, j, s = (np.concatenate(c) for c in zip(*got))
        return pd.DataFrame({"query_id": qid[i], "vec_id": cid[j], "score": s})

    found = queries.select("qb", "cb", "id", "v").groupBy("qb", "cb").cogroup(cands.groupBy("qb", "cb")).applyInPandas(
        search, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
