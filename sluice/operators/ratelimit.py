"""W1 rate_limit: per-key sliding window that records admitted hits only.

Rule, per key in event order (ts, then id): drop stored hits older than the
window (age strictly greater than ``window``), reject when ``max`` hits
remain, otherwise admit and store the hit.  Rejected hits are not stored,
so a plain range-window count is wrong; the rule is a fold.

Plan:

1. ``(key, bucket = ts // window)`` -> count, min and max time.  A partial
   aggregate, so a key that holds a third of all rows shuffles one row a bucket.
2. On that compact table a bucket is *calm* when it and the one before hold at
   most ``max`` events together: each of its events then sees fewer than
   ``max`` raw hits in its window and is surely admitted.  So after a calm
   bucket the stored hits are exactly its events, and the fold can start anew
   with them as seeds; after an empty bucket or a gap it starts with none.
   That cuts all traffic that stays below the limit.
3. Events join the bucket table on (key, bucket) for their segment (and, in a
   calm bucket, once more as seeds of the next), are dealt by (key, segment),
   so a hot key's segments land in different tasks, sorted within partitions,
   and folded by a streaming ``mapInPandas`` whose state is at most ``max``
   times.  The fold steps from one admitted hit to the next: once the window
   is full, a sorted search finds the first event late enough, and all before
   it are refused at once.

What stays sequential is one stretch of one key that is at its limit.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timecols import epoch_micros

MICROS = 1_000_000


def segments(events: DataFrame, key: str, t_us: str, window_us: int, max_hits: int, cooldown_us: int = 0) -> DataFrame:
    """(key, bucket, seg, seeds) for every occupied bucket of every key;
    ``seeds`` is the segment that starts with this bucket's events, if one does."""
    b = events.select(key, t_us, F.floor(F.col(t_us) / window_us).cast("long").alias("bucket"))
    per = b.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n"), F.min(t_us).alias("t_min"), F.max(t_us).alias("t_max"))
    w = Window.partitionBy(key).orderBy("bucket")
    beside = F.lag("bucket").over(w) == F.col("bucket") - 1
    gap = F.col("t_min") - F.lag("t_max").over(w)
    calm = F.col("n") + F.when(beside, F.lag("n").over(w)).otherwise(0) <= max_hits
    if cooldown_us:
        calm = calm & (F.col("n") == 1) & (gap.isNull() | (gap >= cooldown_us))
    per = per.withColumns({"_calm": calm, "_empty": F.coalesce(~beside | (gap > window_us), F.lit(True))})
    seeded = ~F.col("_empty") & F.lag("_calm").over(w)
    per = per.withColumn("_seeded", F.coalesce(seeded, F.lit(False)))
    starts = (F.col("_empty") | F.col("_seeded")).cast("int")
    per = per.withColumn("seg", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return per.select(key, "bucket", "seg", F.when(F.lead("_seeded").over(w), F.lead("seg").over(w)).alias("seeds"))


def fold_times(ts: np.ndarray, hits: deque, window_us: int, max_hits: int, cooldown_us: int = 0) -> np.ndarray:
    """Refusals of one key's events in order; ``hits`` are the admitted times
    that still count, kept up to date.  Goes from admitted event to admitted
    event: the refused ones between are found by sorted search."""
    out = np.zeros(len(ts), bool)
    i = 0
    while i < len(ts):
        now = int(ts[i])
        while hits and now - hits[0] > window_us:
            hits.popleft()
        j = i
        if len(hits) >= max_hits:
            j = int(np.searchsorted(ts, hits[0] + window_us, "right")) if hits else len(ts)
        elif cooldown_us and hits and now - hits[-1] < cooldown_us:
            j = int(min(np.searchsorted(ts, hits[-1] + cooldown_us, "left"), np.searchsorted(ts, hits[-1] + window_us, "right")))
        if j > i:
            out[i:j] = True
            i = j
            continue
        hits.append(now)
        i += 1
    return out


def _fold_batches(key: str, window_us: int, max_hits: int, cooldown_us: int = 0):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, hits = None, deque()
        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            keys, segs, seed = pdf[key].to_numpy(), pdf["_seg"].to_numpy(), pdf["_seed"].to_numpy(dtype=bool)
            ts = pdf["_t"].to_numpy(dtype=np.int64)
            out = np.zeros(n, dtype=bool)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (segs[1:] != segs[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, n]):
                if (keys[lo], segs[lo]) != cur:
                    cur, hits = (keys[lo], segs[lo]), deque()
                own = lo + int(seed[lo:hi].sum())  # seeds are older than all others of their segment
                hits.extend(int(t) for t in ts[lo:own])
                out[own:hi] = fold_times(ts[own:hi], hits, window_us, max_hits, cooldown_us)
            pdf["limited"] = out
            yield pdf[~seed]
    return run


def rate_limit(events: DataFrame, *, key: str, ts: str, order_id: str, window_seconds: int,
               max_requests: int, eligible: str | None = None, cooldown_seconds: int = 0) -> DataFrame:
    """Add a boolean ``limited`` column (null for rows not eligible).

    With ``cooldown_seconds`` a hit is also refused while the last admitted
    hit is younger than the cooldown (the restart-budget rule, W2).

    Rows pass through the fold, so feed it narrow rows (ids, key, time,
    flags) and keep wide text out.  ``eligible`` names a boolean column:
    only those rows consult (and may feed) the limiter - malformed rows and
    rows whose policy switches phase 1 off never reach it.
    """
    window_us = int(window_seconds) * MICROS
    cols = events.columns
    base = events.withColumn("_t", epoch_micros(events, ts))
    cand = base.where(F.col(eligible)) if eligible else base
    cooldown_us = int(cooldown_seconds) * MICROS
    seg = segments(cand, key, "_t", window_us, int(max_requests), cooldown_us)
    seg = seg.select(F.col(key), F.col("bucket").alias("_bucket"), F.filter(F.array(
        F.struct(F.col("seg").alias("seg"), F.lit(False).alias("seed")), F.when(F.col("seeds").isNotNull(), F.struct(F.col("seeds").alias("seg"), F.lit(True).alias("seed")))),
        lambda s: s.isNotNull()).alias("_s"))
    tagged = cand.withColumn("_bucket", F.floor(F.col("_t") / window_us).cast("long")).join(seg, [key, "_bucket"])
    tagged = tagged.withColumn("_s", F.explode("_s")).select(*cols, "_t", F.col("_s.seg").alias("_seg"), F.col("_s.seed").alias("_seed"))
    ordered = tagged.repartition(key, "_seg").sortWithinPartitions(key, "_seg", "_t", order_id)
    schema = T.StructType(list(ordered.schema.fields) + [T.StructField("limited", T.BooleanType())])
    flagged = ordered.mapInPandas(_fold_batches(key, window_us, int(max_requests), cooldown_us), schema).select(*cols, "limited")
    if not eligible:
        return flagged
    rest = events.where(~F.coalesce(F.col(eligible), F.lit(False))).withColumn("limited", F.lit(None).cast("boolean"))
    return flagged.unionByName(rest)


def rate_limit_sql(table: str, key: str, ts: str, order_id: str, window_seconds: int, max_requests: int,
                   cooldown_seconds: int = 0, where: str = "TRUE") -> str:
    """DuckDB recursive-CTE replay of the same rule (oracle)."""
    w = int(window_seconds) * MICROS
    m = int(max_requests)
    c = int(cooldown_seconds) * MICROS
    kept = f"list_filter(r.hits, lambda h: e.t - h <= {w})"
    refuse = f"(len({kept}) >= {m} OR (len({kept}) > 0 AND e.t - list_max({kept}) < {c}))"
    return f"""
WITH RECURSIVE ev AS (
  SELECT {order_id} AS rid, {key} AS k, epoch_us({ts}) AS t,
         row_number() OVER (PARTITION BY {key} ORDER BY {ts}, {order_id}) AS rn
  FROM {table} WHERE {where}
),
r(k, rn, rid, limited, hits) AS (
  SELECT k, rn, rid, false, [t] FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.k, e.rn, e.rid,
         {refuse},
         CASE WHEN {refuse} THEN {kept} ELSE list_append({kept}, e.t) END
  FROM r JOIN ev e ON e.k = r.k AND e.rn = r.rn + 1
)"""
