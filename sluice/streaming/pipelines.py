"""Structured Streaming jobs: T1 stream_decide, T2 stream_rate_limit,
T3 stream_metrics, T4 stream_guard.

All four read a file stream (new Parquet files of a table), checkpoint to
the shared folder named by ``spark.checkpoint.dir`` (so a restarted or
relocated driver resumes exactly where it stopped, and lost executors only
re-run their tasks) and write Parquet sinks that batch queries read.

Ordering rule: the reference is arrival-ordered by wall clock; here each
micro-batch is ordered by event time (then id) within a key before it is
folded into the key's state.  Events arriving in a later micro-batch with
an older timestamp than ones already folded are evaluated against the
current state (never re-opened).

State of T2/T4 ends with what it can still decide: a timer per key fires when
the watermark (newest event time less ``late``) has passed the key's last
stored time by the window, and the key's state goes.  The watermark only moves
those timers.  The time column itself doesn't reach the stateful operator, so
no row is dropped as late: one that comes later than ``late`` is judged by
what state is left.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions.timecols import epoch_micros
from ..operators.ratelimit import fold_times
from ..session import scratch_path

MICROS = 1_000_000
#: How much later than the newest event an event may come and still meet its
#: key's whole state.
LATE = "1 hour"
#: Timers and per-key state need the RocksDB store.
STORE = ("spark.sql.streaming.stateStore.providerClass",
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def file_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """New files of table ``name`` as a stream, with the schema of the files
    that are there; ``max_files`` bounds a micro-batch if the caller wants."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    stream = spark.readStream.schema(schema)
    if max_files is not None:
        stream = stream.option("maxFilesPerTrigger", max_files)
    return stream.parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


def run_to_sink(df: DataFrame, name: str, at: str | None = None, write: Callable[[DataFrame, int, str], None] | None = None) -> str:
    """Drain the stream (availableNow) into a sink; return its path.

    ``at`` names the folder of sink and checkpoint, to resume a stream that
    ran there before.  Rows are appended as Parquet, or each micro-batch is
    given to ``write`` with its number and the path; ``write`` must replace
    what an earlier try of that number has written.
    """
    base = at or scratch_path(df.sparkSession, name)
    out = f"{base}/out"
    stream = df.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    with _store(df.sparkSession):
        q = stream.foreachBatch(lambda batch, epoch: write(batch, epoch, out)).start() if write else stream.format("parquet").start(out)
        q.awaitTermination()
    return out


@contextmanager
def _store(spark: SparkSession) -> Iterator[None]:
    """The state store of streams started inside; a started stream keeps it."""
    key, rocks = STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, rocks)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def decision_counts(dec: DataFrame, ts: str, width: str) -> DataFrame:
    """Counters of decisions per window: requests, blocks by reason, phases
    and final actions."""
    k = lambda m, v: F.struct(F.lit(m).alias("counter"), v.cast("string").alias("label"))
    keys = F.array_compact(F.concat(
        F.array(F.when(F.col("action") != "error", k("requests", F.lit(""))),
                F.when((F.col("action") == "block") & F.col("reason_code").isNotNull(), k("blocks", F.col("reason_code"))),
                F.when(F.col("action") != "error", k("actions", F.col("action")))),
        F.transform("reached", lambda p: k("phases", p))))
    rows = dec.select(F.window(ts, width).alias("w"), F.explode(keys).alias("k"))
    return rows.groupBy("w", "k.counter", "k.label").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "counter", "label", "n")


def write_counts(ts: str, width: str) -> Callable[[DataFrame, int, str], None]:
    """T3's sink.  Counters add up, so each micro-batch writes its own below its
    number and no state is held: no watermark, and no row is too late."""
    def write(batch: DataFrame, epoch: int, path: str) -> None:
        decision_counts(batch, ts, width).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return write


def total_counts(spark: SparkSession, out: str) -> DataFrame:
    """The counters so far: sums over the micro-batches."""
    rows = spark.read.schema("window_start timestamp, counter string, label string, n bigint").parquet(out)
    return rows.groupBy("window_start", "counter", "label").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ state with expiry

def _expire_at(handle, last_us: int | None, keep_us: int) -> None:
    """The key's only timer: once the watermark is there, no event in time can
    be within ``keep_us`` of ``last_us``."""
    for t in list(handle.listTimers()):
        handle.deleteTimer(t)
    if last_us is not None:
        handle.registerTimer((last_us + keep_us) // 1000 + 1)


def _columns(rows: Iterator[pd.DataFrame], names: list[str]) -> list[np.ndarray]:
    """The key's rows of this micro-batch in event time, as arrays (time and id
    first): ids, times and flags only, column by column."""
    parts = [[p[c].to_numpy() for c in ("t_us", "rid", *names)] for p in rows]
    cols = [np.concatenate(c) for c in zip(*parts)]
    order = np.lexsort((cols[1], cols[0]))
    return [cols[0][order].astype(np.int64), *(c[order] for c in cols[1:])]


def _stateful(ev: DataFrame, key: str, order_id: str, processor: StatefulProcessor, out: list[T.StructField], like: T.StructType) -> DataFrame:
    schema = T.StructType([T.StructField("_key", like[key].dataType), T.StructField("_rid", like[order_id].dataType), *out])
    return ev.groupBy("grp").transformWithStateInPandas(processor, schema, "Append", "eventTime") \
        .withColumnRenamed("_rid", order_id).withColumnRenamed("_key", key)


def _timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    """``t_us`` in microseconds, and the watermark over it.  Names that begin
    with an underscore would not reach the stateful function."""
    return df.withColumn("t_us", epoch_micros(df, ts)).withColumn("_ts", F.timestamp_micros("t_us")).withWatermark("_ts", late)


# ------------------------------------------------------------------ T2: per-key rate-limit state

class RateState(StatefulProcessor):
    """Admitted times of a key; gone once the window has passed the last one."""

    def __init__(self, window_us: int, max_hits: int):
        self.window_us, self.max_hits = window_us, max_hits

    def init(self, handle) -> None:
        self.handle = handle
        self.hits = handle.getValueState("hits", T.StructType([T.StructField("hits", T.ArrayType(T.LongType()))]))

    def handleInputRows(self, key, rows, timerValues):
        hits = deque(int(x) for x in self.hits.get()[0]) if self.hits.exists() else deque()
        ts, rid = _columns(rows, [])
        limited = fold_times(ts, hits, self.window_us, self.max_hits)
        if hits:
            self.hits.update(([int(x) for x in hits],))
        else:
            self.hits.clear()
        _expire_at(self.handle, int(hits[-1]) if hits else None, self.window_us)
        yield pd.DataFrame({"_key": [key[0]] * len(ts), "_rid": rid, "limited": limited})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.hits.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_rate_limit(events: DataFrame, *, key: str, ts: str, order_id: str, window_seconds: int,
                      max_requests: int, late: str = LATE) -> DataFrame:
    """W1 as a stateful stream (state <= max_requests timestamps per key,
    for keys with an admitted event in the last window + ``late`` only)."""
    ev = _timed(events, ts, late).select(F.col(key).alias("grp"), F.col(order_id).alias("rid"), "t_us")
    return _stateful(ev, key, order_id, RateState(int(window_seconds) * MICROS, int(max_requests)),
                     [T.StructField("limited", T.BooleanType())], events.schema)


# ------------------------------------------------------------------ T4: watchdog state

def guard_fold(ts: np.ndarray, ok: np.ndarray, log_hit: np.ndarray, streak: int, restarts: list,
               cooldown_us: int, window_us: int, max_restarts: int, threshold: int):
    """One service's ticks in order: log hit first, then the health streak.

    Returns (restarts_done per tick, attempts per tick, streak, restarts).
    A restart is allowed when the last one is at least ``cooldown`` old and
    fewer than ``max_restarts`` were kept in the window; the streak resets
    after reaching the threshold whether or not the restart was allowed.
    """
    r = deque(restarts)
    done = np.zeros(len(ts), dtype=np.int32)
    ok, log_hit = np.asarray(ok, bool), np.asarray(log_hit, bool)
    at = np.arange(len(ts))
    # failures since the last good tick, those carried in included
    good = np.maximum.accumulate(np.where(ok, at, -1))
    failed = np.where(good < 0, at + 1 + min(streak, max(threshold, 1) - 1), at - good)
    due = ~ok & (failed % max(threshold, 1) == 0)
    tried = log_hit.astype(np.int32) + due

    def attempt(now):
        if r and now - r[-1] < cooldown_us:
            return False
        while r and now - r[0] > window_us:
            r.popleft()
        if len(r) >= max_restarts:
            return False
        r.append(int(now))
        return True

    for i in np.flatnonzero(tried):
        for _ in range(tried[i]):
            done[i] += attempt(ts[i])
    left = 0 if not len(ts) or ok[-1] else int(failed[-1]) % max(threshold, 1)
    return done, tried, left if len(ts) else streak, list(r)


class GuardState(StatefulProcessor):
    """Streak and kept restarts of a service.  Once the window and the cooldown
    have passed the last restart, the restarts go, and the state with them
    unless a streak of failures is open (the rule lets no time end that)."""

    def __init__(self, cooldown_us: int, window_us: int, max_restarts: int, threshold: int):
        self.rule = (cooldown_us, window_us, max_restarts, threshold)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("guard", T.StructType([
            T.StructField("streak", T.IntegerType()), T.StructField("restarts", T.ArrayType(T.LongType()))]))

    def _keep(self, streak: int, restarts: list) -> None:
        if streak or restarts:
            self.state.update((int(streak), [int(x) for x in restarts]))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues):
        streak, restarts = (self.state.get()[0], list(self.state.get()[1])) if self.state.exists() else (0, [])
        ts, rid, ok, log_hit = _columns(rows, ["ok", "log_hit"])
        done, tried, streak, restarts = guard_fold(ts, ok, log_hit, int(streak), restarts, *self.rule)
        self._keep(streak, restarts)
        _expire_at(self.handle, int(restarts[-1]) if restarts else None, max(self.rule[:2]))
        yield pd.DataFrame({"_key": [key[0]] * len(ts), "_rid": rid, "attempts": tried, "restarts": done})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists():
            self._keep(int(self.state.get()[0]), [])
        return iter(())

    def close(self) -> None:
        pass


def stream_guard(ticks: DataFrame, *, key: str, ts: str, order_id: str, ok: str, log_hit: str,
                 cooldown_seconds: int = 120, window_seconds: int = 3600, max_restarts: int = 6,
                 threshold: int = 3, late: str = LATE) -> DataFrame:
    """T4: the watchdog tick loop per service as a stateful stream."""
    ev = _timed(ticks, ts, late).select(F.col(key).alias("grp"), F.col(order_id).alias("rid"), "t_us",
                                        F.col(ok).alias("ok"), F.col(log_hit).alias("log_hit"))
    rule = GuardState(cooldown_seconds * MICROS, window_seconds * MICROS, max_restarts, threshold)
    return _stateful(ev, key, order_id, rule, [T.StructField("attempts", T.IntegerType()), T.StructField("restarts", T.IntegerType())], ticks.schema)


def guard_batch(ticks: DataFrame, *, key: str, ts: str, order_id: str, ok: str, log_hit: str,
                cooldown_seconds: int = 120, window_seconds: int = 3600, max_restarts: int = 6,
                threshold: int = 3) -> DataFrame:
    """T4 batch twin: one streaming fold per service over sorted partitions
    (the streak never expires, so services are not cut into segments)."""
    ev = ticks.select(F.col(order_id).alias("_rid"), F.col(key).alias("_k"), epoch_micros(ticks, ts).alias("_t"),
                      F.col(ok).alias("ok"), F.col(log_hit).alias("log_hit"))
    cd, wu = cooldown_seconds * MICROS, window_seconds * MICROS

    def run(batches):
        cur, streak, restarts = None, 0, []
        for pdf in batches:
            outs_d, outs_t = [], []
            keys = pdf["_k"].to_numpy()
            start = 0
            for i in range(1, len(pdf) + 1):
                if i == len(pdf) or keys[i] != keys[start]:
                    if keys[start] != cur:
                        cur, streak, restarts = keys[start], 0, []
                    seg = pdf.iloc[start:i]
                    d, t, streak, restarts = guard_fold(seg["_t"].to_numpy(np.int64), seg["ok"].to_numpy(bool),
                                                        seg["log_hit"].to_numpy(bool), streak, restarts, cd, wu,
                                                        max_restarts, threshold)
                    outs_d.append(d)
                    outs_t.append(t)
                    start = i
            yield pd.DataFrame({"_k": keys, "_rid": pdf["_rid"].to_numpy(),
                                "attempts": np.concatenate(outs_t) if outs_t else np.zeros(0, np.int32),
                                "restarts": np.concatenate(outs_d) if outs_d else np.zeros(0, np.int32)})

    schema = T.StructType([T.StructField("_k", ticks.schema[key].dataType),
                           T.StructField("_rid", ticks.schema[order_id].dataType),
                           T.StructField("attempts", T.IntegerType()), T.StructField("restarts", T.IntegerType())])
    ordered = ev.repartition("_k").sortWithinPartitions("_k", "_t", "_rid")
    return ordered.mapInPandas(run, schema).withColumnRenamed("_rid", order_id).withColumnRenamed("_k", key)
