"""Stream = batch, the watchdog against a plain-Python replay, and plan
shapes that matter at scale."""

import numpy as np
from pyspark.sql import functions as F

from sluice.plans import all_queries
from sluice.session import table
from sluice.streaming import pipelines as S
from sluice.streaming.pipelines import guard_batch, guard_fold

QUERIES, _ = all_queries()


def _py_guard(rows, cooldown=120, window=3600, cap=6, threshold=3):
    out, state = {}, {}
    for rid, key, t, ok, log in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        streak, restarts = state.get(key, (0, []))
        attempts = done = 0

        def attempt():
            nonlocal restarts
            if restarts and t - restarts[-1] < cooldown:
                return 0
            restarts = [x for x in restarts if t - x <= window]
            if len(restarts) >= cap:
                return 0
            restarts.append(t)
            return 1
        if log:
            attempts += 1
            done += attempt()
        if ok:
            streak = 0
        else:
            streak += 1
            if streak >= threshold:
                attempts += 1
                done += attempt()
                streak = 0
        state[key] = (streak, restarts)
        out[rid] = (attempts, done)
    return out


def test_guard_fold_matches_python():
    rng = np.random.default_rng(7)
    ts = np.cumsum(rng.integers(1, 90, 400))
    ok = rng.random(400) > 0.6
    log = rng.random(400) > 0.8
    d, t, _, _ = guard_fold(ts * 1_000_000, ok, log, 0, [], 120_000_000, 3_600_000_000, 6, 3)
    want = _py_guard([(i, "s", int(x), bool(o), bool(lg)) for i, (x, o, lg) in enumerate(zip(ts, ok, log))])
    assert [(int(a), int(b)) for a, b in zip(t, d)] == [want[i] for i in range(400)]


def _in_files(spark, sf, at, n=3):
    """The events table as n files that overlap in time."""
    ev = table(spark, sf, "events")
    for i in range(n):
        ev.where(F.col("event_id") % n == i).coalesce(1).write.mode("append").parquet(f"{at}/events.parquet")
        yield


def test_streams_over_micro_batches_and_a_restart(spark, sf, tmp_path):
    """State carries over micro-batches, and a stream that is stopped after
    some files goes on from its checkpoint."""
    rate = lambda: S.stream_rate_limit(S.file_stream(spark, str(tmp_path), "events", max_files=1), key="user_id", ts="ts",
                                       order_id="event_id", window_seconds=86400, max_requests=2, late="400 days")
    for _ in _in_files(spark, sf, tmp_path):
        out = S.run_to_sink(rate(), "rate", at=f"{tmp_path}/rate")
    got = {r.event_id: r.limited for r in spark.read.parquet(out).collect()}
    once = S.run_to_sink(rate(), "rate", at=f"{tmp_path}/once")
    assert got == {r.event_id: r.limited for r in spark.read.parquet(once).collect()}
    rows = [(r.event_id, r.user_id, r.ts) for r in table(spark, sf, "events").collect()]
    want, state = {}, {}
    for i in range(3):  # batch by batch, in event time within each
        for rid, key, t in sorted((r for r in rows if r[0] % 3 == i), key=lambda r: (r[1], r[2], r[0])):
            hits = state.setdefault(key, [])
            while hits and (t - hits[0]).total_seconds() > 86400:
                hits.pop(0)
            want[rid] = len(hits) >= 2
            if not want[rid]:
                hits.append(t)
    assert got == want


def _events(spark, path, rows):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, k, t0 + dt.timedelta(seconds=s), ok) for i, k, s, ok in rows], "id long, k string, ts timestamp_ntz, ok boolean")
    df.coalesce(1).write.mode("append").parquet(f"{path}/ticks.parquet")


def test_state_of_quiet_keys_goes_and_late_rows_stay(spark, tmp_path):
    """After its window a quiet key has no state; a row later than the
    watermark is judged with what is left, not dropped."""
    kw = dict(key="k", ts="ts", order_id="id", late="10 seconds")
    jobs = {"rate": lambda src: S.stream_rate_limit(src, window_seconds=60, max_requests=2, **kw),
            "guard": lambda src: S.stream_guard(src.withColumn("log_hit", ~F.col("ok")), ok="ok", log_hit="log_hit", cooldown_seconds=5,
                                                window_seconds=60, **kw)}
    left = {}

    def drain(name):
        src = S.file_stream(spark, str(tmp_path), "ticks")
        at = f"{tmp_path}/{name}"
        out = S.run_to_sink(jobs[name](src), name, at=at)
        var = {"rate": "hits", "guard": "guard"}[name]
        got = spark.read.format("statestore").option("path", f"{at}/checkpoint").option("stateVarName", var).load()
        left[name] = {r.key.grp for r in got.select("key").collect()}
        return {r.id: r for r in spark.read.parquet(out).collect()}

    _events(spark, tmp_path, [(1, "a", 0, False), (2, "a", 1, True), (3, "a", 2, True), (4, "b", 3, False)])
    rate, guard = drain("rate"), drain("guard")
    assert {i: r.limited for i, r in rate.items()} == {1: False, 2: False, 3: True, 4: False}
    assert {i: r.restarts for i, r in guard.items()} == {1: 1, 2: 0, 3: 0, 4: 1}
    assert left == {"rate": {"a", "b"}, "guard": {"a", "b"}}
    _events(spark, tmp_path, [(5, "a", 40, True), (6, "c", 200, False)])
    rate, guard = drain("rate"), drain("guard")
    assert rate[5].limited and not rate[6].limited  # state was there for a row in time
    assert left == {"rate": {"c"}, "guard": {"b", "c"}}  # b's streak is open
    _events(spark, tmp_path, [(7, "a", 41, True), (8, "b", 42, False), (9, "b", 43, False)])
    rate, guard = drain("rate"), drain("guard")
    assert sorted(rate) == sorted(guard) == list(range(1, 10))
    assert not rate[7].limited
    assert (guard[9].attempts, guard[9].restarts) == (2, 0)  # the streak of three came over, within the cooldown


def test_audit_epochs_replace_what_a_failed_try_wrote(spark, tmp_path):
    """A micro-batch that fails after it has written is run again: each record
    is there once."""
    import pytest

    from sluice.operators.sinks import write_audit_epoch

    def failing(batch, epoch, path):
        write_audit_epoch(batch, epoch, path)
        if epoch == 1:
            raise RuntimeError("lost")

    def audit():
        src = S.file_stream(spark, str(tmp_path), "ticks", max_files=1)
        return src.select(F.when(F.col("ok"), "observe").otherwise("block").alias("final_action"), F.to_json(F.struct("id")).alias("value"))

    for i in range(3):
        _events(spark, tmp_path, [(10 * i + j, "a", j, j % 2 == 0) for j in range(10)])
    with pytest.raises(Exception, match="lost"):
        S.run_to_sink(audit(), "audit", at=f"{tmp_path}/audit", write=failing)
    out = S.run_to_sink(audit(), "audit", at=f"{tmp_path}/audit", write=write_audit_epoch)
    got = spark.read.text(out).collect()
    assert sorted(r.value for r in got) == sorted('{"id":%d}' % i for i in range(30))
    assert {r.final_action for r in got} == {"block", "observe"} and {r.epoch for r in got} == {0, 1, 2}


def test_counts_add_up_over_micro_batches(spark, tmp_path):
    """Counters need no order in time: files overlap, nothing is too late."""
    for i in range(3):
        _events(spark, tmp_path, [(10 * i + j, "a", 40000 * (2 - i) + j, j % 2 == 0) for j in range(10)])
    src = S.file_stream(spark, str(tmp_path), "ticks", max_files=1)
    dec = src.select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("ok"), "allow").otherwise("block").alias("action"),
                     F.when(~F.col("ok"), "X").alias("reason_code"), F.array(F.lit("phase1")).alias("reached"))
    out = S.run_to_sink(dec, "counts", at=f"{tmp_path}/counts", write=S.write_counts("ts", "12 hours"))
    got = {(r.window_start.hour, r.counter, r.label): r.n for r in S.total_counts(spark, out).collect()}
    want = {}
    for w, n in ((0, 20), (12, 10)):
        want |= {(w, "requests", ""): n, (w, "blocks", "X"): n // 2, (w, "actions", "allow"): n // 2, (w, "actions", "block"): n // 2,
                 (w, "phases", "phase1"): n}
    assert got == want


def test_one_key_below_the_limit_is_cut_into_segments(spark):
    import datetime as dt

    from sluice.operators.ratelimit import MICROS, rate_limit, segments

    t0 = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(i, "k", t0 + dt.timedelta(seconds=7 * i)) for i in range(2000)], "id long, k string, ts timestamp_ntz")
    per = segments(ev.withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp"))), "k", "_t", 60 * MICROS, 30).collect()
    assert len({r.seg for r in per}) == len(per) > 200
    assert rate_limit(ev, key="k", ts="ts", order_id="id", window_seconds=60, max_requests=30).where("limited").count() == 0
    rng = np.random.default_rng(3)
    secs = np.cumsum(rng.integers(0, 40, 3000))
    ev = spark.createDataFrame([(i, "k", t0 + dt.timedelta(seconds=int(x))) for i, x in enumerate(secs)], "id long, k string, ts timestamp_ntz")
    for most, cool in ((3, 0), (4, 0), (2, 25), (6, 120)):
        got = {r.id: r.limited for r in rate_limit(ev, key="k", ts="ts", order_id="id", window_seconds=60, max_requests=most, cooldown_seconds=cool).collect()}
        hits, want = [], {}
        for i, x in enumerate(secs):
            hits = [h for h in hits if x - h <= 60]
            want[i] = len(hits) >= most or bool(cool and hits and x - hits[-1] < cool)
            if not want[i]:
                hits.append(x)
        assert got == want, (most, cool)


def test_stream_guard_equals_batch(spark, sf):
    stream = {r.event_id: (r.attempts, r.restarts) for r in QUERIES["stream_guard"](spark, sf).collect()}
    ev = table(spark, sf, "events").select(
        "event_id", "user_id", "ts", (F.col("event_type") != "error").alias("ok"),
        ((F.col("event_type") == "error") & (F.col("value") > 25)).alias("log_hit"))
    batch = {r.event_id: (r.attempts, r.restarts)
             for r in guard_batch(ev, key="user_id", ts="ts", order_id="event_id", ok="ok", log_hit="log_hit").collect()}
    assert stream == batch


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chain_has_no_nested_loop_or_cartesian(spark, sf):
    for name in ("blocks_by_reason", "evaluate_text", "terms_theta", "golden_relevance", "rate_limit"):
        p = _plan(QUERIES[name](spark, sf))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_document_scan_is_pruned(spark, sf):
    p = _plan(QUERIES["blocks_by_reason"](spark, sf))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p or "struct<doc_id:bigint,text:string>" in p
    assert "n_chars" not in p.split("ReadSchema")[1].split("\n")[0]


def test_rate_limit_has_no_collect_list(spark, sf):
    p = _plan(QUERIES["rate_limit"](spark, sf))
    assert "collect_list" not in p and "MapInPandas" in p
