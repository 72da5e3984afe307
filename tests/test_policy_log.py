"""The incremental policy log: batches, repeated batches, reopening; one read of the log."""

from pyspark.sql import functions as F

from sluice.operators import policy as P
from sluice.operators.policy_log import PolicyLog
from sluice.plans.q_policy import change_log


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_batches_repeats_and_reopening_equal_one_replay(spark, sf, tmp_path):
    changes, entries = change_log(spark, sf)
    changes = changes.where("seq < 900").cache()
    entries = entries.where("seq < 900").cache()
    whole = P.accept_changes(changes, entries)
    log = PolicyLog(spark, str(tmp_path))
    parts = [(0, 250), (250, 310), (310, 310), (310, 640), (640, 900)]
    got = []
    for i, (lo, hi) in enumerate(parts):
        cut = F.col("seq").between(lo, hi - 1)
        if i == 3:  # a batch that failed half-way is added again
            log.add(changes.where(cut), entries.where(cut))
            log.batches -= 1
        if i == 4:
            log = PolicyLog(spark, str(tmp_path))
            assert log.batches == 4
        got += [tuple(r) for r in log.add(changes.where(cut), entries.where(cut)).select("policy_id", "seq", "accepted", "version", "current").collect()]
    assert sorted(got, key=repr) == _rows(whole.select("policy_id", "seq", "accepted", "version", "current"))
    assert _rows(log.intervals()) == _rows(P.entry_intervals(changes, entries, whole))
    assert _rows(log.currents()) == _rows(P.latest_versions(whole).select("policy_id", "current_version"))


def test_the_log_is_read_once(spark, sf):
    changes, entries = (x.persist() for x in change_log(spark, sf))
    seen = {c: spark.sparkContext.accumulator(0) for c in ("changes", "entries")}

    def counted(df, name):
        total = seen[name]

        def count(parts):
            for p in parts:
                total.add(p.num_rows)
                yield p

        return df.mapInArrow(count, df.schema)

    events, accepted, _ = P.written_history(counted(changes, "changes"), counted(entries, "entries"))
    P.intervals_of(events, accepted).count()
    assert seen["changes"].value == changes.count() and seen["entries"].value == entries.count()
