"""V1/V2 incremental: policy history that grows batch by batch.

A batch of changes (all later than those before it) is merged into what is
stored, and touches only the (policy, list) pairs that it names: their live
entries start the batch's events, and only they are read.

``path`` holds three tables, one folder a batch:

* ``entries/batch=n``: the intervals that batch n closed or opened, and those
  that stay live in the lists it touched, so an interval is final once it is
  closed, and a list's live entries are those of the last batch that touched it;
* ``touched/batch=n``: the (policy, list) pairs that batch n touched;
* ``current/batch=n``: the newest version of the policies that batch n names.

Each folder is written whole and replaced if the batch is added again, and
``current`` last, so a batch that failed half-way is done again from the same
state; a log opened on an existing path goes on after its last whole batch.

Defined cases: an empty batch stores nothing but its folders; a batch that
names a policy for the first time starts it at version 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import policy as P

_ENTRIES = "policy_id string, list string, entry_id string, value string, valid_from bigint, valid_to bigint, batch int"
_TOUCHED = "policy_id string, list string, batch int"
_CURRENT = "policy_id string, current bigint, batch int"


class PolicyLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.batches = 0
        self.spark.createDataFrame([], _CURRENT).write.mode("append").partitionBy("batch").parquet(f"{self.path}/current")
        last = self._table("current", _CURRENT).agg(F.max("batch")).first()[0]
        self.batches = 0 if last is None else last + 1

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("batch") < self.batches if self.batches else F.lit(True))

    def _write(self, name: str, df: DataFrame) -> None:
        df.drop("batch").write.mode("overwrite").parquet(f"{self.path}/{name}/batch={self.batches}")

    def currents(self) -> DataFrame:
        """(policy_id, current) of every policy so far."""
        return self._table("current", _CURRENT).groupBy("policy_id").agg(F.max("current").alias("current"))

    def _live(self, touched: DataFrame | None = None) -> DataFrame:
        """The live intervals, of the lists ``touched`` where given: those of
        the last batch that touched their list."""
        last = self._table("touched", _TOUCHED)
        if touched is not None:
            last = last.join(touched, ["policy_id", "list"], "left_semi")
        last = last.groupBy("policy_id", "list").agg(F.max("batch").alias("batch"))
        return self._table("entries", _ENTRIES).where("valid_to is null").join(last, ["policy_id", "list", "batch"])

    def add(self, changes: DataFrame, entries: DataFrame) -> DataFrame:
        """Merges one batch (the tables of ``policy``); returns its changes with
        ``accepted``, ``version`` and ``current``."""
        changes = materialize(changes, "batch-changes")
        named = changes.where("list is not null").select("policy_id", "list").union(
            changes.where("action = 'replace'").select("policy_id", F.explode("lists").alias("list"))).distinct()
        touched = materialize(named, "batch-lists")
        live = currents = None
        if self.batches:
            live = materialize(self._live(touched).drop("batch", "valid_to"), "batch-live")
            currents = self.currents().join(changes.select("policy_id").distinct(), "policy_id", "left_semi")
        events, accepted, _ = P.written_history(changes, entries, live, currents)
        self._write("entries", P.intervals_of(events, accepted))
        self._write("touched", touched)
        self._write("current", accepted.groupBy("policy_id").agg(F.max("current").alias("current")))
        self.batches += 1
        return accepted

    def intervals(self) -> DataFrame:
        """All entries as validity intervals, as one replay would give them."""
        closed = self._table("entries", _ENTRIES).where("valid_to is not null").drop("batch")
        return closed.unionByName(self._live().drop("batch")).select("policy_id", "list", "entry_id", "value", "valid_from", "valid_to")
