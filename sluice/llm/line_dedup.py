"""Operator 10: line dedup over levelled sorted runs (DataFrame functions only).

``LineRuns`` keeps the hashes of all lines seen so far as runs: Parquet
tables below one folder, each sorted by hash, no hash in two of them.  A new
batch of lines is reduced to one row per hash, merge-anti-joined with every
run, and what is left is written as a new run of level 0.  When a level
holds ``FANOUT`` runs they are compacted into one run of the next level, so a
hash is rewritten once per level and a batch meets few runs.

``drop_lines`` deals the documents into ``BATCHES`` batches by ascending
doc_id and feeds them in that order.  A line goes when its hash is in an
older run, or in its own batch with a smaller doc_id, which leaves each line
in the smallest doc_id that holds it.  Lines travel as 16-byte hashes; the
text moves once, to be joined with the dropped positions.

Defined cases: null or empty text is one empty line, which is too short to
drop; rows that repeat a doc_id are one document for the count of holders,
and each of them is cleaned by itself; a null doc_id comes after all others;
an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import BLANKS, ascii_lower, id_key, materialize

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class LineRuns:
    """Levelled sorted runs of ``(h binary, first bigint)`` below ``root``."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT):
        self.spark, self.root, self.fanout = spark, root, fanout
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame, level: int) -> str:
        path = f"{self.root}/level{level}-{uuid.uuid4().hex[:10]}"
        rows.repartition("h").sortWithinPartitions("h").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        return path

    def _read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema("h binary, first bigint").parquet(*paths)

    def runs(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """``lines``: (h, id).  Adds a run with the hashes no run has, each
        with its smallest id, and returns that run."""
        fresh = lines.groupBy("h").agg(F.min("id").alias("first"))
        for path in self.runs():
            fresh = fresh.join(self._read(path).select("h").hint("merge"), "h", "left_anti")
        return self._read(self._write(fresh, 0))

    def compact(self) -> None:
        """Merge the runs of each full level into one of the next."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                full, self.levels[level] = self.levels[level], []
                self._write(self._read(*full), level + 1)
            level += 1


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """``(_id, _t, pos)`` of the lines to drop; ``_id`` and ``_t`` are
    ``id_key(doc_id)`` and ``xxhash64(text)``."""
    spark = docs.sparkSession
    rows = docs.select(id_key(F.col("doc_id")).alias("_id"), F.xxhash64("text").alias("_t"), lines_of(F.col("text")).alias("_l"))
    cuts = rows.agg(F.percentile_approx("_id", [i / batches for i in range(1, batches)], 10_000).alias("c")).first().c or []
    batch = F.lit(0)
    for c in sorted(set(cuts)):
        batch = batch + (F.col("_id") > c).cast("int")
    lines = rows.select("_id", "_t", F.posexplode("_l").alias("pos", "_line")).withColumn("_key", line_key(F.col("_line")))
    lines = lines.where(F.char_length("_key") >= min_chars).select(
        "_id", "_t", "pos", F.unhex(F.md5("_key")).alias("h"), batch.alias("batch"))
    lines = materialize(lines, "line-hashes", ("batch",))
    runs = LineRuns(spark, scratch_path(spark, "line-runs"))
    parts = []
    for b in range(len(set(cuts)) + 1):
        part = lines.where(F.col("batch") == b)
        own = runs.add(part.select("h", F.col("_id").alias("id")))
        parts.append(part.join(own, "h", "left").where(F.col("first").isNull() | (F.col("_id") > F.col("first"))).select("_id", "_t", "pos"))
        if b < len(set(cuts)):
            runs.compact()
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _kept(lines: Column, dropped: Column) -> Column:
    """``lines`` without the positions in the sorted array ``dropped``: the
    stretches between them, in one pass."""
    n = F.size(dropped)
    start = lambda i: F.when(i == 0, F.lit(1)).otherwise(F.get(dropped, i - 1) + 2)
    stop = lambda i: F.when(i == n, F.size(lines)).otherwise(F.get(dropped, i))
    return F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(lines, start(i), stop(i) - start(i) + 1)))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """One row per row of ``docs``: ``row`` (struct of its own columns),
    ``n_lines``, ``n_dropped`` and ``kept`` (the text without its dropped
    lines)."""
    gone = dropped_lines(docs, min_chars, batches).groupBy("_id", "_t").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        id_key(F.col("doc_id")).alias("_id"), F.xxhash64("text").alias("_t"),
    ).join(gone, ["_id", "_t"], "left")
    text = F.coalesce("row.text", F.lit(""))
    rows = rows.withColumn("_l", F.when(F.col("gone").isNotNull(), lines_of(text)))
    return rows.select(
        "row",
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("gone").isNull(), text).otherwise(F.array_join(_kept(F.col("_l"), F.col("gone")), "\n")).alias("kept"),
    )


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """``docs`` with its own columns, the text replaced by what line dedup
    keeps (and ``n_chars`` by its length, if there).  Documents of which no
    character is left are dropped; those that had no text before stay."""
    out = drop_lines(docs, min_chars, batches).where((F.col("n_dropped") == 0) | (F.btrim("kept", F.lit(BLANKS)) != ""))
    new = F.when(F.col("n_dropped") == 0, F.col("row.text")).otherwise(F.col("kept"))
    cols = {"text": new, "n_chars": F.char_length(new).cast("bigint")}
    kinds = dict(docs.dtypes)
    return out.select(*(cols[c].cast(kinds[c]).alias(c) if c in cols else F.col(f"row.`{c}`") for c in docs.columns))
