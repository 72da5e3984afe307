"""Operator 13: hard negatives from Hilbert-ordered blocks with zone maps.

The rows are laid along a Hilbert curve over the HILBERT_DIMS dimensions of
largest variance and written as Parquet blocks of BLOCK rows, one block a
Parquet row: ids, labels, components, and the block's zone map, that is the
minimum and maximum of every dimension and the labels that occur.

An anchor asks for the best k rows of each of its windows, a window being an
interval of scores and a side (rows of the same label, or of others).  Interval
arithmetic over a zone map bounds the inner products of an anchor with all rows
of a block: each dimension gives the smaller and the larger of anchor x minimum
and anchor x maximum.  A block is read for a window only if its bounds meet the
window and its upper bound reaches the window's k-th best score so far.

1. The anchors of a range of the curve first read that range's own blocks, which
   gives every window a k-th best score (or none yet).
2. Only zone maps then meet the anchors of other ranges; the pairs (range of
   anchors, block) that some window needs are written.
3. Those blocks' vectors are fetched by an equi-join on the block and scored; a
   ranked window merges the lists.

The same search runs twice: for the positives (one unbounded window, the same
label), then for the negatives (one window a positive, other labels).  Groups
are a range's anchors with one range's blocks, both of bounded size: equal
vectors spread over blocks by id, since ranges are cut by (key, id).

Defined cases: rows with a null label or id, a null vector or null or non-finite
components take no part, nor do vectors of another length than the commonest; of
rows that repeat an id the smallest (label, vector) counts; ties go to the
smaller id; a positive of negative score has an empty window; an anchor without
positives gives no row; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hilbert
from .common import materialize
from .vectors import common_length, integers, usable

EVERY, POSITIVES, NEGATIVES = 100, 5, 10
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 30, 90
HILBERT_DIMS, BITS = 16, 4
#: Rows of a block, about so many of a range of the curve, anchors scored at a
#: time, and zone maps of a group.
BLOCK, RANGE, SLICE, ZONES = 1024, 131072, 512, 4096
ANY = 1 << 62
FOUND = "anchor bigint, w int, id bigint, score bigint"


def _moments(rows: DataFrame, dim: int):
    """Per dimension (minimum, maximum, variance): dim rows to the driver."""

    def each(parts):
        n, low, high, s, q = 0, np.full(dim, ANY), np.full(dim, -ANY), np.zeros(dim), np.zeros(dim)
        for part in parts:
            if part.num_rows:
                x = integers(part.column("v"), dim)
                n += len(x)
                low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
                s, q = s + x.sum(0), q + (x.astype(np.float64) ** 2).sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"d": np.arange(dim), "n": np.full(dim, n), "low": low, "high": high, "s": s, "q": q})

    got = rows.select("v").mapInArrow(each, "d bigint, n bigint, low bigint, high bigint, s double, q double").groupBy("d").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("d").collect()
    n, low, high, s, q = (np.array([r[c] for r in got], np.float64) for c in ("n", "low", "high", "s", "q"))
    return low, high, q / n - (s / n) ** 2


def write_blocks(rows: DataFrame, dim: int) -> DataFrame:
    """``rows``: id, label, v.  The block table: ``range, block, ids, labels, x``
    and the zone map ``low, high, kinds``."""
    spark = rows.sparkSession
    low, high, var = _moments(rows, dim)
    dims = np.sort(np.argsort(-var, kind="stable")[:HILBERT_DIMS])
    scale = (1 << BITS) / np.maximum(high[dims] - low[dims] + 1, 1)

    def keyed(parts):
        for part in parts:
            x = integers(part.column("v"), dim)
            cells = np.floor((x[:, dims] - low[dims]) * scale).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(x.tolist(), pa.list_(pa.int32())), pa.array(hilbert.keys(cells, BITS), pa.binary())],
                                             ["id", "label", "x", "key"])

    def packed(parts):
        from pyspark import TaskContext

        at, seq, held = TaskContext.get().partitionId(), 0, []

        def write(rows):
            t = pa.Table.from_batches(rows).combine_chunks()
            flat = t.column("x").combine_chunks().flatten().to_numpy()
            x = flat.reshape(t.num_rows, dim)
            labels = t.column("label").to_pylist()
            cells = [at, (at << 32) | seq, t.column("id").to_pylist(), labels, flat, x.min(0), x.max(0), sorted(set(labels))]
            return pa.RecordBatch.from_arrays([pa.array([c], f) for c, f in zip(cells, (
                pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())))],
                ["range", "block", "ids", "labels", "x", "low", "high", "kinds"])

        n = 0
        for part in parts:
            while part.num_rows:
                take = part.slice(0, BLOCK - n)
                part = part.slice(take.num_rows)
                held.append(take)
                n += take.num_rows
                if n == BLOCK:
                    yield write(held)
                    held, n, seq = [], 0, seq + 1
        if n:
            yield write(held)

    n = rows.count()
    ranges = max(n // RANGE, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // (4 * BLOCK))) + 1
    ordered = rows.mapInArrow(keyed, "id bigint, label string, x array<int>, key binary").repartitionByRange(ranges, "key", "id").sortWithinPartitions("key", "id")
    table = ordered.select("id", "label", "x").mapInArrow(
        packed, "range bigint, block bigint, ids array<bigint>, labels array<string>, x array<int>, low array<int>, high array<int>, kinds array<string>")
    return materialize(table, "negative-blocks")


def anchor_rows(blocks: DataFrame, every: int) -> DataFrame:
    """``range, id, label, x`` of the rows whose id is divisible by ``every``."""
    dim = F.size("low")
    row = F.posexplode("ids").alias("i", "id")
    some = blocks.where(F.exists("ids", lambda i: i % every == 0)).select("range", "labels", "x", dim.alias("dim"), row).where(F.col("id") % every == 0)
    return some.select("range", "id", F.get("labels", F.col("i")).alias("label"), F.slice("x", F.col("i") * F.col("dim") + 1, F.col("dim")).alias("x"))


class _Anchors:
    """A group's anchors: components, labels and windows, one row a window."""

    def __init__(self, t: pa.Table, names: dict):
        self.ids = t.column("id").to_numpy()
        n = t.num_rows
        self.x = np.concatenate([c.flatten().to_numpy() for c in t.column("x").chunks]).reshape(n, -1).astype(np.float64)
        self.label = np.array([names.setdefault(v, len(names)) for v in t.column("label").to_pylist()], np.int64)
        wins = t.column("windows").to_pylist()
        self.of = np.repeat(np.arange(n), [len(w) for w in wins])
        flat = [w for ws in wins for w in ws]
        self.w, self.low, self.high, self.at = (np.array([w[c] for w in flat], np.int64) for c in ("w", "low", "high", "at"))

    def slices(self):
        """(anchors, windows) of at most SLICE anchors at a time."""
        for lo in range(0, len(self.ids), SLICE):
            a, b = np.searchsorted(self.of, (lo, lo + SLICE))
            if b > a:
                yield slice(lo, lo + SLICE), slice(a, b)


def bounds(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each anchor with any point of each box."""
    up, down = np.maximum(x, 0), np.minimum(x, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def needed(a: _Anchors, rows: slice, wins: slice, low, high, has, several, same: bool) -> np.ndarray:
    """(windows, blocks): whether a window of the slice needs a block; ``has`` is
    (labels, blocks), ``several`` whether a block holds more than one label."""
    least, most = bounds(a.x[rows], low, high)
    of = a.of[wins] - rows.start
    mine = has[a.label[rows]]
    kind = mine if same else several | ~mine
    floor = np.maximum(a.low[wins], a.at[wins])[:, None]
    return kind[of] & (most[of] >= floor) & (least[of] <= a.high[wins][:, None]) & (a.low[wins] <= a.high[wins])[:, None]


def label_table(kinds: list, names: dict) -> tuple[np.ndarray, np.ndarray]:
    for k in kinds:
        for v in k:
            names.setdefault(v, len(names))
    has = np.zeros((len(names), len(kinds)), bool)
    for j, k in enumerate(kinds):
        has[[names[v] for v in k], j] = True
    return has, np.array([len(k) > 1 for k in kinds], bool)


def _boxes(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([c.flatten().to_numpy() for c in t.column(n).chunks]).reshape(t.num_rows, -1).astype(np.float64) for n in ("low", "high"))


def best_of(anchor, w, ids, score, k: int) -> np.ndarray:
    """Places of the first k of each (anchor, window), by score and id."""
    order = np.lexsort((ids, -score, w, anchor))
    a, b = anchor[order], w[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(order) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - first < k]


def score_blocks(anchors: pa.Table, blocks: pa.Table, k: int, same: bool) -> pa.Table:
    """The best k rows of the blocks for each window of the anchors."""
    names: dict = {}
    out = [np.zeros((4, 0), np.int64)]
    if anchors.num_rows and blocks.num_rows:
        a = _Anchors(anchors, names)
        has, several = label_table(blocks.column("kinds").to_pylist(), names)
        low, high = _boxes(blocks)
        for rows, wins in a.slices():
            found = np.zeros((4, 0), np.int64)  # anchor, window, id, score
            at = np.maximum(a.low[wins], a.at[wins])
            want = needed(a, rows, wins, low, high, has, several, same)
            _, most = bounds(a.x[rows], low, high)
            of = a.of[wins] - rows.start
            for j in np.argsort(-most.max(0), kind="stable"):
                use = np.flatnonzero(want[:, j] & (most[of, j] >= at))
                if not len(use):
                    continue
                ids = blocks.column("ids")[j].values.to_numpy()
                x = blocks.column("x")[j].values.to_numpy().reshape(len(ids), -1).astype(np.float64)
                kinds = np.array([names[v] for v in blocks.column("labels")[j].as_py()], np.int64)
                some, place = np.unique(of[use], return_inverse=True)
                score = (a.x[rows][some] @ x.T).astype(np.int64)
                fits = (a.label[rows][some][:, None] == kinds) == same
                fits &= a.ids[rows][some][:, None] != ids
                s = score[place]
                ok = fits[place] & (s >= at[use][:, None]) & (s <= a.high[wins][use][:, None])
                if len(ids) > k:  # below the block's own k-th best of a window nothing counts
                    masked = np.where(ok, s, -ANY)
                    ok &= masked >= np.partition(masked, len(ids) - k, axis=1)[:, [len(ids) - k]]
                p, c = np.nonzero(ok)
                found = np.concatenate((found, np.stack((use[p], np.zeros(len(p), np.int64), ids[c], s[p, c]))), axis=1)
                found = found[:, best_of(*found, k)]
                full = np.bincount(found[0], minlength=len(at)) == k
                worst = np.full(len(at), ANY)
                np.minimum.at(worst, found[0], found[3])
                at = np.where(full, np.maximum(at, worst), at)
            where = found[0] + wins.start
            out.append(np.stack((a.ids[a.of[where]], a.w[where], found[2], found[3])))
    anchor, w, ids, score = np.concatenate(out, axis=1)
    return pa.table({"anchor": anchor, "w": w.astype(np.int32), "id": ids, "score": score})


def needed_blocks(anchors: DataFrame, blocks: DataFrame, same: bool) -> DataFrame:
    """(range, from, block) of the blocks of other ranges that a range's anchors
    need, from the zone maps alone."""
    n = blocks.count()
    groups = -(-n // ZONES)
    top = blocks.agg(F.max("range")).first()[0]
    ranges = F.explode(F.sequence(F.lit(0), F.lit(top)).cast("array<bigint>")).alias("range")
    zones = blocks.select(F.col("range").alias("from"), "block", "low", "high", "kinds", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g"))
    zones = zones.select("*", ranges).where("range <> from")
    asked = anchors.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")))

    def need(left: pa.Table, right: pa.Table) -> pa.Table:
        names: dict = {}
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("range", "from", "block")})
        a = _Anchors(left, names)
        has, several = label_table(right.column("kinds").to_pylist(), names)
        low, high = _boxes(right)
        some = np.zeros(right.num_rows, bool)
        for rows, wins in a.slices():
            some |= needed(a, rows, wins, low, high, has, several, same).any(0)
        return right.select(["range", "from", "block"]).filter(pa.array(some))

    got = asked.groupBy("range", "g").cogroup(zones.groupBy("range", "g")).applyInArrow(need, "range bigint, from bigint, block bigint")
    return materialize(got, "negative-needs")


def search(blocks: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """``anchors``: range, id, label, x, windows (w, low, high, at).  Returns
    ``anchor, w, id, score, rank`` of the best k of each window."""
    run = lambda left, right: score_blocks(left, right, k, same)
    columns = ["ids", "labels", "x", "low", "high", "kinds"]
    near = anchors.groupBy("range").cogroup(blocks.select("range", *columns).groupBy("range")).applyInArrow(run, FOUND)
    near = materialize(near, "negatives-near")
    worst = near.groupBy("anchor", "w").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("worst")).where("worst is not null")
    worst = worst.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "worst"))).alias("m"))
    raised = F.transform("windows", lambda w: F.struct(w.w.alias("w"), w.low.alias("low"), w.high.alias("high"), F.coalesce(F.col("m")[w.w], w["at"]).alias("at")))
    asked = materialize(anchors.join(worst.withColumnRenamed("anchor", "id"), "id", "left").select("range", "id", "label", "x", raised.alias("windows")), "negative-anchors")
    needs = needed_blocks(asked, blocks, same)
    fetched = needs.join(blocks.select("block", *columns), "block")
    there = asked.join(needs.select("range", F.col("from").alias("source")).distinct(), "range")
    far = there.groupBy("range", "source").cogroup(fetched.groupBy("range", "from")).applyInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id"))
    return near.unionByName(far).withColumn("rank", rank).where(F.col("rank") <= k)


def mine(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``rows``: id, label, v.  Returns ``anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score``."""
    spark = rows.sparkSession
    some = rows.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("string").alias("label"), F.col("v").cast("array<double>").alias("v"))
    some = some.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    one = some.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*")
    one = materialize(one, "negative-rows")
    dim = common_length(one, "v")
    if not dim:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    blocks = write_blocks(one.where(F.size("v") == dim), dim)
    window = lambda w, low, high: F.struct(w.cast("int").alias("w"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"), F.lit(-ANY).cast("bigint").alias("at"))
    anchors = materialize(anchor_rows(blocks, every), "negative-anchors")
    asked = anchors.withColumn("windows", F.array(window(F.lit(0), F.lit(-ANY), F.lit(ANY))))
    found = materialize(search(blocks, asked, positives, True).select("anchor", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    part = lambda percent: F.col("positive_score").cast("decimal(20,0)") * percent / 100
    wins = found.groupBy(F.col("anchor").alias("id")).agg(F.sort_array(F.collect_list(window(F.col("w"), F.ceil(part(LOW)), F.floor(part(HIGH))))).alias("windows"))
    best = search(blocks, anchors.join(wins, "id"), negatives, False)
    return best.join(found, ["anchor", "w"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
