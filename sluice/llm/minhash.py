"""Operator 3: near-duplicate classes by MinHash with tensored banding.

A document's set is its distinct word shingles, as 64-bit hashes; documents
with the same set are one node from the start.  Each node has HALVES small
hashes of each of two collections, and every small hash is made of ROWS
minhashes.  A table key is a pair, one small hash of each collection, so
2 x HALVES x ROWS minhashes make HALVES^2 keys of 2 x ROWS minhashes.  Small
hashes that no other node has can't be part of a shared key and are left out
before the pairs are formed.

Keys only name candidates; every link is confirmed on the full sets.  Which
pairs of a key's bucket are looked at, without ever listing all pairs:

1. Turns of stars: in each bucket whose members aren't all in one component,
   one member is compared with all others.  Of a bucket's members that is the
   most central one that hasn't led before: the one that meets the most nodes
   over all its buckets.  In a group of copies of one text, that text and its
   closest copies lead everywhere, and what links with them is done.
2. The rest, between nodes of different components that still share a bucket.
   Shingles that at most RARE of these nodes have are rare.  Of the shingles
   of a set, ordered by how many of these nodes have them, the first
   n - s n + 1 (s being the threshold) must hold one that any linked set has
   among its own first; so where these are all rare, joining on the rare ones
   among them finds every link, in at most RARE rows a shingle.  Nodes with
   fewer rare shingles, r, can link without sharing one only with sets of at
   most (n - r) / s - r shingles; pairs of such nodes that both sides' bounds
   allow are compared where they share a bucket, each pair in the first
   bucket that it shares only.  A node stays in a bucket only if its bound
   allows the smallest set there that allows its own size, and of a bucket's
   main label no two nodes are paired: the members of a group of near copies
   that are one component already meet the few others, not each other.

Step 2 leaves out only pairs that can't link, so what remains of chance is
the banding: HALVES is the least with which a pair exactly at the threshold
shares no key with probability MISS at most (one link; a component mostly has
several), more similar pairs less.  In step 1, before sets are compared, pairs with fewer
than AGREE equal minhashes are dropped, which a pair at the threshold suffers
with probability DROP at most.  ``banding`` gives both for a threshold: 8 and
30 at 0.85, 11 and 39 at 0.80.

Defined cases: null or blank text has an empty set and links with nothing;
fewer words than a shingle make one shingle of them all; a null doc_id comes
after all others; rows that repeat a doc_id are documents of their own,
linked by their sets only; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, id_key, materialize, map_texts
from .graph import components
from .words import WordHashes, blank_words, ngram_hashes

SHINGLE, PERCENT = 3, 85
ROWS, MISS, DROP = 3, 0.001, 5e-5
TURNS = 2
#: Nodes that a rare shingle has at most.
RARE = 16
_BITS = 25  # of each minhash that is kept, below its number
#: Parity bits of a set.
BITS = 1024
_WORDS = WordHashes()


@lru_cache
def banding(percent: int) -> tuple[int, int]:
    """(HALVES, AGREE) of a threshold."""
    s, halves = percent / 100, 1
    while 1 - (1 - (1 - s**ROWS) ** halves) ** 2 > MISS:
        halves += 1
    n, agree, below = 2 * halves * ROWS, 0, 0.0
    while agree < n and (below := below + comb(n, agree) * s**agree * (1 - s) ** (n - agree)) <= DROP:
        agree += 1
    if n > 1 << (32 - _BITS):
        raise ValueError(f"a threshold of {percent} % needs {n} minhashes")
    return halves, agree


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = blank_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    return np.unique(ngram_hashes(_WORDS.of(words), size))


@lru_cache
def _factors(minhashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(3))
    xor = rng.integers(0, 2**63, minhashes, dtype=np.uint64)[:, None]
    return xor, (rng.integers(0, 2**63, minhashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]


def signature(shingles: np.ndarray, minhashes: int, chunk: int = 2048) -> np.ndarray:
    """``minhashes`` numbers: the minhash's place and its upper bits."""
    xor, odd = _factors(minhashes)
    low = np.full(minhashes, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), chunk):
            low = np.minimum(low, ((shingles[i : i + chunk][None, :] ^ xor) * odd).min(1))
    return ((np.arange(minhashes, dtype=np.int64) << _BITS) | (low >> np.uint64(64 - _BITS)).astype(np.int64)).astype(np.int32)


def parity(shingles: np.ndarray) -> np.ndarray:
    """The set's parity bits: of the shingles of each place, whether they are odd in number."""
    odd = np.bincount((shingles % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_link(bits: tuple[str, str], n: tuple[str, str], percent: int) -> str:
    """SQL: whether sets of these bits and sizes can link; false only if they don't."""
    # written out: a higher-order function would run some fifty times as long
    apart = " + ".join(f"bit_count(get({bits[0]}, {i}) ^ get({bits[1]}, {i}))" for i in range(BITS // 64))
    return f"{100 + percent} * ({apart}) <= {100 - percent} * ({n[0]} + {n[1]})"


def sketches(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``id`` (null as LAST_ID), ``t`` (hash of the
    text), ``n``, ``node`` (hash of the set, null if empty), ``sig``, ``bits``."""
    minhashes = 2 * banding(percent)[0] * ROWS

    def batches(parts):
        for part in parts:
            n, node, sig, bits = [], [], [], []
            for t in part.column("text"):
                s = shingle_set(t.as_py(), size)
                n.append(len(s))
                node.append(xxhash.xxh64_intdigest(s.tobytes()) - 2**63 if len(s) else None)
                sig.append(signature(s, minhashes) if len(s) else None)
                bits.append(parity(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("t"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.list_(pa.int32())),
                 pa.array(bits, pa.list_(pa.int64()))],
                ["id", "t", "n", "node", "sig", "bits"])

    df = docs.select(id_key(F.col("doc_id")).alias("id"), F.xxhash64("text").alias("t"), "text")
    return map_texts(df, batches, "id bigint, t bigint, n bigint, node bigint, sig array<int>, bits array<bigint>")


def _small_hashes(first: int, halves: int) -> Column:
    """The ``halves`` small hashes of the collection that starts at a minhash."""
    part = lambda i: [F.get("sig", F.lit(first + i * ROWS + r)) for r in range(ROWS)]
    return F.array(*(F.xxhash64(*part(i)) for i in range(halves)))


def _shared(rows: DataFrame, by: str) -> DataFrame:
    """The rows (by, node) whose ``by`` another node has too."""
    both = rows.groupBy(by).agg(F.min("node").alias("_a"), F.max("node").alias("_b")).where("_a <> _b").select(by)
    return rows.join(both, by)


def buckets(nodes: DataFrame, halves: int) -> DataFrame:
    """(key, node): table keys that two nodes or more have."""
    rows = nodes.select("node", F.posexplode(F.concat(_small_hashes(0, halves), _small_hashes(halves * ROWS, halves))).alias("at", "h"))
    rows = _shared(rows, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("at", "h"))).alias("s"))
    left, right = F.filter("s", lambda x: x["at"] < halves), F.filter("s", lambda x: x["at"] >= halves)
    keys = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.xxhash64(a.h, b.h))))
    return materialize(_shared(materialize(rows.select("node", F.explode(keys).alias("key")), "lsh-keys"), "key"), "lsh-buckets")


class Verifier:
    """Confirms candidate pairs on full sets, each pair at most once a call."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, percent: int):
        self.nodes, self.sets, self.percent = nodes.select("node", "n", "sig", "bits"), sets, percent
        self.agree = banding(percent)[1]

    def links(self, pairs: DataFrame) -> DataFrame:
        """``pairs``: (x, y) of nodes -> those that link, written out."""
        p = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        for side in ("x", "y"):
            p = p.join(self.nodes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("sig").alias(f"s{side}"),
                                         F.col("bits").alias(f"b{side}")), side)
        fits = F.lit(self.percent) * F.greatest("nx", "ny") <= 100 * F.least("nx", "ny")
        fits = fits & F.expr(may_link(("bx", "by"), ("nx", "ny"), self.percent))
        return self.confirmed(materialize(p.where(fits & (F.size(F.array_intersect("sx", "sy")) >= self.agree)).select("x", "y", "nx", "ny"), "pairs"))

    def confirmed(self, p: DataFrame) -> DataFrame:
        """``p``: (x, y, nx, ny), each pair once -> those that link, written out."""
        for side in ("x", "y"):
            p = p.join(self.sets.select(F.col("node").alias(side), F.col("set").alias(f"set{side}")), side)
        both = F.size(F.array_intersect("setx", "sety"))
        return materialize(p.where(100 * both >= self.percent * (F.col("nx") + F.col("ny") - both)).select("x", "y"), "links")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, set) of the wanted nodes; ``wanted``: (id, t, node) names a row
    of each."""

    def batches(parts):
        for part in parts:
            sets = [shingle_set(t.as_py(), size).view(np.int64) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    rows = docs.select(id_key(F.col("doc_id")).alias("id"), F.xxhash64("text").alias("t"), "text").join(wanted, ["id", "t"])
    return materialize(map_texts(rows.select("node", "text"), batches, "node bigint, set array<bigint>"), "sets").dropDuplicates(["node"])


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _open(rows: DataFrame) -> DataFrame:
    """The rows (key, node, label) of buckets with more than one label."""
    keys = rows.groupBy("key").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a <> _b").select("key")
    return rows.join(keys, "key")


def _stars(rows: DataFrame, led: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(x, y): each open bucket's lead of this turn with its other members; and
    the leads so far (key, x), by which a bucket has another lead each turn."""
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_c"))
    weight = rows.join(size, "key").groupBy("node").agg(F.sum("_c").alias("_w"))
    some = rows.join(weight, "node")
    if led is not None:
        some = some.join(led.withColumnRenamed("x", "node"), ["key", "node"], "left_anti")
    first = F.struct("_w", "node")
    lead = some.groupBy("key").agg(F.max_by("node", first).alias("x"), F.max_by("label", first).alias("_l"))
    lead = materialize(lead, "leads")
    now = lead.select("key", "x")
    return rows.join(lead, "key").where("label <> _l").select("x", F.col("node").alias("y")), now if led is None else led.union(now)


def _last_pairs(rows: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(x, y, nx, ny): the pairs of different labels that can still link (step
    2), with the sizes of their sets."""
    some = rows.select("node", "label").distinct()
    shingles = sets.join(some.select("node"), "node").select("node", F.explode("set").alias("s"))
    rare = shingles.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") <= RARE)
    first = shingles.join(rare, "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("rare"))
    facts = some.join(nodes.select("node", "n", "bits"), "node").join(first, "node", "left")
    facts = facts.withColumn("r", F.coalesce(F.size("rare"), F.lit(0)).cast("bigint"))
    facts = facts.withColumn("p", F.floor((100 - percent) * F.col("n") / 100) + 1)
    # what 100 (n - r) >= percent (m + r) allows for the other set's size m
    facts = facts.withColumn("most", F.floor((100 * (F.col("n") - F.col("r"))) / percent) - F.col("r"))
    facts = materialize(facts.withColumn("first", F.slice("rare", F.lit(1), F.col("p").cast("int"))).drop("rare"), "facts")

    fits = f"{percent} * greatest(a.n, b.n) <= 100 * least(a.n, b.n) and a.label <> b.label and {may_link(('a.bits', 'b.bits'), ('a.n', 'b.n'), percent)}"
    # nodes of each rare shingle, RARE at most; many shingles have the same, which count once
    held = facts.select(F.explode("first").alias("e"), F.struct("node", "label", "n", "bits").alias("f")).where("e.c > 1")
    held = held.groupBy("e.s").agg(F.sort_array(F.collect_list("f")).alias("l")).where(F.size("l") > 1).select("l").distinct()
    shared = held.select(F.explode(F.expr(
        f"flatten(transform(l, (a, i) -> transform(filter(slice(l, i + 2, size(l)), b -> {fits}), b -> struct(a.node as x, b.node as y, a.n as nx, b.n as ny))))")).alias("p"))
    common = rows.join(facts.where(f"r < p and 100 * most >= {percent} * n").select("node", "n", "most", "bits"), "node")
    # the smaller set of a pair allows its own size, the larger one that of the smaller
    least = common.where("most >= n").groupBy("key").agg(F.min("n").alias("_n"))
    common = _open(common.join(least, "key").where("most >= _n").drop("_n"))
    # a node has HALVES^2 keys at most; a pair is named in the first key it shares, not in each
    keys = common.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    common = materialize(common.join(keys, "node"), "common")
    # of each pair at least one node isn't of its bucket's main label
    main = common.groupBy("key", "label").agg(F.count(F.lit(1)).alias("_c")).groupBy("key").agg(F.max_by("label", F.struct("_c", "label")).alias("main"))
    few = materialize(common.join(main, "key").where("label <> main"), "few")
    a = few.select("key", "main", F.struct("node", "label", "n", "most", "keys", "bits").alias("a"))
    b = common.select("key", F.struct("node", "label", "n", "most", "keys", "bits").alias("b"))
    allowed = a.join(b, "key").where(f"(b.label = main or a.node < b.node) and {fits} and b.n <= a.most and a.n <= b.most and key = array_min(array_intersect(a.keys, b.keys))")
    allowed = allowed.select(F.least(F.struct("a.node", "a.n"), F.struct("b.node", "b.n")).alias("x"), F.greatest(F.struct("a.node", "a.n"), F.struct("b.node", "b.n")).alias("y"))
    return shared.select("p.*").union(allowed.select("x.node", "y.node", "x.n", "y.n")).distinct()


def classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, turns: int = TURNS) -> tuple[DataFrame, DataFrame]:
    """(rows, members): ``rows`` as of ``sketches``, written out, and (node,
    label) of every node that links with another."""
    rows = materialize(sketches(docs, size, percent), "sketches")
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.min(F.struct("id", "t", "n", "sig", "bits")).alias("r")).select("node", "r.id", "r.t", "r.n", "r.sig", "r.bits")
    nodes = materialize(nodes, "nodes")
    found = buckets(nodes, banding(percent)[0])
    sets = _sets(docs, nodes.select("id", "t", "node").join(found.select("node").distinct(), "node"), size)
    verify = Verifier(nodes, sets, percent)
    labels = links = led = before = None
    for turn in range(turns + 1):
        rest = materialize(_open(_labelled(found, labels)), "open")
        left = rest.count()
        if not left:
            break
        # a turn that closed less than half leaves the rest to the last step
        last = turn == turns or (before is not None and 2 * left > before)
        before = left
        if not last:
            pairs, led = _stars(rest, led)
            new = verify.links(pairs)
        else:
            new = verify.confirmed(materialize(_last_pairs(rest, sets, nodes, percent), "last-pairs"))
        links = new if links is None else links.union(new)
        labels = components(links)
        if last:
            break
    return rows, labels


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, turns: int = TURNS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``id, t`` (its keys),
    ``n_shingles``, ``component`` (smallest id reachable; LAST_ID for none)
    and ``kept``."""
    rows, labels = classes(docs, size, percent, turns)
    r = _labelled(rows.drop("sig", "bits"), labels)
    least = r.where("node is not null").groupBy("label").agg(F.min("id").alias("_c"))
    r = r.join(least, "label", "left").withColumn("component", F.coalesce("_c", "id"))
    return r.select("id", "t", F.col("n").alias("n_shingles"), "component", (F.col("id") == F.col("component")).alias("kept"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, turns: int = TURNS) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each class, and one of
    rows that repeat a doc_id and its text."""
    stay = near_duplicates(docs, size, percent, turns).where("kept").select(F.col("id").alias("_id"), F.col("t").alias("_t")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), id_key(F.col("doc_id")).alias("_id"), F.xxhash64("text").alias("_t"))
    return rows.join(stay, ["_id", "_t"], "left_semi").dropDuplicates(["_id", "_t"]).select("row.*")


def original_id(c: Column) -> Column:
    return F.when(c != LAST_ID, c)
