"""Operator 6: exact substring dedup over sorted suffixes.

Every byte that lies in a WINDOW-byte string which also starts elsewhere is
removed.  Sorting a suffix for each byte is not needed for that.  Each window
has an anchor, the place in it whose GRAM-byte string has the smallest hash
(the first, in a tie); equal windows have their anchors at the same place.
So a repeated window shows as two anchors p and q with the same gram, with L
equal bytes before them and R equal bytes from them on, L + R >= WINDOW, and
then all of [p - L, p + R) is covered.  About one place in 150 is an anchor.

1. One pass finds the anchors; their gram hashes are counted, and only
   anchors whose gram occurs twice go on.
2. Each task sorts the suffixes at its anchors (with the bytes before the
   anchor, backwards, after them), merges equal ones and front-codes the run:
   length of the common prefix with the entry before, and the rest.
3. Runs are exchanged by ranges of the gram hash, which are even whatever the
   text and keep a gram's suffixes together, and merged by a loser tree that
   knows each entry's common prefix with the last output: longer wins, and
   only at equal length are bytes compared, from that length on.
4. The merge's common-prefix lengths give R between neighbours; with the
   sorted left sides they give the longest L and R of each suffix.
5. Covered stretches are cut out of the texts that have any.

A gram with more than HOT occurrences doesn't go to one task: its windows are
hashed (128 bits) and counted instead, a row per window, dealt by that hash.

Defined cases: null text is empty; texts shorter than the window have nothing
to remove; rows that repeat a doc_id are texts of their own (if also the text
repeats, they are copies of each other and go, if long enough); a null doc_id
is an id like others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_key, materialize, map_texts
from .words import mixed

WINDOW, GRAM = 400, 100
#: Bytes before an anchor that a window can reach.
LEFT = WINDOW - GRAM
#: Fills up what lies outside a text; no byte of UTF-8.
FILL = b"\xff"
#: Entries of a sorted run and (about) of a merged range; occurrences from
#: which a gram is hot; group size up to which pairs are compared one by one.
RUN, RANGE, HOT, SMALL = 8_000, 12_000, 20_000, 24
PIECE = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_OTHER = np.uint64(0x5851F42D4C957F2D)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_BYTE = np.random.Generator(np.random.PCG64(6)).integers(1, 2**63, 256, dtype=np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """64-bit hashes of all strings of ``size`` bytes, by prefix sums."""
    n = len(data)
    if _POWERS.get("up") is None or len(_POWERS["up"]) < n:
        _POWERS["up"], _POWERS["down"] = _powers(_BASE, max(n, 1 << 16)), _powers(_BACK, max(n, 1 << 16))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _POWERS["up"][:n], dtype=np.uint64)))
        return mixed((sums[size:] - sums[:-size]) * _POWERS["down"][: n - size + 1])


def anchors(text: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes) of the text's anchors, in order."""
    span = window - gram + 1
    places, hashes = [], []
    for at in range(0, max(0, len(text) - window + 1), PIECE):
        data = np.frombuffer(text, np.uint8, min(len(text) - at, PIECE + window - 1), at)
        h = gram_hashes(data, gram)
        keys = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(keys) // span) * span, 2**64 - 1, np.uint64)
        padded[: len(keys)] = keys
        blocks = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        n = len(keys) - span + 1
        low = np.minimum(back[:n], ahead[span - 1 : span - 1 + n])
        p = np.unique(low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        places.append(p + at)
        hashes.append(mixed(h[p] ^ _OTHER))  # anchors have small hashes; these are spread evenly
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, first = np.unique(np.concatenate(places), return_index=True)
    return p, np.concatenate(hashes)[first]


def entry(text: bytes, p: int, gram_hash: int) -> bytes:
    """Sort key of the suffix at an anchor: gram hash, the WINDOW bytes from it
    on, the LEFT bytes before it backwards."""
    right = text[p : p + WINDOW]
    left = text[max(0, p - LEFT) : p][::-1]
    return gram_hash.to_bytes(8, "big") + right.ljust(WINDOW, FILL) + left.ljust(LEFT, FILL)


def common(a: bytes, b: bytes, h: int = 0) -> int:
    """Length of the common prefix, the first ``h`` bytes being known equal."""
    differ = int.from_bytes(a[h:], "big") ^ int.from_bytes(b[h:], "big")
    return len(a) - (differ.bit_length() + 7) // 8


def front_code(keys: list[bytes]) -> tuple[list[int], list[bytes]]:
    lcps, tails, last = [], [], b""
    for k in keys:
        h = common(last, k) if last else 0
        lcps.append(h)
        tails.append(k[h:])
        last = k
    return lcps, tails


def unfold(lcps, tails) -> Iterator[tuple[bytes, int]]:
    """(entry, common prefix with the entry before) of a front-coded run."""
    last = b""
    for h, tail in zip(lcps, tails):
        last = last[:h] + tail
        yield last, h


def loser_tree(runs: list[Iterator]) -> Iterator[tuple[bytes, int, object]]:
    """Merges sorted runs of (entry, lcp, value), all entries of one length.
    Yields them in order, ``lcp`` being that with the entry before."""
    k = 1
    while k < len(runs):
        k *= 2
    key: list = [None] * k
    lcp, value = [0] * k, [None] * k
    runs = [iter(r) for r in runs] + [iter(())] * (k - len(runs))

    def pull(i):
        key[i], lcp[i], value[i] = next(runs[i], (None, 0, None))

    def beats(a, b):
        """Whether a's entry comes first; notes the loser's prefix with it."""
        if key[b] is None:
            return True
        if key[a] is None:
            return False
        if lcp[a] != lcp[b]:
            return lcp[a] > lcp[b]
        h = common(key[a], key[b], lcp[a])
        first = h == len(key[a]) or key[a][h] < key[b][h]
        lcp[b if first else a] = h
        return first

    for i in range(k):
        pull(i)
    tree = [0] * k
    front = list(range(k))
    while len(front) > 1:
        half = len(front) // 2
        winners = []
        for j in range(half):
            a, b = front[2 * j], front[2 * j + 1]
            won, lost = (a, b) if beats(a, b) else (b, a)
            tree[half + j] = lost
            winners.append(won)
        front = winners
    won = front[0]
    while key[won] is not None:
        yield key[won], lcp[won], value[won]
        pull(won)
        node = (k + won) // 2
        while node:
            if beats(tree[node], won):
                tree[node], won = won, tree[node]
            node //= 2


def _reach(group: list[tuple[bytes, int]], lcps: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For the suffixes of one gram, (entry, occurrences) in order with common
    prefixes, the longest L and R over all others with L + R >= WINDOW; -1
    where there is none."""
    m = len(group)
    rights = [WINDOW if k[8 + WINDOW - 1 : 8 + WINDOW] != FILL else len(k[8 : 8 + WINDOW].rstrip(FILL)) for k, _ in group]
    lefts = [len(k[8 + WINDOW :].rstrip(FILL)) for k, _ in group]
    low, high = np.full(m, -1), np.full(m, -1)
    adjacent = [min(h - 8, rights[i], rights[i + 1]) for i, h in enumerate(lcps[1:])]
    if m <= SMALL:
        for i in range(m):
            if group[i][1] > 1 and lefts[i] + rights[i] >= WINDOW:
                low[i], high[i] = lefts[i], rights[i]
            r = WINDOW
            for j in range(i + 1, m):
                r = min(r, adjacent[j - 1])
                if r + min(lefts[i], lefts[j]) < WINDOW:
                    if r + LEFT < WINDOW:
                        break
                    continue
                n = min(common(group[i][0][8 + WINDOW :], group[j][0][8 + WINDOW :]), lefts[i], lefts[j])
                if n + r >= WINDOW:
                    low[i], high[i] = max(low[i], n), max(high[i], r)
                    low[j], high[j] = max(low[j], n), max(high[j], r)
        return low, high
    rights, lefts, adjacent = np.array(rights), np.array(lefts), np.array(adjacent)
    tails = [k[8 + WINDOW :] for k, _ in group]
    order = np.array(sorted(range(m), key=tails.__getitem__))
    beside = np.array([min(common(tails[a], tails[b]), lefts[a], lefts[b]) for a, b in zip(order[:-1], order[1:])])
    many = np.array([n > 1 for _, n in group])
    left_class = np.zeros(m, np.int64)
    for d in range(LEFT + 1):
        right_class = np.concatenate(([0], np.cumsum(adjacent < WINDOW - d)))
        left_class[order] = np.concatenate(([0], np.cumsum(beside < d)))
        fits = (rights >= WINDOW - d) & (lefts >= d)
        _, at, count = np.unique(right_class * m + left_class, return_inverse=True, return_counts=True)
        found = fits & ((count[at] > 1) | many)
        low[found] = d
        high[found & (high < 0)] = WINDOW - d
    return low, high


def merged_stretches(runs: list[Iterator]) -> Iterator[tuple[int, int, int, int]]:
    """Merges runs of (entry, lcp, occurrences (id, t, place)) and yields the
    covered stretches (id, t, from, to)."""
    group, lcps, spots = [], [], []

    def flush():
        if len(group) == 1 and len(spots[0]) == 1:
            return
        low, high = _reach([(k, len(s)) for k, s in zip(group, spots)], lcps)
        for i in np.flatnonzero(low >= 0):
            for d, t, p in spots[i]:
                yield d, t, p - int(low[i]), p + int(high[i])

    for key, h, spot in loser_tree(runs):
        if group and h == len(key):
            spots[-1].extend(spot)
            continue
        if group and h < 8 + GRAM:
            yield from flush()
            group, lcps, spots = [], [], []
        group.append(key)
        lcps.append(h)
        spots.append(list(spot))
    if group:
        yield from flush()


_STRETCH = "id bigint, t bigint, lo int, hi int"
_RUN = "part int, lcp array<int>, tail array<binary>, n array<int>, id array<bigint>, t array<bigint>, p array<int>"


def _surveyed(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: id, t, n_bytes, whole text's hash, anchors."""

    def batches(parts):
        for part in parts:
            texts = [t.as_py() or b"" for t in part.column("text")]
            found = [anchors(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                part.column("id"), part.column("t"), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                pa.array([p.astype(np.int32) for p, _ in found], pa.list_(pa.int32())),
                pa.array([h.view(np.int64) for _, h in found], pa.list_(pa.int64()))],
                ["id", "t", "n_bytes", "sha", "p", "g"])

    return map_texts(_texts(docs), batches, "id bigint, t bigint, n_bytes bigint, sha string, p array<int>, g array<bigint>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(id_key(F.col("doc_id")).alias("id"), F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("text"))


def _sorted_runs(rows: DataFrame, parts: int) -> DataFrame:
    """Front-coded runs of the suffixes at the wanted anchors, by range."""

    def code(found):
        for part, entries in found.items():
            entries.sort(key=lambda e: e[0])
            keys, spots = [], []
            for k, *spot in entries:
                if keys and keys[-1] == k:
                    spots[-1].append(spot)
                else:
                    keys.append(k)
                    spots.append([spot])
            lcps, tails = front_code(keys)
            flat = [s for ss in spots for s in ss]
            yield {"part": part, "lcp": lcps, "tail": tails, "n": [len(s) for s in spots],
                   "id": [s[0] for s in flat], "t": [s[1] for s in flat], "p": [s[2] for s in flat]}

    kind = pa.schema([("part", pa.int32()), ("lcp", pa.list_(pa.int32())), ("tail", pa.list_(pa.binary())), ("n", pa.list_(pa.int32())),
                      ("id", pa.list_(pa.int64())), ("t", pa.list_(pa.int64())), ("p", pa.list_(pa.int32()))])

    def batches(batches_in):
        found, n = {}, 0
        for batch in batches_in:
            for d, t, text, spots in zip(*(batch.column(c) for c in ("id", "t", "text", "spots"))):
                d, t, text = d.as_py(), t.as_py(), text.as_py()
                for s in spots.as_py():
                    h = s["g"] & (2**64 - 1)
                    found.setdefault((h >> 32) * parts >> 32, []).append((entry(text, s["p"], h), d, t, s["p"]))
                    n += 1
                if n >= RUN:
                    yield from (pa.RecordBatch.from_pylist([r], kind) for r in code(found))
                    found, n = {}, 0
        yield from (pa.RecordBatch.from_pylist([r], kind) for r in code(found))

    return map_texts(rows, batches, _RUN)


def _merged(runs: DataFrame) -> DataFrame:
    def occurrences(row):
        at = 0
        for (key, h), n in zip(unfold(row["lcp"], row["tail"]), row["n"]):
            yield key, h, list(zip(row["id"][at : at + n], row["t"][at : at + n], row["p"][at : at + n]))
            at += n

    def merge(table):
        got = list(merged_stretches([occurrences(r) for r in table.to_pylist()]))
        cols = list(zip(*got)) or [(), (), (), ()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["id", "t", "lo", "hi"])

    return runs.groupBy("part").applyInArrow(merge, _STRETCH)


def _hot_windows(rows: DataFrame) -> DataFrame:
    """The exact way for hot grams: each window that holds a hot anchor's gram
    is a row with its hash; those that occur twice are covered."""

    def batches(parts):
        for part in parts:
            for d, t, text, spots in zip(*(part.column(c) for c in ("id", "t", "text", "spots"))):
                text = text.as_py()
                starts = sorted({s for p in spots.as_py() for s in range(max(0, p["p"] - LEFT), min(p["p"], len(text) - WINDOW) + 1)})
                digests = [xxhash.xxh128_digest(text[s : s + WINDOW]) for s in starts]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d.as_py()] * n, pa.int64()), pa.array([t.as_py()] * n, pa.int64()), pa.array(starts, pa.int32()), pa.array(digests, pa.binary())],
                    ["id", "t", "lo", "h"])

    windows = materialize(map_texts(rows, batches, "id bigint, t bigint, lo int, h binary"), "hot-windows")
    twice = windows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    return windows.join(twice, "h").select("id", "t", "lo", (F.col("lo") + WINDOW).alias("hi"))


def union_of(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of stretches as disjoint maximal ones, in order."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    return lo[new], hi[np.concatenate((new[1:], [True]))]


def cut(text: bytes, lo, hi) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes removed, maximal removed runs)."""
    lo, hi = union_of(np.asarray(lo, np.int64), np.asarray(hi, np.int64))
    keep, at = [], 0
    for a, b in zip(lo.tolist(), hi.tolist()):
        keep.append(text[at:a])
        at = b
    keep.append(text[at:])
    return b"".join(keep), int((hi - lo).sum()), len(lo)


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``id`` (null as LAST_ID),
    ``t`` (hash of the text), ``n_bytes, n_removed, n_spans, kept_sha256`` and
    ``kept``, the remaining bytes where any were removed (else null)."""
    rows = materialize(_surveyed(docs), "anchors")
    spots = rows.select("id", "t", F.explode(F.arrays_zip("p", "g")).alias("s")).select("id", "t", "s.p", "s.g")
    grams = materialize(spots.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "grams")
    total = grams.agg(F.sum("c").alias("c")).first()["c"] or 0
    wanted = spots.join(grams, "g").groupBy("id", "t").agg(F.collect_set(F.struct("p", "g", (F.col("c") > hot).alias("hot"))).alias("spots"))
    texts = materialize(_texts(docs).join(wanted, ["id", "t"]), "repeat-texts")
    split = lambda want: texts.withColumn("spots", F.filter("spots", lambda s: s.hot == want)).where(F.size("spots") > 0)
    found = _merged(_sorted_runs(split(F.lit(False)), max(1, -(-total // RANGE))))
    found = found.union(_hot_windows(split(F.lit(True))))
    found = found.groupBy("id", "t").agg(F.collect_list(F.struct("lo", "hi")).alias("s"))

    def batches(parts):
        for part in parts:
            got = [cut(x.as_py(), [s["lo"] for s in ss], [s["hi"] for s in ss]) for x, ss in ((x, ss.as_py()) for x, ss in zip(part.column("text"), part.column("s")))]
            yield pa.RecordBatch.from_arrays([
                part.column("id"), part.column("t"), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()),
                pa.array([hashlib.sha256(g[0]).hexdigest() for g in got], pa.string()), pa.array([g[0] for g in got], pa.binary())],
                ["id", "t", "n_removed", "n_spans", "new", "kept"])

    changed = texts.select("id", "t", "text").dropDuplicates(["id", "t"]).join(found, ["id", "t"])
    changed = map_texts(changed, batches, "id bigint, t bigint, n_removed bigint, n_spans bigint, new string, kept binary")
    out = rows.select("id", "t", "n_bytes", "sha").join(changed, ["id", "t"], "left")
    zero = F.lit(0).cast("bigint")
    return out.select("id", "t", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
                      F.coalesce("new", "sha").alias("kept_sha256"), "kept")
