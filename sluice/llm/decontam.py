"""Operator 8: benchmark decontamination.

Test items are cut into runs of N words, the seeds.  One pass over the
documents finds the seeds in each text, lines up the text around them with the
item by Smith-Waterman on words, and scores the alignment as a share of the
item's best possible score, so copies with words changed, added or left out
still score high.  All seeds of an item count, so every copy that keeps one
run of N words is aligned; one that keeps none is not seen.  A document is
contaminated if an item scores THRESHOLD or more.

Items are read in blocks of about BLOCK_WORDS words (their size is checked
first); the tasks get a block in their closure.  More than one block are
judged one after the other, each in a pass over the numbered documents that
writes the documents it finds, so neither the driver nor a task holds more
than one block.  Documents are never shuffled.

Defined cases: null or blank text is clean; items whose text is null or has
fewer than N words can't be told from chance and are never matched; items
without an id contaminate like others, but are named by null and not counted;
an item text that repeats counts under each of its ids; among items of the
same score the smallest id is named, null last; rows that repeat a doc_id are judged each by itself; an
empty table of documents gives an empty result, and an empty benchmark leaves
all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize
from .words import letter_words, ngram_hashes

N = 5
THRESHOLD = 0.5
BLOCK_WORDS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1


def _by_id(item: int | None) -> tuple[bool, int]:
    return item is None, item or 0


class Items:
    """One block of items: word codes, seeds and where they stand."""

    def __init__(self, rows: list[tuple[int | None, str]], n: int = N):
        self.n = n
        self.codes: dict[bytes, int] = {}
        self.ids, self.words = [], []
        for item, text in sorted(rows, key=lambda r: _by_id(r[0])):
            words = letter_words(text)
            if len(words) >= n:
                self.ids.append(item)
                self.words.append(np.array([self.codes.setdefault(w, len(self.codes) + 1) for w in words], np.int64))
        grams = [ngram_hashes(w.astype(np.uint64), n) for w in self.words]
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.at, self.item = at[order], item[order]
        self.seeds, self.start = np.unique(flat[order], return_index=True)
        self.start = np.append(self.start, len(flat))
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.seeds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text's word codes (0: in no item), places of seeds, seed numbers."""
        get = self.codes.get
        words = letter_words(text)
        codes = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        known = codes != 0
        runs = np.cumsum(np.concatenate(([0], known)))
        places = np.flatnonzero(runs[self.n :] - runs[: -self.n] == self.n) if len(codes) >= self.n else np.zeros(0, np.int64)
        if not len(places) or not len(self.seeds):
            return codes, places[:0], places[:0]
        grams = ngram_hashes(codes.astype(np.uint64), self.n)[places]
        some = self.sieve[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)]
        places, grams = places[some], grams[some]
        seed = np.minimum(np.searchsorted(self.seeds, grams), len(self.seeds) - 1)
        true = self.seeds[seed] == grams
        return codes, places[true], seed[true]

    def judge(self, text: str | None) -> list[tuple[float, int | None]]:
        """(score, item id) of the items with a seed in the text."""
        codes, places, seeds = self.hits(text)
        spots: dict[int, set[int]] = {}
        for p, s in zip(places.tolist(), seeds.tolist()):
            for e in range(self.start[s], self.start[s + 1]):
                spots.setdefault(int(self.item[e]), set()).add(p - int(self.at[e]))
        out = []
        for item, begins in spots.items():
            words, best = self.words[item], 0.0
            slack = len(words) // 2 + 2
            lo = hi = None
            for b in [*sorted(begins), None]:
                if lo is not None and (b is None or b - slack > hi):
                    best = max(best, align(codes[max(0, lo - slack) : hi + len(words) + slack], words))
                    lo = None
                if b is not None:
                    lo, hi = (b if lo is None else lo), b
            out.append((best, self.ids[item]))
        return out


def align(text: np.ndarray, item: np.ndarray) -> float:
    """Smith-Waterman score of two word sequences, as a share of the score of
    the item with itself.  A row at a time; gaps along the row by a running
    maximum."""
    step = np.arange(len(text) + 1) * -GAP
    row, best = np.zeros(len(text) + 1, np.int64), 0
    for w in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(text == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(new + step) - step
        best = max(best, int(row.max()))
    return best / (MATCH * len(item))


def item_blocks(items: DataFrame, n: int = N, block_words: int = BLOCK_WORDS) -> tuple[int, Iterator[Items]]:
    """How many blocks ``items`` (item_id, text) make, and the blocks, each
    read when it is asked for."""
    rows = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    size = rows.agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).first()["n"] or 0
    blocks = -(-size // block_words)

    def read():
        for b in range(blocks):
            part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
            yield Items([(r["item_id"], r["text"]) for r in part.collect()], n)

    return blocks, read()


def _found(rows: DataFrame, block: Items, threshold: float) -> DataFrame:
    """Per row of ``rows`` (row, text) that holds a seed of the block: ``row,
    score, item_id`` of the best item, ``n_items``, ``contaminated``."""
    kind = pa.schema([("row", pa.int64()), ("score", pa.float64()), ("item_id", pa.int64()), ("n_items", pa.int64()), ("contaminated", pa.bool_())])

    def batches(parts):
        for part in parts:
            got = []
            for row, t in zip(part.column("row").to_pylist(), part.column("text")):
                found = block.judge(t.as_py())
                if found:
                    score, item = min(found, key=lambda f: (-f[0], _by_id(f[1])))
                    high = [i for s, i in found if s >= threshold]
                    got.append((row, score, item, sum(i is not None for i in high), bool(high)))
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, g)) for g in got], schema=kind)

    return map_texts(rows, batches, "row bigint, score double, item_id bigint, n_items bigint, contaminated boolean")


def _best_of_all(rows: DataFrame, blocks: Iterator[Items], threshold: float) -> DataFrame:
    """``_found`` over all blocks, one after the other."""
    found = None
    for block in blocks:
        new = materialize(_found(rows, block, threshold), "leaks")
        found = new if found is None else found.union(new)
    first = F.struct(-F.col("score"), F.col("item_id").isNull(), "item_id")
    return found.groupBy("row").agg(F.max("score").alias("score"), F.min_by("item_id", first).alias("item_id"), F.sum("n_items").alias("n_items"), F.max("contaminated").alias("contaminated"))


def judge(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = N, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id, contaminated,
    item_id, score, n_items``: whether an item reaches the threshold, the best
    item (null without a seed), its score, and how many items with an id reach
    the threshold."""
    names = ("doc_id", "contaminated", "item_id", "score", "n_items")
    df = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size, blocks = item_blocks(items, n, block_words)
    if size > 1:
        df = materialize(df.withColumn("row", F.monotonically_increasing_id()), "numbered")
        out = df.select("row", "doc_id").join(_best_of_all(df.select("row", "text"), blocks, threshold), "row", "left")
        none = {"contaminated": False, "score": 0.0, "n_items": 0}
        return out.select(*(F.coalesce(c, F.lit(none[c])).alias(c) if c in none else F.col(c) for c in names))
    block = next(blocks, Items([], n))

    def batches(parts):
        for part in parts:
            got = []
            for t in part.column("text"):
                found = block.judge(t.as_py())
                score, item = min(found, key=lambda f: (-f[0], _by_id(f[1])), default=(0.0, None))
                high = [i for s, i in found if s >= threshold]
                got.append((bool(high), item, score, sum(i is not None for i in high)))
            cols = list(zip(*got)) or [(), (), (), ()]
            kinds = (pa.bool_(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], list(names))

    return map_texts(df, batches, "doc_id bigint, contaminated boolean, item_id bigint, score double, n_items bigint")


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = N, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that no item reaches the threshold in."""
    size, blocks = item_blocks(items, n, block_words)
    if size > 1:
        whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row"))
        whole = materialize(whole, "numbered")
        bad = _best_of_all(whole.select("row", F.col("doc.text").alias("text")), blocks, threshold).where("contaminated").select("row")
        return whole.join(bad, "row", "left_anti").select("doc.*")
    block, at = next(blocks, Items([], n)), docs.columns.index("text")

    def keep(parts):
        for part in parts:
            yield part.filter(pa.array([not any(s >= threshold for s, _ in block.judge(t.as_py())) for t in part.column(at)], pa.bool_()))

    return map_texts(docs, keep, docs.schema)
