"""Operator 7: language identification by hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1, drawn from its code
point.  A letter trigram is the product (binding) of its letters' vectors,
rotated by 2, 1 and 0 places; a text is the sum (bundle) of its trigrams, and
a language the sum of its labelled texts.  A text's language is the one whose
prototype has the largest cosine with the text's vector.  Sums are of
integers, so the prototypes don't depend on how the rows are dealt out.

Training is one pass: each task sums its texts' trigram counts per label and
returns one vector a label; the driver gets (labels x DIM) numbers.
Prediction is one narrow map, with the prototypes in its closure.

Defined cases: a text that is null or has no letter is ``und`` with score 0,
and so is every text when no row has a label; ties go to the label that sorts
first; a null doc_id counts as empty text for the held-out rule; repeated
rows are judged alike; an empty table gives an empty result.  As a filter
(``with_language``), texts without letters and long texts unlike all profiles
go; where no row has a label nothing was learned, and every row stays.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

DIM = 512
#: Letters of one label that a training task counts at a time.
CODES = 1 << 19
HELD_OUT = 2
#: A text unlike a profile has a cosine of deviation 1 / sqrt(DIM).  As a filter,
#: a text of LEAST distinct trigrams or more whose best cosine is below NOISE
#: deviations is in none of the languages; a shorter one may be all rare words.
LEAST, NOISE = 100, 4.0


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class _Vectors(dict):
    """Code point -> its random vector; 0 is the word border."""

    def __missing__(self, c: int) -> np.ndarray:
        v = self[c] = np.random.Generator(np.random.PCG64([7, int(c)])).integers(0, 2, DIM, dtype=np.int8) * 2 - 1
        return v


_VECTORS = _Vectors()


def letter_codes(text: str | None) -> np.ndarray:
    """Lower-cased letters as code points, runs of other characters as one 0,
    a 0 at both ends; empty without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    codes = np.where(_letters()[codes], codes, 0)
    codes = np.concatenate(([0], codes, [0]))
    codes = codes[(codes != 0) | np.concatenate(([True], codes[:-1] != 0))]
    return codes if len(codes) > 1 else codes[:0]


def trigrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams (21 bits a letter) and their counts."""
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    return np.unique(keys[codes[1:-1] != 0], return_counts=True)


def bundle(grams: np.ndarray, counts: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """Sum of the trigrams' vectors, each times its count."""
    out = np.zeros(DIM)
    letters, at = np.unique(np.stack([grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF]), return_inverse=True)
    at = at.reshape(3, -1)
    table = np.stack([_VECTORS[int(c)] for c in letters]) if len(letters) else np.zeros((0, DIM), np.int8)
    rolled = [np.roll(table, 2, 1), np.roll(table, 1, 1), table]
    for i in range(0, len(grams), chunk):
        a, b, c = (r[x[i : i + chunk]] for r, x in zip(rolled, at))
        out += counts[i : i + chunk].astype(np.float32) @ (a * b * c).astype(np.float32)
    return out


def train(docs: DataFrame) -> dict[str, np.ndarray]:
    """label -> prototype, from the rows of ``docs`` (text, lang) with a label."""

    def sums(parts):
        total: dict[str, np.ndarray] = {}
        held: dict[str, list] = {}
        size: dict[str, int] = {}

        def add(lang):
            grams, counts = trigrams(np.concatenate(held.pop(lang)))
            total[lang] = total.get(lang, np.zeros(DIM, np.int64)) + _exact_bundle(grams, counts)
            size[lang] = 0

        for part in parts:
            for text, lang in zip(part.column("text"), part.column("lang")):
                lang, codes = lang.as_py(), letter_codes(text.as_py())
                held.setdefault(lang, []).append(codes)
                size[lang] = size.get(lang, 0) + len(codes)
                if size[lang] >= CODES:
                    add(lang)
        for lang in list(held):
            add(lang)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], ["lang", "v"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    rows = map_texts(rows, sums, "lang string, v array<bigint>").select("lang", F.posexplode("v").alias("i", "x"))
    out: dict[str, np.ndarray] = {}
    for r in rows.groupBy("lang", "i").agg(F.sum("x").alias("x")).collect():
        out.setdefault(r["lang"], np.zeros(DIM))[r["i"]] = r["x"]
    return dict(sorted(out.items()))


def _exact_bundle(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """As ``bundle``, in integers."""
    out = np.zeros(DIM, np.int64)
    for i in range(0, len(grams), 1024):
        a, b, c = (np.stack([_VECTORS[int(x)] for x in (grams[i : i + 1024] >> s) & 0x1FFFFF]) for s in (42, 21, 0))
        out += counts[i : i + 1024] @ (np.roll(a, 2, 1) * np.roll(b, 1, 1) * c).astype(np.int64)
    return out


def judge_with(prototypes: dict[str, np.ndarray]):
    """text -> (label, cosine, distinct trigrams), with the prototypes in the
    closure."""
    names = list(prototypes)
    units = np.stack([p / max(np.linalg.norm(p), 1e-300) for p in prototypes.values()]) if names else np.zeros((0, DIM))

    def judge(text):
        grams, counts = trigrams(letter_codes(text))
        if not len(grams) or not names:
            return "und", 0.0, len(grams)
        v = bundle(grams, counts)
        cos = units @ v / max(np.linalg.norm(v), 1e-300)
        best = int(np.argmax(cos))
        return names[best], float(min(1.0, max(0.0, cos[best]))), len(grams)

    return judge


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id, lang_pred, score``
    (the cosine, 0 at least)."""
    judge = judge_with(prototypes)

    def batches(parts):
        for part in parts:
            got = [judge(t.as_py()) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    df = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_texts(df, batches, "doc_id bigint, lang_pred string, score double")


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def learned(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from the labelled rows that aren't held out."""
    return train(docs.where(~held_out()))


def with_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in a learned language, with their own columns."""
    prototypes = learned(docs)
    if not prototypes:
        return docs
    judge = judge_with(prototypes)
    at = docs.columns.index("text")

    def known(text):
        label, cosine, grams = judge(text)
        return label != "und" and (grams < LEAST or cosine >= NOISE / np.sqrt(DIM))

    def keep(parts):
        for part in parts:
            yield part.filter(pa.array([known(t.as_py()) for t in part.column(at)], pa.bool_()))

    return map_texts(docs, keep, docs.schema)
