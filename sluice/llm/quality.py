"""Operator 12: quality rules by a calibrated classifier of hashed n-grams.

Features of a whole text: the shares of its word n-grams (one and two words,
case kept) and of its character n-grams (two to four code points), each hashed
to DIM places.  A logistic regression over them is trained on labelled rows, and
its margin is calibrated to a probability on labelled rows that the training
didn't see (Platt scaling).  One Arrow pass then scores every text: a text's
margin is the mean weight of its n-grams, so nothing but the weights, whose size
DIM gives, travels to the tasks.

Training reads a bounded sample: the TRAIN labelled ids of smallest hash, a
documented limit of the classifier alone; every text is scored.  The sample's
ids are broadcast (TRAIN of them), its features written and read back as
``libsvm`` rows, and Spark's own solver does the rest.

Plain rules stand beside it: a text fails the base rules with fewer than
MIN_WORDS words, or if more than MAX_REPEATS percent of its words lie in
three-word windows that are found twice.  A text is kept if it passes them and
its probability of good quality is KEEP_AT or more.

Defined cases: a null or empty text has no words and fails the base rules; of
labels that repeat an id the mean counts (0.5 is good), null ids and labels are
left out, and so are labels without a document; if the sample lacks good or bad
rows nothing is learned, every probability is 1 and the base rules alone decide;
without calibration rows of both kinds the margin is used as it is; repeated
rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import BLANKS, map_texts
from .words import WordHashes, mixed, ngram_hashes

DIM = 1 << 15
TRAIN = 12_000
#: Base rules, and the probability from which a text is kept.
MIN_WORDS, MAX_REPEATS, KEEP_AT = 50, 50, 0.5
SYMBOLS = "#*$%&|<>"
#: Regularisation and steps of the regression; one labelled row in CALIBRATE
#: calibrates instead of training.
PENALTY, STEPS, CALIBRATE = 1e-4, 60, 4
#: A share is multiplied by this, so that weights are of order one.
SHARE = 100.0
#: Code points hashed at a time.
CHUNK = 1 << 18

_WORDS = WordHashes(200_000)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    #: probability = 1 / (1 + exp(-(slope * margin + offset)))
    slope: float = 1.0
    offset: float = 0.0


def _places(text: str, words: list[bytes]):
    """Hashed places of the n-grams, in pieces: (family, places); each family
    has one piece at least."""
    h = _WORDS.of(words)
    for n in (1, 2):
        yield 0, (ngram_hashes(h, n) & np.uint64(DIM - 1)).astype(np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    for n in (2, 3, 4):
        for lo in range(0, max(1, len(codes) - n + 1), CHUNK):
            part = codes[lo : lo + CHUNK + n - 1]
            key = np.full(max(0, len(part) - n + 1), n, np.uint64)
            for i in range(n):  # 21 bits a code point, three at most without loss, the fourth mixed in
                key = (mixed(key) if i == 3 else key << np.uint64(21)) ^ part[i : len(key) + i]
            yield 1, (mixed(key) & np.uint64(DIM - 1)).astype(np.int64)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places ascending, values): per family, the share of its n-grams."""
    text = text or ""
    places = [[], []]
    for family, at in _places(text, text.encode("utf-8", "surrogatepass").split()):
        places[family].append(at)
    at = [np.concatenate(p) for p in places]
    share = [np.full(len(a), SHARE / max(len(a), 1)) for a in at]
    where, n = np.unique(np.concatenate(at), return_inverse=True)
    return where, np.bincount(n, np.concatenate(share), len(where))


def margin(model: Model, text: str, words: list[bytes]) -> float:
    s, n = [0.0, 0.0], [0, 0]
    for family, at in _places(text, words):
        s[family] += float(model.weights[at].sum())
        n[family] += len(at)
    return model.bias + SHARE * sum(a / max(b, 1) for a, b in zip(s, n))


def probability(model: Model | None, text: str, words: list[bytes]) -> float:
    if model is None:
        return 1.0
    z = model.slope * margin(model, text, words) + model.offset
    return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that are found twice or more."""
    if len(words) < 4:
        return 0
    number: dict = {}
    w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
    pairs = np.unique(w[:-1] * len(number) + w[1:], return_inverse=True)[1]
    _, at, n = np.unique(pairs[:-1] * len(number) + w[2:], return_inverse=True, return_counts=True)
    again = np.zeros(len(w), bool)
    for i in range(3):
        again[i : len(w) - 2 + i] |= n[at] > 1
    return int(again.sum())


def base(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(BLANKS):
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> DataFrame:
    """``doc_id, text, y`` of the labelled sample; texts are not shuffled."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        (F.avg("quality") >= 0.5).cast("int").alias("y"))
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the labelled sample, or None where it has one kind only."""
    from pyspark.ml.classification import LogisticRegression

    spark = docs.sparkSession
    path = scratch_path(spark, "quality")

    def lines(parts):
        for part in parts:
            out = []
            for y, text in zip(part.column("y").to_pylist(), part.column("text")):
                at, value = features(text.as_py())
                pairs = pc.binary_join_element_wise(pc.cast(pa.array(at + 1), pa.string()), pc.cast(pa.array(value.astype(np.float32)), pa.string()), ":")
                out.append(" ".join([str(y), *pairs.to_pylist()]))
            yield pa.RecordBatch.from_arrays([part.column("fold"), pa.array(out, pa.string())], ["fold", "value"])

    rows = sample(docs, labels).select("text", "y", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % CALIBRATE == 0).cast("int").alias("fold"))
    kinds = rows.select("fold", "y").distinct().collect()  # four rows at most; no text is read for it
    of = lambda fold: {r.y for r in kinds if r.fold == fold}
    if len(of(0)) < 2:
        return None
    map_texts(rows, lines, "fold int, value string").write.partitionBy("fold").option("compression", "gzip").text(path)
    read = lambda fold: spark.read.format("libsvm").option("numFeatures", str(DIM)).load(f"{path}/fold={fold}")
    fitted = LogisticRegression(maxIter=STEPS, regParam=PENALTY).fit(read(0))
    model = Model(fitted.coefficients.toArray(), float(fitted.intercept))
    if len(of(1)) < 2:
        return model
    from pyspark.ml.functions import array_to_vector, vector_to_array

    # the raw prediction holds (-margin, margin)
    seen = fitted.transform(read(1)).select("label", array_to_vector(F.array(vector_to_array("rawPrediction")[1])).alias("features"))
    platt = LogisticRegression(maxIter=STEPS, regParam=1e-3).fit(seen)
    return Model(model.weights, model.bias, float(platt.coefficients[0]), float(platt.intercept))


def verdict(model: Model | None, text: str | None) -> tuple:
    """(the five base counts, base_failed, kept, probability) of one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    counts = base(text, words)
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEATS * counts[0]
    p = probability(model, text, words)
    return *counts, failed, not failed and p >= KEEP_AT, p


def judge(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    quality`` (the calibrated probability of good quality)."""
    kinds = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
             ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("quality", pa.float64())]

    def batches(parts):
        for part in parts:
            rows = [verdict(model, t.as_py()) for t in part.column("text")]
            columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *(n for n, _ in kinds)])

    df = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_texts(df, batches, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, quality double")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    model = train(docs, labels)
    at = docs.columns.index("text")

    def keep(parts):
        for part in parts:
            yield part.filter(pa.array([verdict(model, t.as_py())[6] for t in part.column(at)], pa.bool_()))

    return map_texts(docs, keep, docs.schema)
