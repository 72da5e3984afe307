"""Vector codes, hard negatives and quality rules: against plain versions, on
rows with every defined edge case, and their methods' own parts."""

import random

import brute
import numpy as np
import pytest

from sluice.llm import hard_negatives, hilbert, quality, vector_codes
from sluice.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")
VECTORS = "id bigint, label string, v array<double>, code string, w int, block bigint, x string, error string"


def rows_of(n, dim, labels=4, seed=3, spread=1.0):
    rng = random.Random(seed)
    at = [[rng.gauss(0, spread) for _ in range(dim)] for _ in range(labels)]
    return [(i, f"l{i % labels}", [rng.gauss(c, 0.3) for c in at[(i * 7) % labels]]) for i in range(n)]


BAD = [(5000, "l0", None), (5100, "l0", [NAN] * 20), (5200, "l0", [INF] + [1.0] * 19), (5300, "l1", [None] + [1.0] * 19), (5400, "l1", [9000.0] * 20),
       (5500, "l1", [1.0] * 7), (5600, "l1", []), (5700, "l1", [-INF] * 20)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, "clash", "clash") for r in rows], VECTORS)


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


# ------------------------------------------------------------------ operator 11


@pytest.mark.parametrize("most", [1, 3, 50, 10_000])
def test_trie_finds_the_nearest_entries(most):
    rng = np.random.default_rng(1)
    for d, spread in ((1, 9), (3, 4), (4, 40), (5, 2)):
        parts = np.unique(rng.integers(-spread, spread, (400, d)), axis=0)
        book = rng.integers(-spread, spread, (11, d))
        index, least = vector_codes.nearest(parts, book, most)
        far = ((parts[:, None] - book[None]) ** 2).sum(2)
        assert (index == far.argmin(1)).all() and (least == far.min(1)).all()


def check_codes(spark, rows, valid):
    got = vector_codes.compress(frame(spark, rows)).collect()
    want, digest = brute.codebooks(valid)
    sums = {}
    for _, label, _, e in want:
        sums[label] = sums.get(label, 0) + e
    same([(r.id, r.label, r.code, r.error, r.label_error) for r in got], [(*w, sums[w[1]]) for w in want])
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_vector_codes(spark):
    rows = rows_of(150, 20)
    more = [(None, None, rows[3][2]), (7, "l9", rows[5][2]), (9, None, rows[9][2]), (9, None, rows[9][2])]
    check_codes(spark, rows + more + BAD, rows + more)


def test_vector_codes_of_few_rows_and_hot_vectors(spark):
    rows = rows_of(9, 32)
    check_codes(spark, rows, rows)
    hot = rows_of(40, 16) + [(100 + i, None if i % 2 else "hot", [0.5] * 16) for i in range(200)]
    check_codes(spark, hot, hot)
    assert vector_codes.compress(frame(spark, [])).count() == 0
    assert vector_codes.compress(frame(spark, [(1, "a", None)])).count() == 0


def test_many_labels_are_joined_with_a_salt(spark, monkeypatch):
    rows = rows_of(120, 16, labels=30)
    monkeypatch.setattr(vector_codes, "SMALL", 0)
    check_codes(spark, rows + [(1000, None, [0.1] * 16)], rows + [(1000, None, [0.1] * 16)])


# ------------------------------------------------------------------ operator 13


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2), (1, 5)])
def test_hilbert_curve_takes_single_steps(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert.keys(grid, bits)
    path = grid[sorted(range(len(grid)), key=lambda i: keys[i])]
    assert len(set(keys)) == len(grid)
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_hold_all_products_of_a_box():
    rng = np.random.default_rng(2)
    x, points = rng.integers(-9, 9, (6, 5)).astype(float), rng.integers(-9, 9, (8, 30, 5)).astype(float)
    low, high = hard_negatives.bounds(x, points.min(1), points.max(1))
    score = np.einsum("ad,bpd->abp", x, points)
    assert (low <= score.min(2)).all() and (score.max(2) <= high).all()


def check_negatives(spark, rows, valid, every=20):
    got = hard_negatives.mine(frame(spark, rows), every=every).collect()
    same([tuple(r) for r in got], brute.hard_negatives(valid, every))


def test_hard_negatives(spark):
    rows = rows_of(300, 20)
    more = [(None, "l1", rows[3][2]), (9000, None, rows[3][2]), (12, "l0", [9.0] * 20)]
    valid = rows + [(4000 + i, "l1", rows[20][2]) for i in range(30)]
    check_negatives(spark, valid + more + BAD, valid)
    assert hard_negatives.mine(frame(spark, [])).count() == 0
    assert hard_negatives.mine(frame(spark, [(100, "a", [1.0, 2.0])])).count() == 0


@pytest.mark.parametrize("hot", [0, 400])
def test_hard_negatives_over_many_ranges(spark, monkeypatch, hot):
    """Small blocks and ranges: anchors read blocks of other ranges by their zone maps."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "RANGE", 100)
    monkeypatch.setattr(hard_negatives, "ZONES", 7)
    rows = rows_of(600, 6, labels=5, spread=2.0) + [(1000 + i, f"l{i % 2}", [1.5, -0.5, 0.25, 1.0, 0.0, 0.5]) for i in range(hot)]
    seen = []
    plain = hard_negatives.needed_blocks

    def counted(anchors, blocks, same_):
        out = plain(anchors, blocks, same_)
        seen.append((out.count(), blocks.count() * (blocks.select("range").distinct().count() - 1)))
        return out

    monkeypatch.setattr(hard_negatives, "needed_blocks", counted)
    check_negatives(spark, rows, rows)
    assert all(0 < read < 0.7 * all_ for read, all_ in seen)


# ------------------------------------------------------------------ operator 12


@pytest.mark.parametrize("table", ["edge", "sf"])
def test_quality_base_columns(spark, sf, table):
    docs = brute.edge_docs(spark) if table == "edge" else spark.read.parquet(f"{sf}/documents.parquet")
    got = quality.judge(docs, None).collect()
    same([(r.doc_id, *r[1:7]) for r in got], [(r.doc_id, *brute.quality_base(r.text)) for r in docs.select("doc_id", "text").collect()])
    assert all(r.kept != r.base_failed and r.quality == 1.0 for r in got)


def test_repeated_words():
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 4, 5, 30, 80):
        for _ in range(20):
            words = [rng.choice("abcd") for _ in range(n)]
            assert quality.repeated_words([w.encode() for w in words]) == brute.quality_base(" ".join(words))[4]


def test_quality_is_learned(spark, sf):
    """Labelled rows that the training never saw are told apart."""
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = quality.train(docs.where("doc_id % 3 <> 0"), labels)
    got = quality.judge(docs.where("doc_id % 3 = 0"), model).withColumnRenamed("quality", "p").join(labels, "doc_id").where("n_words >= 20").collect()
    good, bad = ([r for r in got if r.quality == q and not r.base_failed] for q in (1, 0))
    assert len(good) > 500 and len(bad) >= 50
    assert np.mean([r.kept for r in good]) >= 0.98 and np.mean([r.kept for r in bad]) <= 0.1
    # calibrated: the mean probability is near the share of good rows
    assert abs(np.mean([r.p for r in good + bad]) - len(good) / len(good + bad)) < 0.08


def test_quality_edges(spark):
    docs = brute.edge_docs(spark)
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, text string")
    assert quality.train(docs, make([])) is None
    assert quality.train(docs, make([(1, 1, 0, ""), (2, 1, 0, ""), (3, None, 0, ""), (None, 0, 0, ""), (999, 0, 0, "")])) is None
    some = make([(i, i % 2, 0, "clash") for i in range(1, 17)] + [(1, 1, 0, "clash")])
    model = quality.train(docs, some)
    got = quality.judge(docs, model).collect()
    assert len(got) == len(brute.rows()) and all(0 <= r.quality <= 1 for r in got) and not any(r.kept for r in got if r.n_words < 50)
    kept = quality.good_documents(docs, some)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in got if r.kept)
    assert quality.judge(brute.empty_docs(spark), model).count() == 0 and quality.train(brute.empty_docs(spark), some) is None


def test_quality_does_not_depend_on_the_deal(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    once, again = (sorted((r.doc_id, r.kept, round(r.quality, 6)) for r in QUERIES["op12_quality_rules"](spark, sf).collect()) for _ in range(2))
    assert once == again and len(once) == docs.count()
