"""Operator 3 on a large group of texts that share much but not enough: the
pairs that reach the full sets grow with the links, not with the group's square."""

import random

import brute
import numpy as np
import pytest

from sluice.llm import minhash


def _apart(a, b):
    return int(np.bitwise_count((minhash.parity(a) ^ minhash.parity(b)).view(np.uint64)).sum())


def test_parity_never_says_more_than_there_is():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 50, 700, 9000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for share in (0.0, 0.5, 0.9, 1.0):
            b = np.union1d(a[: int(share * len(a))], rng.integers(0, 2**64, n // 9, dtype=np.uint64))
            assert _apart(a, b) <= len(np.setxor1d(a, b))
        assert _apart(a, a) == 0


def test_pairs_at_the_threshold_may_link(spark):
    """Two sets of 92 shingles that have 85 in common, of 99 in all."""
    both = [f"s{k}" for k in range(87)]
    rows = [(i, " ".join(both + [f"d{i}x{k}" for k in range(7)])) for i in (0, 1)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.component for r in got.collect()} == {0}


@pytest.mark.parametrize("turns", [0, 2])
def test_few_pairs_of_a_large_group_reach_the_sets(spark, monkeypatch, turns):
    rng, seen, real = random.Random(9), {}, minhash.materialize
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(2):
            k = rng.randrange(len(w) - 5)
            del w[k : k + 5]
        rows.append((i, " ".join(w)))

    def counted(df, name, *rest):
        out = real(df, name, *rest)
        if name in ("pairs", "last-pairs", "links"):
            seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    got = sorted((r.id, r.n_shingles, r.component, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), turns=turns).collect())
    assert got == sorted((i, *w) for (i, _), w in zip(rows, brute.near_classes(rows)))
    # of 11,175 pairs
    assert seen.get("pairs", 0) + seen["last-pairs"] <= 2 * seen["links"] + 1000


def test_last_step_meets_few_nodes_of_a_large_group(spark, monkeypatch):
    """Copies of one text with up to ten words replaced: most are one component
    after the stars, and chance edits that few copies share are no candidates."""
    rng, seen, real = random.Random(3), {}, minhash.materialize
    base, other = [f"w{i}" for i in range(150)], [f"v{i}" for i in range(25)]
    rows = []
    for i in range(500):
        w = list(base)
        for _ in range(rng.randrange(11)):
            w[rng.randrange(len(w))] = rng.choice(other)
        rows.append((i, " ".join(w)))

    def kept(df, name, *rest):
        seen[name] = real(df, name, *rest)
        return seen[name]

    monkeypatch.setattr(minhash, "materialize", kept)
    got = sorted((r.id, r.n_shingles, r.component, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == sorted((i, *w) for (i, _), w in zip(rows, brute.near_classes(rows)))
    links = seen["links"].count()
    assert links > 20 and seen["last-pairs"].count() <= 2 * links + 20
    met = seen["few"].select("key").join(seen["common"].select("key"), "key").count()
    before = seen["open"].groupBy("key").count().selectExpr("sum(count * count)").first()[0]
    assert met <= before / 20
