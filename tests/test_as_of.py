"""The as-of join, against a plain lookup."""

import random

import pytest

from sluice.operators.running import last_before


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("width", [3, 4096])
def test_last_before(spark, keys, width):
    rng = random.Random(2)
    marks = [(k, t, f"{k}{t}") for k in "ab" for t in rng.sample(range(0, 60, 2) if k == "a" else range(1, 60, 2), 8)]
    rows = [(i, rng.choice("abc"), rng.randrange(-5, 70)) for i in range(200)]
    df, m = spark.createDataFrame(rows, "id int, k string, t int"), spark.createDataFrame(marks, "k string, t int, v string")
    got = {r.id: r.out and r.out.v for r in last_before(df, keys, "t", m.select(*keys, "t", "v"), ["v"], "out", width).collect()}
    want = {i: max(((mt, v) for mk, mt, v in marks if mt <= t and (not keys or mk == k)), default=(0, None))[1] for i, k, t in rows}
    assert got == want
    assert last_before(df, keys, "t", m.limit(0).select(*keys, "t", "v"), ["v"], "out", width).where("out is not null").count() == 0
