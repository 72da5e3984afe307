"""Analyzer outcomes: values or errors per row, deadlines, and what the ladder makes of them."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluice.operators.decide import Analyzers, evaluate_input
from sluice.operators.semantic import make_outcome_udf, outcomes
from sluice.settings import DEFAULTS


def test_only_rows_at_fault_carry_the_error():
    def model(b):
        if (b["x"] == 3).any():
            raise ValueError("three")
        return pd.DataFrame({"a": b["x"] * 2.0})

    got = outcomes(model, pd.DataFrame({"x": range(6)}), ["a"], None, 4)
    assert got == [({"a": 0.0}, None), ({"a": 2.0}, None), ({"a": 4.0}, None), (None, "three"), ({"a": 8.0}, None), ({"a": 10.0}, None)]


def test_rows_after_the_deadline_time_out():
    def model(b):
        if (b["x"] == 2).any():
            time.sleep(5)
        return pd.DataFrame({"a": b["x"] * 1.0})

    began = time.monotonic()
    got = outcomes(model, pd.DataFrame({"x": range(5)}), ["a"], began + 0.5, 1)
    assert time.monotonic() - began < 3
    assert got == [({"a": 0.0}, None), ({"a": 1.0}, None), (None, "timeout"), (None, "timeout"), (None, "timeout")]


def test_outcome_udf(spark):
    def load():
        def model(b):
            if (b["x"] == 1).any():
                raise TimeoutError("timeout")
            return b.rename(columns={"x": "a"})
        return model

    udf = make_outcome_udf(["a"], load, deadline=60.0)
    got = {r.id: (r.o.scores, r.o.error) for r in spark.range(3).coalesce(1).select("id", udf(F.struct(F.col("id").cast("double").alias("x"))).alias("o")).collect()}
    assert got == {0: ({"a": 0.0}, None), 1: (None, "timeout"), 2: ({"a": 2.0}, None)}


@pytest.mark.parametrize("pii,tox,rel,want", [
    (None, None, None, ("observe", "PII_DETECTED", [], [])),
    ("timeout", None, None, ("observe", "TOXICITY_HIGH", ["pii"], [])),
    ("timeout", "timeout", None, ("observe", "RELEVANCE_LOW", ["pii", "toxicity"], [])),
    ("timeout", "broken", "timeout", ("allow", "ANALYZER_TIMEOUT_OBSERVE", ["pii", "relevance"], ["toxicity"])),
    ("a", "b", "c", ("allow", None, [], ["pii", "toxicity", "relevance"])),
])
def test_failed_analyzers_leave_the_ladder_to_the_others(spark, pii, tox, rel, want):
    df = spark.createDataFrame([("mail a@b.co", "mail a@b.co", {"t": 0.9}, (0.1, "g"), 1, pii, tox, rel)],
                               "text string, key string, tox map<string,double>, rel struct<score:double,label:string>, n int, pe string, te string, re string")
    req = DEFAULTS.with_(relevance_enabled=True, phase3_mode="observe")
    an = Analyzers(tox_scores="tox", relevance="rel", golden_size="n", pii_error="pe", tox_error="te", relevance_error="re")
    r = evaluate_input(df, req=req, glob=req, analyzers=an).first()
    assert (r.action, r.reason_code, r.phase2.timeouts, [e.analyzer for e in r.phase2.errors]) == want
    assert r.phase2.pii.enabled == (pii is None) and r.phase2.pii.error == pii
    assert (r.phase2.toxicity.score is None) == (tox is not None) and r.phase2.relevance.error == rel
