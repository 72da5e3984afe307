"""UDFs on whole texts hold a hundred rows at a time, not an Arrow batch."""

import pytest
from pyspark.sql import functions as F

from sluice.functions.chat import canon_list
from sluice.functions.text import canon, casefold
from sluice.operators.detect import first_pattern_column

ROWS = [(0, None, None, None), (1, "", [""], []), (2, " Café  ", [" é ", None, "A "], ["x", None, "CAF."]),
        (3, "Straße\n", ["ß"], ["strasse", "STRA."]), (4, " plain A ", [" b "], ["n a"]), (5, "äöü", [], None)]
CASES = {
    "canon": (lambda: canon(F.col("t")), [None, ("", ""), ("Café", "café"), ("Straße", "strasse"), ("plain A", "plain a"), ("äöü", "äöü")]),
    "casefold": (lambda: casefold(F.col("t")), [None, "", " café  ", "strasse\n", " plain a ", "äöü"]),
    "canon_list": (lambda: canon_list(F.col("l")), [None, [""], ["é", None, "A"], ["ß"], ["b"], []]),
    "first_pattern": (lambda: first_pattern_column(F.col("t"), F.col("p")), [None, None, "CAF.", "STRA.", "n a", None]),
}


@pytest.mark.parametrize("name", CASES)
def test_text_udfs(spark, name):
    column, want = CASES[name]
    df = spark.createDataFrame(ROWS, "id int, t string, l array<string>, p array<string>").select("id", column().alias("got"))
    got = [r.got for r in sorted(df.collect())]
    assert [tuple(g) if isinstance(w, tuple) else g for g, w in zip(got, want)] == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("query", ["casefold_key", "phase3", "pinned_replay"])
def test_queries_send_texts_in_small_batches(spark, sf, query):
    from __spark_entry__ import queries

    plan = queries()[query](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
