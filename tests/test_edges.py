"""Edge rows the reference does not test (FIXTURES.md section C), each
checked against a plain-Python statement of the rule."""

import re
import unicodedata

from pyspark.sql import functions as F

from sluice.functions.pii import DEFAULT_RECOGNIZERS, pii_spans
from sluice.functions.rules import RuleSet
from sluice.functions.text import canon
from sluice.operators.decide import Rules, evaluate_input
from sluice.operators.detect import blocklist_hits, term_hits, terms_literal
from sluice.operators.ops import failure_streak
from sluice.operators.ratelimit import rate_limit
from sluice.settings import DEFAULTS


def _canon(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    return [tuple(r) for r in df.select(canon(F.col("raw")).alias("c")).select("c.text", "c.key").collect()]


def test_nfc_and_unicode_strip(spark):
    texts = ["é", " \tword　", "STRASSE", "straße", "plain ascii \x1c"]
    got = _canon(spark, texts)
    want = [(unicodedata.normalize("NFC", t).strip(), unicodedata.normalize("NFC", t).strip().casefold()) for t in texts]
    assert got == want


def _hits(spark, key, terms):
    df = spark.createDataFrame([(key,)], "key string")
    return df.select(blocklist_hits(F.col("key"), terms_literal(terms)).alias("h")).first().h


def test_casefold_terms(spark):
    assert _hits(spark, "dass", ["daß"]) == ["daß"]
    assert _hits(spark, "straße".casefold(), ["STRASSE"]) == ["STRASSE"]


def test_duplicate_spelling_keeps_later(spark):
    assert _hits(spark, "xabcx", ["Abc", "abc"]) == ["abc"]


def test_overlapping_terms(spark):
    assert _hits(spark, "abcd", ["abc", "bcd"]) == ["abc", "bcd"]


def test_term_table_equals_containment(spark):
    terms = ["ab", "abc", "bcd", "ß", "x", "long term here"]
    texts = ["abcd", "straße", "no hit", "xx long term here", "", "b"]
    docs = spark.createDataFrame([(i, t.casefold()) for i, t in enumerate(texts)], "id int, key string")
    tdf = spark.createDataFrame([(t, t.casefold()) for t in terms], "term string, key string")
    long = sorted((r.id, r.term) for r in term_hits(docs, ["id"], "key", tdf).collect())
    want = sorted((i, t) for i, x in enumerate(texts) for t in terms if t.casefold() in x.casefold())
    assert long == want


def test_pii_offsets_equal_python(spark):
    texts = ["call 010-1234-5678 or +82 10 1234 5678", "900101-1234567", "née🙂 a@b.co", "12345678901234",
             "x" * 5 + "010-0000-0000 b@c.de 010-1111-2222"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = sorted((r.id, r.s.entity_type, r.s.start, r.s.end)
                 for r in df.select("id", F.explode(pii_spans(F.col("text"))).alias("s")).collect())
    flags = re.DOTALL | re.MULTILINE | re.IGNORECASE
    want = sorted((i, rec.entity_type, m.start(), m.end()) for i, t in enumerate(texts)
                  for rec in DEFAULT_RECOGNIZERS for m in re.finditer(rec.regex, t, flags))
    assert got == want


def test_length_boundaries(spark):
    df = spark.createDataFrame([(0, "a" * 12000, "a" * 12000), (1, "a" * 12001, "a" * 12001)], "id int, text string, key string")
    out = evaluate_input(df, req=DEFAULTS, glob=DEFAULTS, rules=Rules(RuleSet(("zzz",), ("qqq",))))
    got = [r.reason_code for r in out.orderBy("id").collect()]
    assert got == [None, "INPUT_TOO_LONG"]


def _py_rate_limit(rows, window, max_hits):
    hits, out = {}, {}
    for rid, key, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        h = hits.setdefault(key, [])
        h[:] = [x for x in h if t - x <= window]
        if len(h) >= max_hits:
            out[rid] = True
        else:
            h.append(t)
            out[rid] = False
    return out


def test_rate_limit_fold_edges(spark):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    secs = [0, 10, 10, 60, 61, 121, 500, 500, 500, 1000, 1060, 1060]
    rows = [(i, "k" if i % 3 else "j", s) for i, s in enumerate(secs)]
    df = spark.createDataFrame([(i, k, base + dt.timedelta(seconds=s)) for i, k, s in rows],
                               "id long, key string, ts timestamp_ntz")
    got = {r.id: r.limited for r in rate_limit(df, key="key", ts="ts", order_id="id", window_seconds=60,
                                                max_requests=2).collect()}
    assert got == _py_rate_limit(rows, 60, 2)


def test_failure_streak_fires_at_3_and_6(spark):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, "s", base + dt.timedelta(seconds=i), True) for i in range(7)],
                               "id long, svc string, ts timestamp_ntz, fail boolean")
    fired = [r.id for r in failure_streak(df, key="svc", ts="ts", order_id="id", fail="fail").where("fired").collect()]
    assert sorted(fired) == [2, 5]


def test_ladder(spark):
    from sluice.operators.decide import phase3
    from sluice.settings import settings_struct

    cases = [(1, 0.9, None, "PII_DETECTED"), (0, 0.7, None, "TOXICITY_HIGH"), (0, 0.3, None, None),
             (0, 0.5, None, "GRAY_ZONE"), (0, 0.5, 0.49, "RELEVANCE_LOW")]
    df = spark.createDataFrame(cases, "npii int, tox double, rel double, want string")
    p2 = F.struct(F.struct(F.when(F.col("npii") > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
                           .alias("results")).alias("pii"),
                  F.struct(F.col("tox").alias("score")).alias("toxicity"),
                  F.struct(F.col("rel").alias("score")).alias("relevance"))
    out = df.select("want", phase3(p2, settings_struct(DEFAULTS))["reason_code"].alias("got")).collect()
    assert all(r.want == r.got for r in out)
