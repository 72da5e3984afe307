"""File sources on small fixture files: phrase lists, rule documents and
probe-run directories, plus JSON request parsing."""

import json
import tempfile

from pyspark.sql import functions as F

from sluice.functions.rules import DEFAULT_PATTERNS, DEFAULT_TERMS
from sluice.sources.files import latest_run_files, load_rules, load_terms
from sluice.sources.requests import parse_json_column


def _write(tmp, name, text):
    p = f"{tmp}/{name}"
    with open(p, "w", encoding="utf-8") as fh:
        fh.write(text)
    return p


def test_load_terms_strips_and_skips_comments(spark):
    tmp = tempfile.mkdtemp(prefix="sluice-test-")
    p = _write(tmp, "blocklist.txt", "# comment\n\n  ignore previous instructions \nleak all secrets\n   \n")
    got = [r.term for r in load_terms(spark, p).orderBy("pos").collect()]
    assert got == ["ignore previous instructions", "leak all secrets"]


def test_load_terms_empty_file_falls_back(spark):
    tmp = tempfile.mkdtemp(prefix="sluice-test-")
    p = _write(tmp, "empty.txt", "# only a comment\n")
    assert [r.term for r in load_terms(spark, p).orderBy("pos").collect()] == list(DEFAULT_TERMS)


def test_load_rules_missing_vs_empty_key(spark):
    tmp = tempfile.mkdtemp(prefix="sluice-test-")
    present = _write(tmp, "a.json", json.dumps({"prompt_injection_patterns": ["x\\s+y"]}))
    empty = _write(tmp, "b.json", json.dumps({"prompt_injection_patterns": []}))
    missing = _write(tmp, "c.json", json.dumps({"other": 1}))
    broken = _write(tmp, "d.json", "{not json")
    got = [load_rules(spark, p).first().prompt_injection_patterns for p in (present, empty, missing, broken)]
    assert got == [["x\\s+y"], [], list(DEFAULT_PATTERNS), list(DEFAULT_PATTERNS)]


def test_latest_run_files_picks_newest_run(spark):
    tmp = tempfile.mkdtemp(prefix="sluice-test-")
    import os

    for run, files in {"20240101_000000": ["a.json"], "20240102_000000": ["b.json", "c.bin"]}.items():
        os.makedirs(f"{tmp}/{run}")
        for f in files:
            _write(f"{tmp}/{run}", f, "{}")
    got = sorted((r.run_id, r.file) for r in latest_run_files(spark, tmp).collect())
    assert got == [("20240102_000000", "b.json"), ("20240102_000000", "c.bin")]


def test_parse_requests_flags_malformed(spark):
    df = spark.createDataFrame([(1, '{"k": 5}'), (2, "[1, 2]"), (3, "nope"), (4, '{"k": "x"}')], "id int, body string")
    out = {r.id: (r.malformed, r.parsed.k if r.parsed else None)
           for r in parse_json_column(df, "body", "k INT").collect()}
    assert out == {1: (False, 5), 2: (True, None), 3: (True, None), 4: (False, None)}


def test_probe_verdict_key_at_any_depth(spark):
    from sluice.operators.ops import payload_kind, probe_verdict

    rows = [(1, 200, '{"data": [{"embedding": [1]}]}', "embedding"), (2, 200, '{"error": {"message": "x"}}', "data"),
            (3, 500, '{"data": 1}', "data"), (4, 200, '{"text": "\\"embedding\\": no"}', "embedding")]
    df = spark.createDataFrame(rows, "id int, code int, body string, key string")
    got = {r.id: r.verdict for r in probe_verdict(df, code="code", body="body", expect_key="key").collect()}
    assert got == {1: "PASS", 2: "FAIL", 3: "FAIL", 4: "FAIL"}
    kinds = spark.createDataFrame([(b"RIFF1234",), (b"ID3x",), (b"",), (b'{"error": 1}',), (b"zz",)], "b binary")
    assert [r.k for r in kinds.select(payload_kind(F.col("b")).alias("k")).collect()] == \
        ["wav", "mp3", "empty", "json_error", "other"]
