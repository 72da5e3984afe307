"""Every registered query against its DuckDB oracle (order-insensitive,
doubles at 6 digits), on the small scale factor."""

import duckdb
import pytest

from sluice.plans import all_queries
from sluice.session import TABLES

QUERIES, ORACLE = all_queries()


def _norm(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = _norm(df.collect())
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    want = _norm(cur.fetchall())
    assert df.columns == cols
    assert got == want
    types = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
             "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    duck_types = [r[1] for r in con.execute(f"DESCRIBE {ORACLE[name]}").fetchall()]
    assert [types.get(t, t) for _, t in df.dtypes] == duck_types


def test_every_query_has_an_oracle_or_is_listed():
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only == set()


def test_entry_contract(spark):
    import importlib.util
    import os

    path = os.path.join(os.path.dirname(os.path.dirname(__file__)), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    out = mod.entry(spark)
    assert out.columns == ["reason_code", "blocks"]
    assert out.count() >= 0
    assert set(mod.queries()) >= set(QUERIES)
    assert set(mod.oracle_sql()) <= set(mod.queries())
