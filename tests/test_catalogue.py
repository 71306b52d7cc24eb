"""Every query that has SQL gives the rows of its SQL."""

from __future__ import annotations

import decimal

import duckdb
import pytest

from docsearch.plans import chunk_queries, search_queries, sheet_queries, text_queries

MODULES = (text_queries, sheet_queries, chunk_queries, search_queries)
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize(("name", "module"), [(n, m) for m in MODULES for n in m.SQL])
def test_query_matches_sql(spark, db, name, module):
    df = module.QUERIES[name](spark, SF)
    want = db.sql(module.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    names = sorted(df.columns)
    at = [want.columns.index(c) for c in names]
    got = sorted(repr(tuple(norm(r[c]) for c in names)) for r in df.collect())
    assert got == sorted(repr(tuple(norm(r[k]) for k in at)) for r in want.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
