"""Every registered query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from webgrain.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 1e9 else str(v)
    return str(v).replace("+00:00", "")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf, con, name):
    same(registry.queries()[name](spark, sf), con.sql(registry.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(registry.goldens()))
def test_literal_rows(spark, sf, con, name):
    query, sql = registry.goldens()[name]
    same(query(spark, sf), con.sql(sql))


def same(got, want):
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    at = [want.columns.index(c) for c in cols]
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    expected = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_run(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0
