"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from lodestar.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert rows(df.columns, map(tuple, df.collect())) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).collect() is not None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
