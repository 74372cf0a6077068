"""Operators that SQL can express against DuckDB."""

import duckdb
import pytest

from lodestar.llm import registry


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("size", ["0.001", "0.01"])
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, sf, name, size):
    d = sf.replace("0.001", size)
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = registry.QUERIES[name](spark, d)
    want = con.sql(registry.ORACLE_SQL[name])
    assert rows(df.columns, map(tuple, df.collect())) == rows(want.columns, want.fetchall())
