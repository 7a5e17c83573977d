"""Every registered query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from tidemark.plans import registry


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if x is None or x != x else x for x in r) for r in df.astype(object).itertuples(index=False)), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{data}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_sql(spark, data, duck, name):
    got = registry.QUERIES[name](spark, data).toPandas()
    if name not in registry.ORACLES:
        assert len(got)
        return
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    for a, b in zip(_rows(got), _rows(want), strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, float(y), rel_tol=1e-6, abs_tol=2e-6) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry_points(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
