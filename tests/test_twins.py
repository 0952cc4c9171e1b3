"""Every query with an SQL twin gives the rows that DuckDB gives; the others run and keep their schema."""

import math

import duckdb
import pytest

from tapeloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES, TWINS = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    def clean(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 4) + 0.0
        return x
    return sorted(([clean(r[i]) for i in order] for r in data), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert len(set(df.columns)) == len(df.columns)
    if name in TWINS:
        want = duck.sql(TWINS[name])
        assert sorted(df.columns) == sorted(want.columns)
        expected = rows(want.columns, want.fetchall())
        assert len(got) == len(expected)
        for a, b in zip(got, expected):
            for x, y in zip(a, b):
                assert x == y or isinstance(x, float) and abs(x - y) <= 2e-4 * max(1, abs(x)), (a, b)
    else:
        assert got
