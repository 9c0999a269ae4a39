"""Every query against its DuckDB SQL over the smallest tables."""

import decimal
import math

import duckdb
import pytest

from quernel import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in queries.TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return round(float(v), 6) if isinstance(v, decimal.Decimal) else v


def rows(cells):
    return sorted((tuple(map(plain, r)) for r in cells), key=lambda t: [(x is None, str(x)) for x in t])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = rows(tuple(r[c] for c in columns) for r in df.collect())
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert [[str(x) for x in r] for r in got] == [[str(x) for x in r] for r in rows(tuple(r[names.index(c)] for c in columns) for r in want.fetchall())]
