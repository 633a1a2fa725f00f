"""Every query with an oracle against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from cuemill.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _value(v):
    return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(_value(r[c]) for c in columns) for r in df.collect()), key=str)
    assert len(set(columns)) == len(columns)
    if name not in catalogue.SQL:
        assert got
        return
    result = oracle.execute(catalogue.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(_value(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert got == want
