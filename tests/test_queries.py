"""Every query against its SQL, at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from skylathe.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 4) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_is_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    cursor = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    want = [[plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)] for r in cursor.fetchall()]
    got = [[plain(r[c]) for c in sorted(names)] for r in df.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
