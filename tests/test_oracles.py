"""Every query with SQL gives what DuckDB gives, on the smallest driver tables."""

import os

import duckdb
import pytest

from noticeloom.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    assert rows == sorted(repr(tuple(dict(zip(want.columns, r, strict=True))[c] for c in columns)) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
