"""Every query of the Markdown engine against DuckDB's answer on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from mdloom.plans.oracle import ORACLES
from mdloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return round(v, 6) if isinstance(v, float) else v


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df, want = QUERIES[name](spark, DATA), duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b
