"""Every query against its SQL, on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__
from quillspark.plans import file_queries, queries, relational

QUERIES = queries.QUERIES | file_queries.QUERIES | relational.QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return str(v) if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    got = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(got.columns) == columns
    at = [got.columns.index(c) for c in columns]
    theirs = [tuple(plain(r[i]) for i in at) for r in got.fetchall()]
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted(ours, key=key) == sorted(theirs, key=key)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "markdown"] and df.count() == 200
