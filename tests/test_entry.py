"""Registered queries against DuckDB on the smallest tables, and the entry module without its optional parts."""

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__
from leafline import page_queries, report_queries  # noqa: F401  they register their queries
from leafline.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents benchmark pages labels conversations".split()
there = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


#: Streams of many small batches, which tests/test_streams.py holds against plain results; here only where TEST_ALL is set.
SLOW = {"index_stream", "status_machine"}


@there
@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW or "TEST_ALL" in os.environ])
def test_query(spark, name):
    got = QUERIES[name](spark, DATA)
    rows = got.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: repr(tuple(plain(v) for v in r))
    assert sorted(key([r[n] for n in names]) for r in rows) == sorted(map(key, found.fetchall()))


@there
def test_flagship(spark, monkeypatch):
    out = __spark_entry__.entry(spark)
    statuses = {r.status for r in out.collect()}
    assert statuses <= {"retrieved", "rejected", "deferred", "error"} and "retrieved" in statuses


def test_without_the_optional_parts(monkeypatch):
    monkeypatch.setattr(__spark_entry__, "find_spec", lambda name: None)
    assert set(__spark_entry__.queries()) == set(QUERIES) and set(__spark_entry__.oracle_sql()) == set(ORACLE_SQL)


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert importlib.util.find_spec("leafline.queries")
