"""Every registered query on tables with odd rows, and those with SQL against DuckDB."""

import duckdb
import pytest

from leafline.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import ROWS

PER_ROW = [n for n in QUERIES if not n.startswith(("op3_", "op11_", "op13_"))]


@pytest.mark.parametrize("name", list(QUERIES))
def test_odd_rows(spark, tables, name):
    rows = QUERIES[name](spark, tables).collect()
    if name in PER_ROW:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)
    again = QUERIES[name](spark, tables).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, tables, name, tmp_path):
    for t in ("documents", "benchmark", "labels", "embeddings"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    got = QUERIES[name](spark, tables)
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    expected = sorted(str(r) for r in found.fetchall())
    assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == expected
