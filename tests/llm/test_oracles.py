"""The queries that SQL can express, against DuckDB on whole small tables."""

import os

import duckdb
import pytest

from brindle.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("BRINDLE_TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_as_duckdb(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = c.execute(ORACLE_SQL[name])
    columns = [x[0] for x in cur.description]
    want = sorted((tuple(r) for r in cur.fetchall()), key=str)
    got = sorted((tuple(r) for r in QUERIES[name](spark, SF).select(*columns).collect()), key=str)
    assert got == want
