"""Queries of the catalog on tables shaped unlike the small ones, within little memory."""

import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from brindle.operators import relational as R
from brindle.plans import catalog

RUN = """
import sys
from brindle.plans import catalog
from brindle.session import build_session
s = build_session("small", "local[2]", {"spark.driver.memory": "700m", "spark.checkpoint.dir": sys.argv[1] + "/shared"})
catalog.QUERIES[sys.argv[2]](s, sys.argv[1]).write.parquet(sys.argv[1] + "/out")
"""


def small_heap(folder, name):
    """The query's rows, from a JVM of 700 MB."""
    got = subprocess.run([sys.executable, "-c", RUN, str(folder), name], capture_output=True, text=True, timeout=600, cwd=catalog.__file__.removesuffix("/brindle/plans/catalog.py"))
    assert got.returncode == 0, got.stderr[-2000:]
    return f"'{folder}/out/*.parquet'"


def test_spilled_window_of_large_groups(tmp_path):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    c.execute("CREATE TABLE orders AS SELECT i AS o_orderkey, CASE WHEN i % 1000 = 7 THEN NULL WHEN i % 5000 < 2 THEN 'A' || i % 5000 ELSE 'F' END AS o_orderstatus, (i * 7919 % 1000003) / 100.0::DOUBLE AS o_totalprice FROM range(100000) r(i)")
    c.execute("UPDATE orders SET o_orderkey = NULL WHERE o_orderkey = 55555; UPDATE orders SET o_totalprice = NULL WHERE o_orderkey % 50 < 9")
    c.execute(f"COPY orders TO '{tmp_path}/orders.parquet'")
    out = small_heap(tmp_path, "spilled_window")
    sql = catalog.ORACLE_SQL["spilled_window"]
    assert c.execute(f"SELECT count(*) FROM {out}").fetchone() == (100000,)
    for a, b in ((sql, f"FROM {out}"), (f"FROM {out}", sql)):
        assert c.execute(f"SELECT count(*) FROM (({a}) EXCEPT ALL ({b}))").fetchone() == (0,)


@pytest.mark.parametrize("before, after", [(3, 3), (0, 2), (5, 0), (9, 4)])
def test_sliding_is_the_window(spark, tmp_path, before, after):
    # groups of 1, 2, 3, ... rows, so that blocks of 4 begin and end anywhere in them
    df = spark.range(120).select(F.floor(F.sqrt(F.col("id") * 2)).alias("g"), (F.col("id") * 7 % 120).alias("k"), (F.col("id") * 31 % 17).alias("v"))
    p, n = R.placed(df, R.ordered(df, ("g", "asc"), ("k", "asc")), f"{tmp_path}/placed", "p")
    assert n == 120 and sorted(r.p for r in p.collect()) == list(range(120))
    got = R.sliding(p, n, ["g"], "p", F.sum("v"), "s", before, after, 4, 3).select("g", "k", "v", "s")
    df.createOrReplaceTempView("df")
    want = spark.sql(f"SELECT g, k, v, sum(v) OVER (PARTITION BY g ORDER BY k ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING) AS s FROM df")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_places_of_no_rows(spark, tmp_path):
    df = spark.range(0)
    p, n = R.placed(df, [F.col("id")], f"{tmp_path}/placed", "p")
    assert n == 0 and R.sliding(p, n, [], "p", F.sum("id"), "s", 1, 1).collect() == []


@pytest.mark.parametrize("suppliers, odd, balance", [("i", "", "1.5"), ("i + 5", "", "1.5"), ("i + 99999", "", "1.5"), ("i", ", 8, NULL", "1.5"), ("i", "", "NULL")])
def test_external_rows_with_keys_of_customers(spark, tmp_path, suppliers, odd, balance):
    c = duckdb.connect()
    c.execute(f"CREATE TABLE supplier AS SELECT {suppliers} AS s_suppkey, 'S' || i AS s_name, (i % 25)::INT AS s_nationkey, CASE WHEN i = 3 THEN {balance} WHEN i = 7 THEN -1.5 ELSE i * 10.0 END::DOUBLE AS s_acctbal FROM range(12) r(i)")
    c.execute(f"CREATE TABLE customer AS SELECT i AS c_custkey, CASE WHEN i % 3 = 0 THEN 100.0 ELSE 6000.0 END::DOUBLE AS c_acctbal FROM (SELECT unnest([0, 1, 2, 4, 8, 100000, 100001, 100002, 100004{odd}]) AS i)")
    for t in ("supplier", "customer"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = catalog.QUERIES["dml_external"](spark, str(tmp_path)).collect()
    want = c.execute(catalog.ORACLE_SQL["dml_external"]).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
