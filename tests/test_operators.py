"""Equivalences between plans, and the NULL matrix."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import scalar
from brindle.operators import relational as R
from brindle.sources import tables as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def two(spark):
    a = S.values(spark, ["k", "x"], [(1, "a"), (2, "b"), (2, "c"), (None, "d"), (5, "e")])
    b = S.values(spark, ["j", "y"], [(1, 10), (2, 20), (2, 21), (None, 30), (7, 70)])
    return a, b


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_join_strategies_agree(two, how):
    a, b = two
    got = [rows(R.equi_join(a, b.hint(h), [("k", "j")], how)) for h in ("merge", "shuffle_hash", "broadcast")]
    assert got[0] == got[1] == got[2]
    n = {"inner": 5, "left": 7, "right": 7, "full": 9, "left_semi": 3, "left_anti": 2}[how]
    assert len(got[0]) == n


def test_salted_join_is_the_join(two):
    a, b = two
    assert rows(R.salted_join(a, b.withColumnRenamed("j", "k"), "k", 3).select("k", "x", "y")) == rows(R.equi_join(a, b, [("k", "j")]).select("k", "x", "y"))


def test_not_in_matrix(spark, two):
    a, b = two
    assert rows(R.anti_not_in(a, "k", b, "j")) == []
    assert rows(R.anti_not_in(a, "k", b.filter("j IS NOT NULL"), "j")) == [(5, "e")]
    assert len(rows(R.anti_not_in(a, "k", b.limit(0), "j"))) == 5
    a.createOrReplaceTempView("a"), b.createOrReplaceTempView("b")
    for cond in ("true", "j IS NOT NULL", "false"):
        assert rows(R.anti_not_in(a, "k", b.filter(cond), "j")) == rows(spark.sql(f"SELECT * FROM a WHERE k NOT IN (SELECT j FROM b WHERE {cond})"))


def test_in_equals_semi_join_equals_exists(spark, two):
    a, b = two
    a.createOrReplaceTempView("a"), b.createOrReplaceTempView("b")
    want = rows(R.semi_in(a, "k", b, "j"))
    assert want == rows(spark.sql("SELECT * FROM a WHERE k IN (SELECT j FROM b)")) == rows(spark.sql("SELECT * FROM a WHERE EXISTS (SELECT 1 FROM b WHERE j = k)"))


def test_in_list_is_three_valued(two):
    a, _ = two
    got = a.select(R.in_list(F.col("k"), [1, None]), R.in_list(F.col("k"), [1, None], True), R.in_list(F.col("k"), [1]), scalar.shown(F.col("k") == 1)).collect()
    assert [tuple(r) for r in got][:1] == [(True, False, True, True)] and tuple(got[3]) == (None, None, None, False) and tuple(got[4]) == (None, None, False, False)


def test_distinct_equals_group_by(two):
    a, _ = two
    assert rows(a.select("k").distinct()) == rows(R.aggregate(a, ["k"], [F.count("*").alias("n")]).select("k"))


def test_null_order(two):
    a, _ = two
    assert [r.k for r in a.orderBy(*R.ordered(a, ("k", "asc"))).collect()][-1] is None
    assert [r.k for r in a.orderBy(*R.ordered(a, ("k", "desc"))).collect()][0] is None
    assert [r.k for r in R.top_n(a, [("k", "desc")], 2).collect()] == [None, 5]


def test_aggregates_of_nothing(spark):
    e = S.values(spark, ["v"], [(1,)]).limit(0)
    assert rows(R.aggregate(e, [], [F.count("*"), F.sum("v"), F.avg("v"), F.min("v")])) == [(0, None, None, None)]
    assert rows(R.aggregate(e, ["v"], [F.count("*")])) == []


def test_values_take_common_types(spark):
    df = S.values(spark, ["a", "b", "c"], [(1, None, "x"), (2**40, 1.5, None)])
    assert [f.dataType for f in df.schema.fields] == [T.LongType(), T.DoubleType(), T.StringType()]


def test_scalars(spark):
    df = S.values(spark, ["a", "b", "s"], [(7, 2, "Grüß"), (-7, 2, "x"), (None, 1, None)])
    got = df.select(scalar.int_div(F.col("a"), F.col("b"), T.IntegerType()), scalar.try_int_div(F.col("a"), F.lit(0), T.IntegerType()), scalar.ascii_upper(F.col("s")), scalar.ascii_lower(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(3, None, "GRüß", "grüß"), (-3, None, "X", "x"), (None, None, None, None)]


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    S.write_parquet(spark.range(1000).withColumn("v", F.col("id") * 2).withColumn("w", F.lit("x")), str(tmp_path / "t"), "zstd")
    plan = S.parquet(spark, str(tmp_path / "t")).filter("id > 990").select("v")._jdf.queryExecution().toString()
    assert "GreaterThan(id,990)" in plan and "w:string" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_shell(spark):
    from brindle.__main__ import Shell
    from brindle.api import Database

    with Database(spark=spark) as db:
        s = Shell(db)
        s.run("CREATE TABLE t(v INT PRIMARY KEY); INSERT INTO t VALUES (1), (2)")
        assert s.run("\\dt") == "t" and "v INTEGER PRIMARY KEY" in s.run("\\d t")
        assert "(2 rows)" in s.run("SELECT * FROM t") and s.run("\\echo hi") == "hi"
        s.run("BEGIN"), s.run("DELETE FROM t"), s.run("\\session other")
        assert "(2 rows)" in s.run("SELECT * FROM t")
        assert "unknown" in s.run("\\nope")
