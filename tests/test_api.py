import datetime
import decimal
import threading
import time

import pandas as pd
import pytest

import brindle.errors as E
from brindle.api import Database


@pytest.fixture
def db(spark):
    with Database(spark=spark) as d:
        yield d


def rows(r):
    return sorted(r.tuples(), key=str)


def test_generated_ids(db):
    db.execute_script("CREATE TABLE t(v INT); INSERT INTO t VALUES (10), (20), (30)")
    assert db.sql("SELECT * FROM t ORDER BY _id").tuples() == [(0, 10), (1, 20), (2, 30)]
    db.execute_script("DELETE FROM t WHERE v = 20; INSERT INTO t VALUES (40)")
    assert rows(db.sql("SELECT _id, v FROM t")) == [(0, 10), (2, 30), (3, 40)]
    with pytest.raises(E.BinderError):
        db.sql("INSERT INTO t VALUES (99, 100)")
    with pytest.raises(E.BinderError):
        db.sql("CREATE TABLE bad(_id INT)")


def test_primary_keys(db):
    db.execute_script("CREATE TABLE t(id INT PRIMARY KEY, v INT); INSERT INTO t VALUES (1, 1), (2, 2), (3, 3)")
    for bad in ("INSERT INTO t VALUES (1, 5)", "INSERT INTO t VALUES (9, 1), (9, 2)", "UPDATE t SET id = 7"):
        with pytest.raises(E.ConflictError):
            db.sql(bad)
    assert db.sql("UPDATE t SET id = id + 1").affected_rows == 3  # a permutation is fine at the end of the statement
    assert rows(db.sql("SELECT id, v FROM t")) == [(2, 1), (3, 2), (4, 3)]
    db.execute_script("DELETE FROM t WHERE id = 2; INSERT INTO t VALUES (2, 9)")
    assert db.sql("SELECT count(*) FROM t").tuples() == [(3,)]
    db.execute_script("CREATE TABLE c(a INT, b INT, v INT, PRIMARY KEY(a, b)); INSERT INTO c VALUES (1, 1, 0), (1, 2, 0)")
    with pytest.raises(E.ConflictError):
        db.sql("INSERT INTO c VALUES (1, 2, 3)")


def test_self_insert_and_set_sees_old_row(db):
    db.execute_script("CREATE TABLE t(a INT, b INT); INSERT INTO t VALUES (1, 2), (3, 4); INSERT INTO t SELECT a, b FROM t; UPDATE t SET a = b, b = a")
    assert rows(db.sql("SELECT a, b FROM t")) == [(2, 1), (2, 1), (4, 3), (4, 3)]


def test_dml_subqueries_and_nulls(db):
    db.execute_script("CREATE TABLE t(v INT, s VARCHAR); CREATE TABLE u(w INT); INSERT INTO t VALUES (1, 'a'), (2, NULL), (NULL, 'c'); INSERT INTO u VALUES (1), (1), (2)")
    assert db.sql("UPDATE t SET s = 'x' WHERE v IN (SELECT w FROM u)").affected_rows == 2
    assert db.sql("DELETE FROM t WHERE s = 'x' AND v = 2").affected_rows == 1
    assert db.sql("DELETE FROM t WHERE v <> 1").affected_rows == 0  # null is not true
    assert rows(db.sql("SELECT v, s FROM t")) == [(1, "x"), (None, "c")]
    assert db.sql("UPDATE t SET v = (SELECT max(w) FROM u) WHERE v IS NULL").affected_rows == 1
    assert db.sql("SELECT v FROM t ORDER BY v DESC").tuples() == [(2,), (1,)]


def test_dialect(db):
    db.execute_script("CREATE TABLE t(i INT, d DOUBLE, s VARCHAR(5)); INSERT INTO t VALUES (7, 1.5, 'it''s'), (NULL, 2, 'a\\b')")
    one = db.sql("SELECT i / 2, i / 2.0, (i + 1) / 3, d / 2, i * 3 / 2 FROM t WHERE i IS NOT NULL").tuples()
    assert one == [(3, 3.5, 2, 0.75, 10)]
    assert db.sql("SELECT i FROM t ORDER BY i").tuples() == [(7,), (None,)]
    assert db.sql("SELECT i FROM t ORDER BY i DESC").tuples() == [(None,), (7,)]
    assert db.sql("SELECT i FROM t ORDER BY i NULLS FIRST LIMIT 1").tuples() == [(None,)]
    assert db.sql("SELECT s FROM t WHERE s LIKE '%\\%'").tuples() == [("a\\b",)]
    assert db.sql("SELECT s FROM t WHERE s = 'it''s'").tuples() == [("it's",)]
    assert db.sql('SELECT "s" AS "a b", i::BIGINT, CAST(d AS VARCHAR) FROM t WHERE i = 7').columns[0] == "a b"
    assert db.sql("SELECT 1.5, ARRAY[1, 2], 3000000000, CAST(ARRAY[1,2] AS BIGINT[])").types == ["DOUBLE", "INTEGER[]", "BIGINT", "BIGINT[]"]
    with pytest.raises(E.ExecutionError):
        db.sql("SELECT CAST('x' AS INT) FROM t")
    with pytest.raises(E.ExecutionError):
        db.sql("SELECT i / 0 FROM t WHERE i = 7")


def test_types_are_checked_on_write(db):
    db.execute_script("CREATE TABLE t(u UTINYINT, a INT[2], d DATE, m DECIMAL(10,2))")
    db.sql("INSERT INTO t VALUES (255, ARRAY[1, 2], '2024-02-29', 1.5)")
    assert db.sql("SELECT u, a, d, m FROM t").tuples() == [(255, [1, 2], datetime.date(2024, 2, 29), decimal.Decimal("1.50"))]
    for bad in ("(256, ARRAY[1, 2], '2024-01-01', 1)", "(1, ARRAY[1], '2024-01-01', 1)", "(1, ARRAY[1, 2], 'x', 1)"):
        with pytest.raises(E.ExecutionError):
            db.sql(f"INSERT INTO t VALUES {bad}")
    db.sql("CREATE TABLE n(i INT)")
    with pytest.raises(E.BinderError):
        db.sql("INSERT INTO n VALUES (3000000000)")  # integers never narrow
    assert [c["type"] for c in db.describe_table("t")["columns"]] == ["BIGINT", "UTINYINT", "INTEGER[2]", "DATE", "DECIMAL(10,2)"]


def test_update_conflict(db):
    db.execute_script("CREATE TABLE t(id INT PRIMARY KEY, v INT); INSERT INTO t VALUES (1, 10), (2, 20), (3, 30)")
    a, b = db.connect(), db.connect()
    a.sql("BEGIN"), b.sql("BEGIN")
    b.sql("UPDATE t SET v = 222 WHERE id = 2")
    a.sql("UPDATE t SET v = 100 WHERE id = 1")
    assert a.sql("SELECT v FROM t WHERE id = 1").tuples() == [(100,)] and b.sql("SELECT v FROM t WHERE id = 1").tuples() == [(10,)]
    a.sql("COMMIT")
    with pytest.raises(E.ConflictError):
        b.sql("UPDATE t SET v = 111 WHERE id = 1")
    assert not b.in_transaction
    with pytest.raises(E.ExecutionError):
        b.sql("COMMIT")
    assert rows(db.sql("SELECT * FROM t")) == [(1, 100), (2, 20), (3, 30)]


def test_disjoint_writers_and_rollback(db):
    db.execute_script("CREATE TABLE t(id INT PRIMARY KEY, v INT); INSERT INTO t VALUES (1, 10), (2, 20), (3, 30)")
    a, b = db.connect(), db.connect()
    a.begin(), b.begin()
    a.sql("UPDATE t SET v = 11 WHERE id = 1")
    b.sql("DELETE FROM t WHERE id = 2")
    b.sql("INSERT INTO t VALUES (4, 40)")
    a.commit(), b.commit()
    assert rows(db.sql("SELECT * FROM t")) == [(1, 11), (3, 30), (4, 40)]
    with pytest.raises(RuntimeError), a.transaction():
        a.sql("DELETE FROM t")
        raise RuntimeError
    with a.transaction():
        a.sql("UPDATE t SET v = v + 1 WHERE id = 1")
        a.sql("UPDATE t SET v = v + 1 WHERE id = 1")
        a.sql("INSERT INTO t VALUES (5, 50)")
        a.sql("DELETE FROM t WHERE id = 5")
    assert rows(db.sql("SELECT * FROM t")) == [(1, 13), (3, 30), (4, 40)]
    a.begin(), b.begin()
    a.sql("INSERT INTO t VALUES (6, 0)")
    with pytest.raises(E.ConflictError):
        b.sql("INSERT INTO t VALUES (6, 1)")
    a.commit()
    assert db.collect_garbage()["files_removed"] > 0 and db.sql("SELECT count(*) FROM t").tuples() == [(4,)]


def test_concurrent_generated_ids(db):
    db.sql("CREATE TABLE t(v INT)")
    a, b = db.connect(), db.connect()
    a.begin(), b.begin()
    a.sql("INSERT INTO t VALUES (1), (2)")
    b.sql("INSERT INTO t VALUES (3)")
    a.commit(), b.commit()
    got = rows(db.sql("SELECT _id, v FROM t"))
    assert [v for _, v in got] == [1, 2, 3] and len({i for i, _ in got}) == 3


def test_serializable(db):
    db.execute_script("CREATE TABLE t(id INT PRIMARY KEY, v INT); INSERT INTO t VALUES (1, 1), (2, 1)")
    a, b = db.connect(), db.connect()
    a.begin("serializable"), b.begin("serializable")
    for c, mine in ((a, 1), (b, 2)):  # write skew
        assert c.sql("SELECT sum(v) FROM t").tuples() == [(2,)]
        c.sql(f"UPDATE t SET v = 0 WHERE id = {mine}")
    a.commit()
    with pytest.raises(E.ConflictError):
        b.commit()
    assert rows(db.sql("SELECT * FROM t")) == [(1, 0), (2, 1)]


@pytest.mark.parametrize(("sql", "types", "want"), [
    ("SELECT t.a / t.b, t.c / t.a, u.a / t.a FROM t, u WHERE t.a = 7", ["INTEGER", "BIGINT", "DOUBLE"], [(3, 1, 2.5 / 7)]),
    ("WITH w AS (SELECT a / 2 AS h FROM t) SELECT h / 2, (h + 1) / 2, h / 2.0 FROM w WHERE h = 3", ["INTEGER", "INTEGER", "DOUBLE"], [(1, 2, 1.5)]),
    ("SELECT a / 2 FROM (SELECT a * 1.5 AS a FROM t WHERE a = 7) y", ["DOUBLE"], [(5.25,)]),
    ("SELECT (a + b) / 2 / 2, CASE WHEN a > 1 THEN a ELSE b END / 2, sum(a) OVER () / 3 FROM t WHERE a = 7", ["INTEGER", "INTEGER", "BIGINT"], [(2, 3, 2)]),
    ("SELECT sum(a) / count(*) FROM t GROUP BY b / 2 HAVING sum(a) / 2 > 1", ["BIGINT"], [(4,)]),
    ("SELECT a FROM t WHERE a / 2 IN (SELECT max(c) / 3 FROM t) AND a / (SELECT max(b) / 1 FROM t) = 3", ["INTEGER"], [(7,)]),
    ("SELECT a / 2.5 / 2, x / CAST(2 AS SMALLINT), -a / 2, NULL / 2 FROM (SELECT t.a, x FROM t, u WHERE b = 2 AND t.a = 7) z", ["DOUBLE", "SMALLINT", "INTEGER", "DOUBLE"], [(1.4, 1, -3, None)]),
])
def test_division_by_types_of_the_analysed_plan(db, sql, types, want):
    db.execute_script("CREATE TABLE t(a INT, b INT, c BIGINT); CREATE TABLE u(a DOUBLE, x SMALLINT); INSERT INTO t VALUES (7, 2, 9), (1, 2, 3); INSERT INTO u VALUES (2.5, CAST(3 AS SMALLINT))")
    r = db.sql(sql)
    assert (r.types, r.tuples()) == (types, want)


def test_division_in_changes(db):
    db.execute_script("CREATE TABLE t(a INT, d DOUBLE); CREATE TABLE u(d INT); INSERT INTO t VALUES (7, 7), (9, 9); INSERT INTO u VALUES (5); UPDATE t SET a = a / 2, d = d / 2 WHERE a / 2 = (SELECT d / 2 + 1 FROM u); DELETE FROM t WHERE a / 4 = 2")
    assert rows(db.sql("SELECT a, d FROM t")) == [(3, 3.5)]


def test_serializable_reads_of_subqueries(db):
    db.execute_script("CREATE TABLE t(id INT PRIMARY KEY, v INT); CREATE TABLE u(id INT PRIMARY KEY, w INT); INSERT INTO t VALUES (1, 1); INSERT INTO u VALUES (1, 5)")
    a, b = db.connect(), db.connect()
    a.begin("serializable"), b.begin("serializable")
    a.sql("UPDATE t SET v = (SELECT max(w) FROM u)")
    b.sql("UPDATE u SET w = (SELECT max(v) FROM t) + 100")
    a.commit()
    with pytest.raises(E.ConflictError):
        b.commit()
    a.begin("serializable"), b.begin("serializable")
    a.sql("UPDATE t SET v = 9 WHERE id / 2 = 4")  # reads nothing that b writes
    b.sql("UPDATE t SET v = 7 WHERE id = 1")
    b.commit(), a.commit()
    assert rows(db.sql("SELECT v FROM t")) == [(7,)] and rows(db.sql("SELECT w FROM u")) == [(5,)]


def test_sources_are_evaluated_once(db, tmp_path):
    db.execute_script(f"CREATE TABLE x(r DOUBLE) WITH (format='parquet', location='{tmp_path / 'x'}'); CREATE TABLE n(id INT PRIMARY KEY, r DOUBLE); INSERT INTO n SELECT CAST(id AS INT), 0.0 FROM range(200)")
    n = db.sql("INSERT INTO x SELECT rand() FROM range(1000) WHERE rand() < 0.5").affected_rows
    assert 0 < n < 1000 and db.sql("SELECT count(*) FROM x").tuples() == [(n,)]
    for t, most in (("x", n), ("n", 200)):
        k = db.sql(f"UPDATE {t} SET r = 2 + rand() WHERE rand() < 0.5").affected_rows
        assert 0 < k < most and db.sql(f"SELECT count(*) FROM {t} WHERE r >= 2").tuples() == [(k,)]
        assert db.sql(f"SELECT count(*) FROM {t}").tuples() == [(most,)]


def test_small_files_are_merged(db, monkeypatch):
    from brindle.tables import managed

    monkeypatch.setattr(managed, "MANY", 4)
    db.sql("CREATE TABLE t(id INT PRIMARY KEY)")
    for i in range(9):
        db.sql(f"INSERT INTO t VALUES ({i})")
    table = managed.ManagedTable(db.spark, db.tables["t"])
    assert len(table.manifest()["files"]) < 5 and db.sql("SELECT count(*), sum(id) FROM t").tuples() == [(9, 36)]


def test_external(db, spark, tmp_path):
    folder = tmp_path / "x"
    spark.createDataFrame([(1, "hello")], "i int, j string").coalesce(1).write.parquet(str(tmp_path / "w"))
    folder.mkdir()
    next((tmp_path / "w").glob("*.parquet")).rename(folder / "a.parquet")
    db.sql(f"CREATE TABLE t WITH (format='parquet', location='{folder}')")
    assert db.sql("SELECT * FROM t").tuples() == [(1, "hello")]
    db.execute_script("INSERT INTO t VALUES (2, 'two'), (3, 'three'); UPDATE t SET i = i + 100 WHERE j = 'two'; DELETE FROM t WHERE i = 3")
    assert rows(db.sql("SELECT * FROM t")) == [(1, "hello"), (102, "two")]
    assert db.vacuum("t") >= 1 and rows(db.sql("SELECT i FROM t")) == [(1,), (102,)]
    c = db.connect()
    c.begin()
    assert c.sql("SELECT count(*) FROM t").tuples() == [(2,)]
    with pytest.raises(E.NotSupportedError):
        c.sql("INSERT INTO t VALUES (9, 'x')")
    assert not c.in_transaction
    db.sql("DROP TABLE t")
    assert list(folder.glob("**/*.parquet"))
    for bad in (f"CREATE TABLE u(i BIGINT, j VARCHAR) WITH (format='parquet', location='{folder}')", f"CREATE TABLE u WITH (format='parquet', location='{tmp_path / 'none'}')", f"CREATE TABLE u(i INT PRIMARY KEY) WITH (format='parquet', location='{folder}')", f"CREATE TABLE u(i INT) WITH (format='csv', location='{folder}')"):
        with pytest.raises(E.DatabaseError):
            db.sql(bad)


def test_reopen(spark, tmp_path):
    with Database(tmp_path / "d", spark=spark) as d:
        d.execute_script("CREATE TABLE t(v INT, s VARCHAR, dec DECIMAL(10,2), d DATE); INSERT INTO t VALUES (10, 'ten', CAST(1.50 AS DECIMAL(10,2)), '2024-01-01')")
    with pytest.raises(E.DatabaseClosedError):
        d.sql("SELECT 1")
    with Database(tmp_path / "d", spark=spark) as d:
        d.sql("INSERT INTO t VALUES (30, 'thirty', 3.00, '2024-12-31')")
        assert d.sql("SELECT _id, v, dec FROM t ORDER BY _id").tuples() == [(0, 10, decimal.Decimal("1.50")), (1, 30, decimal.Decimal("3.00"))]
        assert [t["name"] for t in d.get_tables()] == ["t"]


def test_pandas_round_trip(db):
    frame = pd.DataFrame({"n": pd.array([1, None], "Int64"), "b": pd.array([True, None], "boolean"), "day": [datetime.date(2024, 1, 1), None], "at": pd.to_datetime(["2024-01-01 10:00", None]), "amount": [decimal.Decimal("1.25"), None], "label": ["x", None], "f": [1.5, None], "u": pd.array([3, 4], "uint8")})
    db.load_df(frame, "t", primary_key="u")
    got = db.sql("SELECT n, b, day, at, amount, label, f, u FROM t ORDER BY u").to_df()
    assert str(got.n.dtype) == "Int64" and str(got.b.dtype) == "boolean" and str(got["at"].dtype) == "datetime64[us]"
    assert got.label.tolist() == ["x", None] and got.amount[0] == decimal.Decimal("1.25") and got.day[0] == datetime.date(2024, 1, 1)
    with pytest.raises(E.ConflictError):
        db.load_df(frame, "t", if_exists="append")
    db.load_df(frame, "t", if_exists="replace")
    with pytest.raises(E.ProgrammingError):
        db.load_df(frame, "t")
    for bad in (pd.DataFrame({"a": [1, "x"]}), pd.DataFrame({1: [1]}), pd.DataFrame([[1, 2]], columns=["a", "A"]), pd.DataFrame({"a": [object()]})):
        with pytest.raises(E.DataError):
            db.load_df(bad, "bad")
    with pytest.raises(E.DataError):
        db.load_df(frame, "bad", primary_key="n")
    assert [t["name"] for t in db.get_tables()] == ["t"]


def test_results_and_errors(db):
    r = db.sql("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c')) AS t(i, s) ORDER BY i")
    assert (r.columns, r.row_count, len(r), r.is_command, r.status) == (["i", "s"], 3, 3, False, "SELECT 3")
    assert r.fetchone() == (1, "a") and r.fetchmany(1) == [(2, "b")] and list(r) == [(3, "c")] and r.fetchone() is None
    c = db.sql("CREATE TABLE t(v INT)")
    assert c.is_command and c.command_tag == "CREATE TABLE" and c.affected_rows is None
    assert db.sql("INSERT INTO t VALUES (1)").status == "INSERT 1"
    for sql, kind in (("SELECT 1; SELECT 2", E.ProgrammingError), ("BEGIN", E.ProgrammingError), ("SELEC 1", E.NotSupportedError), ("SELECT nope FROM t", E.BinderError), ("SELECT * FROM nope", E.BinderError), ("SELECT FROM WHERE", E.DatabaseError), ("SELECT '\0'", E.ParserError), ("DROP TABLE nope", E.BinderError), ("INSERT INTO t(v) VALUES (1)", E.NotSupportedError)):
        with pytest.raises(kind):
            db.sql(sql)
    with pytest.raises(E.BinderError, match="statement 2"):
        db.execute_script("SELECT 1; SELECT nope FROM t; SELECT 3")
    db.sql("DROP TABLE IF EXISTS nope, t")
    assert db.get_tables() == []


@pytest.mark.parametrize("mode", ["binder", "planner", "optimizer", "schema", "physical", "pipelines", "analyze"])
def test_explain(db, mode):
    db.execute_script("CREATE TABLE t(v INT); INSERT INTO t VALUES (1)")
    assert db.explain("SELECT v FROM t WHERE v > 0", mode=mode)
    assert db.sql(f"EXPLAIN ({mode}) SELECT v FROM t").row_count > 0


def test_threads(db):
    db.execute_script("CREATE TABLE t(v INT); INSERT INTO t VALUES (1), (2)")
    out = []
    ts = [threading.Thread(target=lambda: out.append(db.sql("SELECT sum(v) FROM t").tuples())) for _ in range(4)]
    [t.start() for t in ts], [t.join() for t in ts]
    assert out == [[(3,)]] * 4


def test_shell_flags(capsys, tmp_path):
    from brindle.__main__ import main

    assert main(["--db", str(tmp_path / "d"), "--frames", "9", "--morsel-pages", "4", "--morsel-size", "100", "--unknown", "-c", "SELECT name FROM city ORDER BY id LIMIT 1"]) == 0
    assert "Oslo" in capsys.readouterr().out
    assert main(["-m", "--no-seed", "--test-protocol", "-c", "SELECT 1, NULL, 'x'"]) == 0
    assert capsys.readouterr().out == "1\tNULL\tx\nok\n"
    assert main(["-m", "--no-seed", "--test-protocol", "-c", "SELECT * FROM city"]) == 1
    assert capsys.readouterr().out == "error BinderError\n"


def test_writers_in_threads(db):
    db.execute_script("CREATE TABLE t(id INT PRIMARY KEY, v INT); INSERT INTO t VALUES (1, 0), (2, 0), (3, 0)")
    done, lost = [], []

    def work(i):
        for sql in (f"INSERT INTO t VALUES ({10 + i}, {i})", f"UPDATE t SET v = v + 1 WHERE id = {i % 3 + 1}"):
            for _ in range(20):
                try:
                    done.append(db.sql(sql).affected_rows)
                    break
                except E.ConflictError:
                    lost.append(sql)

    ts = [threading.Thread(target=work, args=(i,)) for i in range(4)]
    [t.start() for t in ts], [t.join() for t in ts]
    assert done == [1] * 8
    assert db.sql("SELECT sum(v) FROM t WHERE id < 10").tuples() == [(4,)] and db.sql("SELECT count(*) FROM t").tuples() == [(7,)]


def test_large_results_in_time(db):
    db.sql("CREATE TABLE t(id BIGINT PRIMARY KEY, s VARCHAR)")
    db.sql("INSERT INTO t SELECT id, concat('row ', id) FROM range(75000)")
    began = time.monotonic()
    r = db.sql("SELECT * FROM t")
    assert time.monotonic() - began < 15
    began = time.monotonic()
    assert len(r.tuples()) == 75_000 and len(r.to_df()) == 75_000 and time.monotonic() - began < 15
    began = time.monotonic()
    assert sum(len(r) for _ in range(100_000)) and time.monotonic() - began < 3


def test_commits_over_several_tables_survive_a_crash(spark, tmp_path, monkeypatch):
    from brindle.tables.manifest import ManifestLog

    with Database(tmp_path / "d", spark=spark) as d:
        d.execute_script("CREATE TABLE a(id INT PRIMARY KEY); CREATE TABLE b(id INT PRIMARY KEY); INSERT INTO a VALUES (1); INSERT INTO b VALUES (1)")
        c, real, puts = d.connect(), ManifestLog.commit, []

        def dies(log, version, content):
            puts.append(version)
            if len(puts) == 2:
                raise OSError("gone")
            real(log, version, content)

        c.begin()
        c.execute_script("INSERT INTO a VALUES (2); INSERT INTO b VALUES (2)")
        monkeypatch.setattr(ManifestLog, "commit", dies)
        with pytest.raises(OSError):
            c.commit()
        monkeypatch.undo()
    with Database(tmp_path / "d", spark=spark) as d:
        assert rows(d.sql("SELECT a.id FROM a, b WHERE a.id = b.id")) == [(1,), (2,)]


def test_two_databases_on_one_folder(spark, tmp_path):
    with Database(tmp_path / "d", spark=spark) as one:
        one.execute_script("CREATE TABLE t(id INT PRIMARY KEY); INSERT INTO t VALUES (1)")
        with Database(tmp_path / "d", spark=spark) as two:
            a, b = one.connect(), two.connect()
            a.begin(), b.begin()
            a.sql("INSERT INTO t VALUES (2)"), b.sql("INSERT INTO t VALUES (2)")
            a.commit()
            with pytest.raises(E.ConflictError):
                b.commit()
            assert two.sql("SELECT count(*) FROM t").tuples() == [(2,)]
