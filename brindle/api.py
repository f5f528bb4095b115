"""The Python interface: databases, connections, transactions."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import shutil
import tempfile
import threading
import time
import uuid
from pathlib import Path

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle import dialect
from brindle.analysis import run_query
from brindle.errors import BinderError, ConflictError, DatabaseClosedError, DatabaseError, DataError, ExecutionError, NotSupportedError, ParserError, ProgrammingError
from brindle.result import Result
from brindle.session import SEMANTICS, build_session
from brindle.sources.frames import to_spark
from brindle.tables.base import TableDef, assigned, fit, from_files
from brindle.tables.external import ExternalTable
from brindle.tables.managed import RID, Delta, ManagedTable
from brindle.tables.manifest import ManifestLog

MODES = ("binder", "planner", "optimizer", "schema", "physical", "pipelines", "analyze")


class Transaction:
    """Versions pinned at the start, one delta for each table written, and what a serializable one has read."""

    def __init__(self, database: Database, isolation: str, explicit: bool):
        if isolation not in ("snapshot", "serializable"):
            raise ProgrammingError(f"unknown isolation {isolation!r}")
        self.database, self.isolation, self.explicit, self.began = database, isolation, explicit, time.monotonic()
        with database.exclusive(fcntl.LOCK_SH):
            self.pinned = {n: database.latest(n) for n, t in database.tables.items()}
            database.active.add(self)
        self.deltas: dict[str, Delta] = {}
        #: What a serializable transaction has scanned: tables, and of a changed one the condition, None for all rows.
        self.reads: list[tuple[str, tuple[dialect.Token, ...] | None]] = []

    def end(self) -> None:
        self.database.active.discard(self)


class Connection:
    """One session. Statements outside a transaction commit by themselves."""

    def __init__(self, database: Database):
        self._db, self._closed, self._txn = database, False, None
        self.spark: SparkSession = database.spark.newSession()
        for k, v in SEMANTICS.items():
            self.spark.conf.set(k, v)

    # state

    @property
    def closed(self) -> bool:
        return self._closed or self._db.closed

    @property
    def in_transaction(self) -> bool:
        return self._txn is not None

    def _open(self) -> None:
        if self.closed:
            raise DatabaseClosedError("the connection is closed")

    def close(self) -> None:
        if self._txn:
            self.rollback()
        self._closed = True

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind, value, trace) -> None:
        self.close()

    # statements

    def sql(self, query: str) -> Result:
        """Runs exactly one statement."""
        self._open()
        statements = dialect.split_script(_text(query))
        if len(statements) != 1:
            raise ProgrammingError(f"sql takes one statement, not {len(statements)}")
        return self._run(statements[0])

    def query(self, query: str) -> DataFrame:
        """The DataFrame of a SELECT, to be used while this connection's tables aren't vacuumed."""
        self._open()
        statements = dialect.split_script(_text(query))
        if len(statements) != 1 or dialect.parse(statements[0]).kind != "query":
            raise ProgrammingError("query takes one SELECT")
        with self._statement() as txn:
            return self._select(txn, statements[0])

    def execute_script(self, script: str) -> list[Result]:
        self._open()
        out = []
        for i, s in enumerate(dialect.split_script(_text(script)), 1):
            try:
                out.append(self._run(s))
            except DatabaseError as e:
                raise type(e)(f"statement {i}: {e}") from e
        return out

    def run_file(self, path: str | os.PathLike) -> list[Result]:
        return self.execute_script(Path(path).read_text())

    def explain(self, query: str, *, mode: str = "physical") -> str:
        self._open()
        if mode not in MODES:
            raise ProgrammingError(f"unknown mode {mode!r}")
        statements = dialect.split_script(_text(query))
        if len(statements) != 1:
            raise ProgrammingError("explain takes one statement")
        return self._explain(statements[0], [mode])

    def _run(self, toks: list[dialect.Token]) -> Result:
        s = dialect.parse(toks)
        if s.kind == "begin":
            self.begin()
            return Result("BEGIN")
        if s.kind in ("commit", "rollback"):
            getattr(self, s.kind)()
            return Result(s.kind.upper())
        if s.kind == "explain":
            text = self._explain(s.body, s.names or ["physical"])
            return Result("EXPLAIN", T.StructType([T.StructField("plan", T.StringType())]), [(line,) for line in text.splitlines()])
        if s.kind in ("create", "drop"):
            if self._txn:
                raise NotSupportedError("tables are neither created nor dropped inside a transaction")
            return self._create(s) if s.kind == "create" else self._drop(s)
        with self._statement() as txn:
            if s.kind == "query":
                return Result.of(self._select(txn, toks))
            table = self._db.find(s.table)
            if table.external:
                if self._txn:
                    raise NotSupportedError("external tables are not written inside a transaction")
                n = self._change_external(txn, table, s)
            else:
                n = self._change(txn, table, s)
            return Result(s.kind.upper(), affected=n)

    @contextlib.contextmanager
    def _statement(self):
        """The current transaction, or one for this statement alone; a failure aborts either."""
        own = self._txn is None
        txn = self._txn or Transaction(self._db, "snapshot", False)
        if not own and txn not in self._db.active:
            self._txn = None
            raise ConflictError("the transaction was ended for its age")
        try:
            yield txn
            if own:
                self._db.commit(txn, self.spark)
        except BaseException as e:
            self._txn = None
            txn.end()
            if isinstance(e, ParseException):
                raise ParserError(_first(e)) from e
            if isinstance(e, AnalysisException):
                raise BinderError(_first(e)) from e
            if isinstance(e, (DatabaseError, ProgrammingError, DataError, KeyboardInterrupt)):
                raise
            raise ExecutionError(_first(e)) from e
        finally:
            if own:
                txn.end()

    # transactions

    def begin(self, isolation: str = "snapshot") -> None:
        self._open()
        if self._txn:
            raise NotSupportedError("a transaction is open already")
        self._txn = Transaction(self._db, isolation, True)

    def commit(self) -> None:
        self._open()
        txn = self._need()
        self._txn = None
        try:
            if txn not in self._db.active:
                raise ConflictError("the transaction was ended for its age")
            self._db.commit(txn, self.spark)
        finally:
            txn.end()

    def rollback(self) -> None:
        self._open()
        self._need().end()
        self._txn = None

    def _need(self) -> Transaction:
        if not self._txn:
            raise ExecutionError("no transaction is open")
        return self._txn

    @contextlib.contextmanager
    def transaction(self, isolation: str = "snapshot"):
        """Commits at the end of the block, rolls back on an exception."""
        self.begin(isolation)
        try:
            yield self
        except BaseException:
            if self._txn:
                self.rollback()
            raise
        if self._txn:
            self.commit()

    # reading

    def _view(self, txn: Transaction, table: TableDef) -> DataFrame:
        """Rows as txn sees them; managed ones with their rids, external ones with their place."""
        if table.external:
            ext = ExternalTable(self.spark, table)
            version = txn.pinned.get(table.name.lower(), ext.log.latest()) if txn.explicit else ext.log.latest()
            files = ext.files(version)
            if not files:
                return from_files(self.spark, table.schema, []).withColumns({"__file": F.lit(""), "__row": F.lit(0)})
            return ext.read(version).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        managed = ManagedTable(self.spark, table)
        delta = txn.deltas.get(table.name.lower()) or Delta(managed, txn.pinned[table.name.lower()])
        return delta.view(managed)

    def _register(self, txn: Transaction, toks: list[dialect.Token], hidden: str = "") -> None:
        """Puts every table that the tokens may read in reach, as views; that named hidden with its rows' places."""
        names = dialect.referenced(toks)
        for key, table in list(self._db.tables.items()):
            if key not in names and key != hidden:
                continue
            if key not in txn.pinned:
                continue  # created after the snapshot
            view = self._view(txn, table)
            if key != hidden:
                view = view.select(*[F.col(f"`{n}`") for n in table.schema.names])
            view.createOrReplaceTempView(f"`{table.name}`")
            if txn.isolation == "serializable" and not table.external and key in names:
                txn.reads.append((key, None))
        for view in self.spark.catalog.listTables():
            if view.isTemporary and view.name.lower() not in self._db.tables:
                self.spark.catalog.dropTempView(view.name)

    def _select(self, txn: Transaction, toks: list[dialect.Token]) -> DataFrame:
        self._register(txn, toks)
        return run_query(self.spark, toks)

    def _explain(self, toks: list[dialect.Token], modes: list[str]) -> str:
        for m in modes:
            if m not in MODES:
                raise ParserError(f"unknown EXPLAIN mode {m}")
        kind = dialect.parse(toks)
        if kind.kind != "query":
            toks = [*dialect.tokens("SELECT * FROM"), dialect.quoted(kind.table), *([*dialect.tokens("WHERE"), *kind.where] if kind.where else [])] if kind.kind in ("update", "delete") else kind.body
        with self._statement() as txn:
            df = self._select(txn, toks)
            q = df._jdf.queryExecution()
            parts = []
            for m in modes:
                if m == "binder":
                    parts.append(q.logical().toString())
                elif m == "planner":
                    parts.append(q.analyzed().toString())
                elif m == "optimizer":
                    parts.append(q.optimizedPlan().toString())
                elif m == "schema":
                    parts.append(df._jdf.schema().treeString())
                elif m == "physical":
                    parts.append(q.explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
                elif m == "pipelines":
                    parts.append(q.explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")))
                else:
                    began = time.perf_counter()
                    n = df.count()
                    parts.append(f"{q.executedPlan().toString()}\nrows: {n}\nseconds: {time.perf_counter() - began:.3f}")
            return "\n".join(parts)

    # writing

    def _rows(self, txn: Transaction, table: TableDef, s: dialect.Statement) -> DataFrame:
        return fit(self._select(txn, s.body), table, table.user_columns)

    def _target(self, txn: Transaction, table: TableDef, s: dialect.Statement) -> DataFrame:
        """The rows that WHERE matches, with their places and with SET applied."""
        key = table.name.lower()
        toks = [*s.where, *[t for _, e in s.sets for t in e]]
        self._register(txn, toks, hidden=key)
        if txn.isolation == "serializable" and not table.external and key not in dialect.referenced(toks):
            txn.reads.append((key, None if "select" in dialect.referenced(s.where) else tuple(s.where)))
        sets: dict[str, list[dialect.Token]] = {}
        for column, e in s.sets:
            f = next((f for f in table.schema.fields if f.name.lower() == column.lower()), None)
            if f is None:
                raise BinderError(f"{table.name} has no column {column}")
            if f.name in sets:
                raise BinderError(f"column {column} is set twice")
            sets[f.name] = e
        listed = [t for c, e in sets.items() for t in [*dialect.tokens(", ("), *e, *dialect.tokens(f') AS "__set_{c}"')]]
        where = [*dialect.tokens("WHERE"), *s.where] if s.where else []
        new = run_query(self.spark, [*dialect.tokens("SELECT *"), *listed, *dialect.tokens("FROM"), dialect.quoted(table.name), *where])
        for c in sets:
            f = table.schema[c]
            new = new.withColumn(c, assigned(F.col(f"`__set_{c}`"), new.schema[f"__set_{c}"].dataType, f, table.notes.get(c, {})))
        return new.drop(*[f"__set_{c}" for c in sets])

    def _change(self, txn: Transaction, table: TableDef, s: dialect.Statement) -> int:
        managed, key = ManagedTable(self.spark, table), table.name.lower()
        if key not in txn.pinned:
            raise BinderError(f"{table.name} was created after this transaction began")
        delta = txn.deltas[key].copy(managed) if key in txn.deltas else Delta(managed, txn.pinned[key])
        if s.kind == "insert":
            n = delta.insert(managed, self._rows(txn, table, s))
        else:
            n = delta.replace(managed, self._target(txn, table, s), s.kind == "update")
        if s.kind == "insert" or {c.lower() for c, _ in s.sets} & {c.lower() for c in table.primary_key}:
            self._db.check_keys(managed, delta, None)
        self._db.check_writes(txn, managed, delta)
        txn.deltas[key] = delta
        return n

    def _change_external(self, txn: Transaction, table: TableDef, s: dialect.Statement) -> int:
        ext = ExternalTable(self.spark, table)
        if s.kind == "insert":
            return ext.append(self._rows(txn, table, s))
        version = ext.log.latest()
        return ext.rewrite(version, self._target(txn, table, s), s.kind == "update")

    # tables

    def _create(self, s: dialect.Statement) -> Result:
        self._db.create(self.spark, s)
        return Result("CREATE TABLE")

    def _drop(self, s: dialect.Statement) -> Result:
        for n in s.names:
            if not self.remove_table(n, if_exists=s.if_exists) and not s.if_exists:
                raise BinderError(f"no table {n}")
        return Result("DROP TABLE")

    def get_tables(self) -> list[dict]:
        self._open()
        return [t.describe() for _, t in sorted(self._db.tables.items())]

    def describe_table(self, name: str) -> dict:
        self._open()
        return self._db.find(name).describe()

    def get_table(self, name: str) -> Result:
        self._db.find(name)
        return self.sql("SELECT * FROM " + dialect.quoted(name).text)

    def remove_table(self, name: str, *, if_exists: bool = False) -> bool:
        self._open()
        if self._txn:
            raise NotSupportedError("tables are not dropped inside a transaction")
        return self._db.drop(name, if_exists)

    def vacuum(self, name: str) -> int:
        """Files removed from an external table's folder."""
        self._open()
        table = self._db.find(name)
        if not table.external:
            raise NotSupportedError("vacuum takes an external table; collect_garbage tends the others")
        return ExternalTable(self.spark, table).vacuum()

    def collect_garbage(self) -> dict:
        self._open()
        return self._db.collect_garbage()


def _text(x: str) -> str:
    if not isinstance(x, str):
        raise ProgrammingError("a statement is a string")
    return x


def _first(e: BaseException) -> str:
    return next((line for line in str(e).splitlines() if line.strip()), type(e).__name__)


class Database:
    """A catalogue of tables under one folder, which is temporary if none is named."""

    def __init__(self, path: str | os.PathLike | None = None, *, worker_threads: int = 0, max_memory: int | None = None, frames: int | None = None, morsel_pages: int | None = None, transaction_timeout: float | None = None, prefer_external: bool = False, spark: SparkSession | None = None):
        """worker_threads and max_memory size a session that isn't there yet; frames, morsel_pages and prefer_external
        are taken for compatibility, Spark settles what they would."""
        conf = {"spark.driver.memory": f"{max(512, max_memory >> 20)}m"} if max_memory else None
        self.spark = spark or SparkSession.getActiveSession() or build_session(master=f"local[{worker_threads or '*'}]", conf=conf)
        self._temporary = path is None
        self.path = os.path.abspath(path or tempfile.mkdtemp(prefix="brindle-db"))
        os.makedirs(f"{self.path}/tables", exist_ok=True)
        self.lock, self.active, self.closed = threading.RLock(), set(), False
        self.timeout = 7200.0 if transaction_timeout is None else transaction_timeout
        self._began = time.monotonic()
        self.tables: dict[str, TableDef] = {}
        if os.path.exists(f"{self.path}/catalog.json"):
            with open(f"{self.path}/catalog.json") as f:
                self.tables = {d["name"].lower(): TableDef.from_json(d) for d in json.load(f)}

    # catalogue

    def _save(self) -> None:
        temp = f"{self.path}/.catalog-{uuid.uuid4().hex}"
        with open(temp, "w") as f:
            json.dump([t.to_json() for t in self.tables.values()], f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, f"{self.path}/catalog.json")

    def find(self, name: str) -> TableDef:
        if name.lower() not in self.tables:
            raise BinderError(f"no table {name}")
        return self.tables[name.lower()]

    def latest(self, key: str) -> int:
        t = self.tables[key]
        return (ExternalTable(self.spark, t) if t.external else ManagedTable(self.spark, t)).log.latest()

    def create(self, spark: SparkSession, s: dialect.Statement) -> TableDef:
        with self.lock:
            if s.table.lower() in self.tables:
                raise BinderError(f"table {s.table} is there already")
            lower = [n.lower() for n, _, _ in s.columns]
            if len(set(lower)) < len(lower):
                raise BinderError("two columns of one name")
            if any(n.startswith("__") for n in lower):
                raise BinderError("column names don't begin with two underscores")
            options = dict(s.options)
            kind, location = options.pop("format", "").lower(), options.pop("location", None)
            if options or (s.options and (kind != "parquet" or not location)):
                raise NotSupportedError("WITH takes format='parquet' and location")
            if s.options:
                if s.primary_key:
                    raise NotSupportedError("external tables have no primary key")
                table = ExternalTable.create(spark, s.table, location, s.columns).table
            else:
                table = self._managed(spark, s.table, s.columns, s.primary_key)
            self.tables[s.table.lower()] = table
            self._save()
            return table

    def _managed(self, spark: SparkSession, name: str, columns: list, key: list[str]) -> TableDef:
        if not columns:
            raise BinderError("a table takes columns")
        by = {n.lower(): n for n, _, _ in columns}
        if "_id" in by:
            raise BinderError("_id is reserved")
        for k in key:
            if k.lower() not in by:
                raise BinderError(f"no column {k} for the primary key")
        if len({k.lower() for k in key}) < len(key):
            raise BinderError("a column is twice in the primary key")
        fields = [T.StructField(n, t) for n, t, _ in columns]
        if not key:
            fields = [T.StructField("_id", T.LongType()), *fields]
        table = TableDef(name, T.StructType(fields), {n: k for n, _, k in columns if k}, [by[k.lower()] for k in key] or ["_id"], not key, False, f"{self.path}/tables/{uuid.uuid4().hex}")
        ManagedTable.create(spark, table)
        return table

    def drop(self, name: str, if_exists: bool) -> bool:
        with self.lock:
            if name.lower() not in self.tables:
                if if_exists:
                    return False
                raise BinderError(f"no table {name}")
            table = self.tables.pop(name.lower())
            self._save()
            if not table.external:
                shutil.rmtree(table.location, ignore_errors=True)
            return True

    # commits

    def check_keys(self, table: ManagedTable, delta: Delta, base: DataFrame | None) -> None:
        """ConflictError if rows written by delta share a primary key with each other or with other rows in sight."""
        if not delta.rows or table.table.auto_id:
            return
        key = [F.col(f"`{k}`") for k in table.table.primary_key]
        names = table.table.primary_key
        rows = from_files(table.spark, table.schema, delta.rows)
        if not rows.groupBy(*key).count().filter("count > 1").filter(" AND ".join(f"`{k}` IS NOT NULL" for k in names)).isEmpty():
            raise ConflictError(f"a primary key of {table.table.name} is there twice")
        if base is None:
            base = table.scan(delta.version)
            if delta.touched:
                base = base.join(delta.touched_frame(table), RID, "left_anti")
        ends = rows.agg(*[f(k) for k in key for f in (F.min, F.max)]).first()
        for k, low, high in zip(key, ends[::2], ends[1::2], strict=True):
            if low is not None:
                base = base.filter(k.between(low, high))  # by row group statistics
        if not base.select(*key).join(rows.select(*key), names, "left_semi").isEmpty():
            raise ConflictError(f"a primary key of {table.table.name} is there already")

    def check_writes(self, txn: Transaction, table: ManagedTable, delta: Delta) -> None:
        """ConflictError if a later commit or an open transaction has written what delta writes."""
        table.check(delta, table.log.latest())
        mine = delta.touched_frame(table) if delta.touched else None
        names = table.table.primary_key
        for other in list(self.active):
            theirs = other.deltas.get(table.table.name.lower())
            if other is txn or theirs is None:
                continue
            if mine is not None and theirs.touched and not mine.join(theirs.touched_frame(table), RID, "left_semi").isEmpty():
                raise ConflictError(f"a row of {table.table.name} is being changed by another transaction")
            if delta.rows and theirs.rows and not table.table.auto_id:
                a, b = (from_files(table.spark, table.schema, d.rows).select(*[f"`{n}`" for n in names]) for d in (delta, theirs))
                if not a.join(b, names, "left_semi").isEmpty():
                    raise ConflictError(f"a primary key of {table.table.name} is being written by another transaction")
        latest = table.log.latest()
        if latest > delta.version and delta.rows and not table.table.auto_id:
            base = table.scan(latest)
            if mine is not None:
                base = base.join(mine, RID, "left_anti")
            self.check_keys(table, delta, base)

    @contextlib.contextmanager
    def exclusive(self, how: int = fcntl.LOCK_EX):
        """Alone among this process's threads and, by a lock on a file, among processes; with LOCK_SH, next to others
        that only look. What a process that died had decided to commit is there first."""
        with self.lock, open(f"{self.path}/.lock", "w") as f:
            fcntl.flock(f, how)
            if any(n.startswith("commit-") for n in os.listdir(self.path)):
                fcntl.flock(f, fcntl.LOCK_EX)
                for n in sorted(n for n in os.listdir(self.path) if n.startswith("commit-")):
                    self._put(f"{self.path}/{n}")
            yield

    def _put(self, decided: str) -> None:
        """Puts the versions in place that a file names and removes it; those that are there already stay."""
        with open(decided) as f:
            for location, version, content in json.load(f):
                log = ManifestLog(location)
                if os.path.isdir(location) and log.latest() < version:
                    log.commit(version, content)
        os.unlink(decided)

    def commit(self, txn: Transaction, spark: SparkSession) -> None:
        """All of a transaction's deltas, or none: everything is checked and written before one file, put in place by a
        rename, decides. Versions are put in place from that file, after a crash by the next who looks."""
        changed = {k: d for k, d in txn.deltas.items() if d.touched or d.rows}
        if not changed:
            return
        with self.exclusive():
            for k, d in changed.items():
                if k not in self.tables:
                    raise ConflictError(f"table {k} was dropped")
                self.check_writes(txn, ManagedTable(spark, self.tables[k]), d)
            if txn.isolation == "serializable":
                self._validate(txn, spark)
            ready = []
            for k, d in changed.items():
                managed = ManagedTable(spark, self.tables[k])
                latest = managed.manifest()
                if self.tables[k].auto_id and latest["next"] > managed.manifest(d.version)["next"] and d.rows:
                    self._renumber(managed, d, latest["next"])
                ready.append((managed.table.location, *managed.prepared(d)))
            temp = f"{self.path}/.{uuid.uuid4().hex}"
            with open(temp, "w") as f:
                json.dump(ready, f)
                f.flush()
                os.fsync(f.fileno())
            os.rename(temp, decided := f"{self.path}/commit-{uuid.uuid4().hex}")
            self._put(decided)

    def _renumber(self, table: ManagedTable, delta: Delta, start: int) -> None:
        """Moves generated keys of a delta behind those that others committed meanwhile; updated rows keep theirs."""
        first = table.manifest(delta.version)["next"]
        shift = start - first
        rows = from_files(table.spark, table.schema, delta.rows)
        moved = F.when(F.col(RID) >= first, F.col(RID) + shift).otherwise(F.col(RID))
        from brindle.tables.base import write_files

        same = F.col("_id") == F.col(RID)
        rows = rows.withColumn("_id", F.when(same, moved).otherwise(F.col("_id"))).withColumn(RID, moved)
        delta.rows = write_files(rows.select(*table.schema.names), table.table.location)
        delta.next += shift

    def _validate(self, txn: Transaction, spark: SparkSession) -> None:
        """ConflictError if a later commit wrote rows that one of the transaction's scans would have seen, before or after."""
        for key, where in dict.fromkeys(txn.reads):
            if key not in self.tables or key not in txn.pinned:
                continue
            table = ManagedTable(spark, self.tables[key])
            then, latest = txn.pinned[key], table.log.latest()
            if latest == then:
                continue
            old, new = (table.scan(v) for v in (then, latest))
            written = new.join(old.select(RID), RID, "left_anti")
            for v in range(then + 1, latest + 1):
                if table.manifest(v)["changes"]:
                    c = table.changes(v)
                    written = written.unionByName(old.join(c, RID, "left_semi")).unionByName(new.join(c, RID, "left_semi"))
            if where:
                written.createOrReplaceTempView(f"`{table.table.name}`")
                written = run_query(spark, [*dialect.tokens("SELECT * FROM"), dialect.quoted(table.table.name), *dialect.tokens("WHERE"), *where])
            if not written.isEmpty():
                raise ConflictError(f"what was read of {table.table.name} has changed since")

    def collect_garbage(self) -> dict:
        """Ends transactions beyond the timeout and removes files that no transaction can see any more."""
        with self.lock:
            old = [t for t in self.active if time.monotonic() - t.began > self.timeout]
            for t in old:
                t.end()
            files = 0
            if not self.active:
                for table in self.tables.values():
                    if not table.external:
                        files += ManagedTable(self.spark, table).vacuum(set())
            return {"transactions_ended": len(old), "files_removed": files}

    # statements without a connection

    def _once(self):
        if self.closed:
            raise DatabaseClosedError("the database is closed")
        return Connection(self)

    def sql(self, query: str) -> Result:
        """One statement that commits by itself."""
        statements = dialect.split_script(_text(query))
        if len(statements) == 1 and dialect.parse(statements[0]).kind in ("begin", "commit", "rollback"):
            raise ProgrammingError("transactions take a connection")
        with self._once() as c:
            return c.sql(query)

    def connect(self) -> Connection:
        return self._once()

    def execute_script(self, script: str) -> list[Result]:
        with self._once() as c:
            out = c.execute_script(script)
            if c.in_transaction:
                raise ProgrammingError("the script leaves a transaction open")
            return out

    def run_file(self, path: str | os.PathLike) -> list[Result]:
        return self.execute_script(Path(path).read_text())

    def get_tables(self) -> list[dict]:
        with self._once() as c:
            return c.get_tables()

    def describe_table(self, name: str) -> dict:
        with self._once() as c:
            return c.describe_table(name)

    def get_table(self, name: str) -> Result:
        with self._once() as c:
            return c.get_table(name)

    def remove_table(self, name: str, *, if_exists: bool = False) -> bool:
        with self._once() as c:
            return c.remove_table(name, if_exists=if_exists)

    def vacuum(self, name: str) -> int:
        with self._once() as c:
            return c.vacuum(name)

    def explain(self, query: str, *, mode: str = "physical") -> str:
        with self._once() as c:
            return c.explain(query, mode=mode)

    def resource_stats(self) -> dict:
        """What Spark's status tracker and memory manager tell."""
        sc = self.spark.sparkContext
        memory = sc._jsc.sc().getExecutorMemoryStatus()
        return {"worker_slots": sc.defaultParallelism, "executors": memory.size(), "active_jobs": len(sc.statusTracker().getActiveJobsIds()), "active_transactions": len(self.active)}

    def load_df(self, frame, name: str, *, primary_key: str | list[str] | tuple[str, ...] | None = None, if_exists: str = "error", include_index: bool = False) -> None:
        """Loads a pandas or Spark frame into a new table or, with if_exists='append', one of exactly its schema."""
        if if_exists not in ("error", "append", "replace"):
            raise ProgrammingError(f"if_exists is error, append or replace, not {if_exists!r}")
        key = [primary_key] if isinstance(primary_key, str) else list(primary_key or [])
        with self._once() as c:
            df, notes = (frame, {}) if isinstance(frame, DataFrame) else to_spark(c.spark, frame, include_index)
            there = name.lower() in self.tables
            if there and if_exists == "error":
                raise ProgrammingError(f"table {name} is there already")
            for k in key:
                if k not in df.columns:
                    raise DataError(f"no column {k} for the primary key")
                if not df.filter(F.col(f"`{k}`").isNull()).isEmpty():
                    raise DataError(f"primary key {k} holds nulls")
            if there and if_exists == "replace":
                self.drop(name, False)
                there = False
            if not there:
                with self.lock:
                    columns = [(f.name, f.dataType, notes.get(f.name, {})) for f in df.schema.fields]
                    self.tables[name.lower()] = self._managed(c.spark, name, columns, key)
                    self._save()
            table = self.tables[name.lower()]
            try:
                if table.external:
                    raise NotSupportedError("load_df takes a managed table")
                want = [(f.name.lower(), f.dataType) for f in table.user_columns]
                if want != [(f.name.lower(), f.dataType) for f in df.schema.fields]:
                    raise DataError(f"the frame's columns are not those of {name}")
                with c._statement() as txn:
                    managed = ManagedTable(c.spark, table)
                    delta = Delta(managed, txn.pinned[name.lower()])
                    delta.insert(managed, df)
                    self.check_keys(managed, delta, None)
                    self.check_writes(txn, managed, delta)
                    txn.deltas[name.lower()] = delta
            except BaseException:
                if not there:
                    self.drop(name, True)
                raise

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            for t in list(self.active):
                t.end()
            if self._temporary:
                shutil.rmtree(self.path, ignore_errors=True)

    def __enter__(self) -> Database:
        return self

    def __exit__(self, kind, value, trace) -> None:
        self.close()


def db(path: str | os.PathLike | None = None, **options) -> Database:
    """Opens or creates a database."""
    return Database(path, **options)
