"""Managed tables: versions of Parquet files, rows with an identity, changes as deltas that commit by copy-on-write.

Each data row carries ``__rid``, a number that never comes back. A transaction's changes to a table are two sets of
files: the rids it touched (updated or deleted) and the rows it wrote. Committing puts them onto the newest version:
files that hold touched rids are rewritten without them, the written rows are added, and the touched rids are kept as
that version's change set, against which later commits of concurrent transactions are checked.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.errors import ConflictError
from brindle.tables.base import TableDef, from_files, touched_files, with_file, write_files
from brindle.tables.manifest import ManifestLog

RID = "__rid"
#: Files of fewer bytes are merged by the next commit when there are so many.
SMALL, MANY = 1 << 20, 32
_RIDS = T.StructType([T.StructField(RID, T.LongType())])


class ManagedTable:
    def __init__(self, spark: SparkSession, table: TableDef):
        self.spark, self.table, self.log = spark, table, ManifestLog(table.location)
        self.schema = T.StructType([*table.schema.fields, T.StructField(RID, T.LongType())])

    @classmethod
    def create(cls, spark: SparkSession, table: TableDef) -> ManagedTable:
        out = cls(spark, table)
        out.log.commit(0, {"files": [], "changes": [], "next": 0})
        return out

    def manifest(self, version: int | None = None) -> dict:
        return self.log.read(version)

    def scan(self, version: int) -> DataFrame:
        """All rows of a version, with their rids."""
        return from_files(self.spark, self.schema, self.manifest(version)["files"])

    def changes(self, version: int) -> DataFrame:
        """Rids that a version's commit touched."""
        return from_files(self.spark, _RIDS, self.manifest(version)["changes"])

    def prepared(self, delta: Delta) -> tuple[int, dict]:
        """The version and the manifest that put a delta onto the newest version, with all their files written;
        ConflictError if a later commit touched one of its rows."""
        latest = self.log.latest()
        self.check(delta, latest)
        m = self.manifest(latest)
        files, touched = m["files"], delta.touched_frame(self)
        if delta.touched and files:
            low, high = touched.agg(F.min(RID), F.max(RID)).first()
            near = with_file(from_files(self.spark, self.schema, files)).filter(F.col(RID).between(low, high))  # by row group statistics
            hit = touched_files(near.join(touched, RID, "left_semi"))
            if hit:
                rest = from_files(self.spark, self.schema, hit).join(touched, RID, "left_anti")
                files = [f for f in files if f not in hit] + write_files(rest, self.table.location)
        small = [f for f in files if os.path.getsize(f) < SMALL]
        if len(small) >= MANY:
            files = [f for f in files if f not in small] + write_files(from_files(self.spark, self.schema, small).coalesce(1), self.table.location)
        return latest + 1, {"files": files + delta.rows, "changes": delta.touched, "next": max(m["next"], delta.next)}

    def check(self, delta: Delta, latest: int) -> None:
        """ConflictError if a version after the delta's touched what it touched."""
        if delta.touched:
            for v in range(delta.version + 1, latest + 1):
                if self.manifest(v)["changes"] and not self.changes(v).join(delta.touched_frame(self), RID, "left_semi").isEmpty():
                    raise ConflictError(f"a row of {self.table.name} was changed by a transaction that committed first")

    def vacuum(self, keep: set[int]) -> int:
        """Removes files that neither the newest version nor one of ``keep`` names."""
        versions = {self.log.latest(), *keep} & set(self.log.versions())
        live = {f for v in versions for k in ("files", "changes") for f in self.manifest(v)[k]}
        gone = 0
        for folder, _, names in os.walk(self.table.location, topdown=False):
            for n in names:
                path = os.path.join(folder, n)
                if n.endswith(".parquet") and path not in live:
                    os.unlink(path)
                    gone += 1
        self.log.drop_before(min(versions))
        return gone


class Delta:
    """What a transaction did to one table since ``version``: files of touched rids and of rows written."""

    def __init__(self, table: ManagedTable, version: int):
        self.version, self.touched, self.rows = version, [], []
        self.next = table.manifest(version)["next"]

    def touched_frame(self, table: ManagedTable) -> DataFrame:
        return from_files(table.spark, _RIDS, self.touched)

    def view(self, table: ManagedTable) -> DataFrame:
        """The table as the transaction sees it, with rids."""
        base = table.scan(self.version)
        if self.touched:
            base = base.join(self.touched_frame(table), RID, "left_anti").select(*[f.name for f in table.schema.fields])
        return base.union(from_files(table.spark, table.schema, self.rows)) if self.rows else base

    def copy(self, table: ManagedTable) -> Delta:
        out = Delta.__new__(Delta)
        out.version, out.touched, out.rows, out.next = self.version, list(self.touched), list(self.rows), self.next
        return out

    def insert(self, table: ManagedTable, rows: DataFrame) -> int:
        """Adds rows (the user columns), numbering them in their order; returns how many."""
        n, numbered = number(rows, self.next, table)
        if table.table.auto_id:
            numbered = numbered.withColumn("_id", F.col(RID))
        self.rows = self.rows + write_files(numbered.select(*[f.name for f in table.schema.fields]), table.table.location) if n else self.rows
        self.next += n
        return n

    def replace(self, table: ManagedTable, hits: DataFrame, update: bool) -> int:
        """Takes ``hits`` (changed rows with their rids) out of the view and, on update, puts them in again as they are;
        returns how many. They are evaluated once."""
        names = [f"`{f.name}`" for f in table.schema.fields]
        rows = write_files(hits.select(*names), table.table.location) if update else []
        rids = from_files(table.spark, table.schema, rows) if update else hits
        rids = write_files(rids.select(RID), table.table.location)
        gone = from_files(table.spark, _RIDS, rids)
        n = gone.count()
        if n == 0:
            return 0
        if self.rows:
            rest = from_files(table.spark, table.schema, self.rows).join(gone, RID, "left_anti").select(*names)
            self.rows = write_files(rest, table.table.location)
        self.touched, self.rows = self.touched + rids, self.rows + rows
        return n


def number(rows: DataFrame, start: int, table: ManagedTable) -> tuple[int, DataFrame]:
    """Rows with rids start, start + 1, ... in their order. Written once, so that numbers and rows stay together."""
    spark = rows.sparkSession
    path = os.path.join(table.table.location, f"staged-{uuid.uuid4().hex}")
    rows.withColumn(RID, F.monotonically_increasing_id()).write.parquet(path)
    staged = spark.read.parquet(path)
    part = F.shiftright(F.col(RID), 33)
    counts = staged.groupBy(part.alias("p")).count().orderBy("p").collect()  # one row a partition
    offsets, n = [], 0
    for r in counts:
        offsets.append((r.p, start + n))
        n += r["count"]
    base = spark.createDataFrame(offsets, "p long, base long")
    out = staged.withColumn("p", part).join(F.broadcast(base), "p").withColumn(RID, F.col("base") + F.col(RID).bitwiseAND((1 << 33) - 1))
    return n, out.drop("p", "base")
