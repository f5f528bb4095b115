"""Parquet folders as tables: a manifest of live files, appended to and rewritten file by file."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.errors import BinderError
from brindle.tables.base import TableDef, from_files, touched_files, write_files
from brindle.tables.manifest import ManifestLog


def _ntz(schema: T.StructType) -> T.StructType:
    """Timestamps carry no time zone here."""
    return T.StructType([T.StructField(f.name, T.TimestampNTZType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in schema.fields])


class ExternalTable:
    """Every change writes new files, then the next manifest; readers hold the file list of the version they began with."""

    def __init__(self, spark: SparkSession, table: TableDef):
        self.spark, self.table, self.log = spark, table, ManifestLog(table.location)

    @classmethod
    def create(cls, spark: SparkSession, name: str, location: str, columns: list[tuple[str, T.DataType, dict]]) -> ExternalTable:
        """Adopts the folder's files as version 0, checking all against the declared or first file's schema."""
        location = os.path.abspath(location)
        os.makedirs(location, exist_ok=True)
        log = ManifestLog(location)
        files = sorted(os.path.join(location, f) for f in os.listdir(location) if f.endswith(".parquet"))
        if log.latest() >= 0:
            files = [os.path.join(location, f) for f in log.read()["files"]]
        if columns:
            schema = T.StructType([T.StructField(n, t) for n, t, _ in columns])
        elif files:
            schema = _ntz(spark.read.parquet(files[0]).schema)
        else:
            raise BinderError(f"{name}: no columns are declared and {location} holds no Parquet file")
        for f in schema.fields:
            if isinstance(f.dataType, (T.StructType, T.MapType)):
                raise BinderError(f"{name}: nested column {f.name}")
        for path in files:
            found = _ntz(spark.read.parquet(path).schema)
            same = [(f.name.lower(), f.dataType) for f in found.fields] == [(f.name.lower(), f.dataType) for f in schema.fields]
            if not same:
                raise BinderError(f"{name}: {os.path.basename(path)} has columns {found.simpleString()}, not {schema.simpleString()}")
        if log.latest() < 0:
            log.commit(0, {"files": [os.path.relpath(f, location) for f in files]})
        table = TableDef(name, schema, {n: k for n, _, k in columns if k}, [], False, True, location)
        return cls(spark, table)

    def files(self, version: int | None = None) -> list[str]:
        return [os.path.join(self.table.location, f) for f in self.log.read(version)["files"]]

    def read(self, version: int | None = None) -> DataFrame:
        return from_files(self.spark, self.table.schema, self.files(version))

    def _commit(self, version: int, files: list[str]) -> None:
        self.log.commit(version + 1, {"files": [os.path.relpath(f, self.table.location) for f in files]})

    def append(self, rows: DataFrame) -> int:
        """Adds rows, which are evaluated once; returns how many."""
        version = self.log.latest()
        new = write_files(rows, self.table.location)
        n = from_files(self.spark, self.table.schema, new).count()
        if n:
            self._commit(version, self.files(version) + new)
        return n

    def rewrite(self, version: int, hits: DataFrame, update: bool) -> int:
        """Takes ``hits`` (changed rows with their places __file and __row) out and, on update, puts them in again as they
        are; returns how many. They are evaluated once; only files that they come from are read and written again."""
        schema = T.StructType([*(self.table.schema.fields if update else []), T.StructField("__file", T.StringType()), T.StructField("__row", T.LongType())])
        staged = write_files(hits.select(*[F.col(f"`{n}`") for n in schema.names]), os.path.join(self.table.location, "_staged"))
        changed = from_files(self.spark, schema, staged)
        n = changed.count()
        if n:
            touched, files = touched_files(changed), self.files(version)
            kept = [f for f in files if f not in touched]
            if len(kept) + len(touched) != len(files):
                raise BinderError(f"{self.table.name}: a touched file is not in the manifest")
            old = from_files(self.spark, self.table.schema, touched).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
            rows = old.join(changed.select("__file", "__row"), ["__file", "__row"], "left_anti").select(*[F.col(f"`{c}`") for c in self.table.schema.names])
            if update:
                rows = rows.union(changed.select(*[F.col(f"`{c}`") for c in self.table.schema.names]))
            self._commit(version, kept + write_files(rows, self.table.location))
        shutil.rmtree(os.path.dirname(staged[0]) if staged else "", ignore_errors=True)
        return n

    def vacuum(self) -> int:
        """Removes data files that the newest manifest doesn't name, and older manifests; returns how many files."""
        live, gone = set(self.files()), 0
        for folder, _, names in os.walk(self.table.location, topdown=False):
            for n in names:
                path = os.path.join(folder, n)
                if n.endswith(".parquet") and path not in live:
                    os.unlink(path)
                    gone += 1
                elif folder != self.table.location and (n.startswith("_SUCCESS") or n.endswith(".crc")):
                    os.unlink(path)
            if folder != self.table.location and not os.listdir(folder):
                os.rmdir(folder)
        self.log.drop_before(self.log.latest())
        return gone

