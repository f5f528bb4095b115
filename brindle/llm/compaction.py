"""Size-tiered compaction of a sharded table behind a versioned manifest.

Arrivals are appended as small immutable Parquet shards. Shards fall into tiers by size, each FANOUT times the one
below; as soon as a tier holds FANOUT shards they are merged, in order of arrival, into files of the target size.
Merging streams record batches from file to file on the executors, one group of shards a task, without decoding into
rows and without a shuffle; a task writes under a name of its own and renames at the end, so it can be run again.
Every change ends with one new manifest, put in place by an exclusive link or rename: a reader sees the version before
or the version after, and of two writers that began from the same version one fails and changes nothing. Shards that
no manifest since ``keep`` versions names are removed by vacuum.

Defined results: rows come back as they arrived, repeated rows as often, nulls as null; an empty arrival adds its
empty shards and an empty table reads as no rows. Columns may have any names; all arrivals must have one schema.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

FANOUT = 4
#: Bytes that merged files aim at, and bytes under which all shards are of the lowest tier.
TARGET, SMALL = 64 << 20, 1 << 20
#: Bytes in memory that make a row group of a merged file, and rows at most.
GROUP, GROUP_ROWS = 64 << 20, 1 << 20
#: Rows of an appended shard at most.
SHARD_ROWS = 2000


class CommitConflict(RuntimeError):
    """Another writer committed the version that this one wanted to."""


@dataclass(frozen=True)
class Shard:
    name: str
    bytes: int
    rows: int
    born: int


class ShardStore:
    """A table under ``root``: data/ with immutable shards, manifest/ with one file for each version."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, small: int = SMALL, fanout: int = FANOUT):
        self.spark, self.target, self.small, self.fanout = spark, target, small, fanout
        self.root = "file:///" + root[5:].lstrip("/") if root.startswith("file:") else root if "://" in root else "file://" + os.path.abspath(root)
        self.fs, self.base = pafs.FileSystem.from_uri(self.root)
        for d in ("data", "manifest"):
            self.fs.create_dir(f"{self.base}/{d}", recursive=True)

    # manifests

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        found = [f.base_name for f in self.fs.get_file_info(pafs.FileSelector(f"{self.base}/manifest")) if f.is_file]
        return max((int(f[1:-5]) for f in found if f.startswith("v") and f.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        with self.fs.open_input_file(f"{self.base}/manifest/v{version:010d}.json") as f:
            return json.loads(f.read())

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    def _commit(self, after: int, schema: str, shards: list[Shard]) -> int:
        """Puts version after + 1 in place, or raises CommitConflict if it is there."""
        path = f"{self.base}/manifest/v{after + 1:010d}.json"
        temp = f"{self.base}/manifest/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temp) as f:
            f.write(json.dumps({"version": after + 1, "schema": schema, "shards": [vars(s) for s in shards]}).encode())
        try:
            if isinstance(self.fs, pafs.LocalFileSystem):
                os.link(temp, path)  # fails if path is there
            else:
                jvm = self.spark._jvm
                at = jvm.org.apache.hadoop.fs.Path(self.root)
                fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
                name = self.root.rstrip("/") + "/manifest/"
                if not fs.rename(jvm.org.apache.hadoop.fs.Path(name + os.path.basename(temp)), jvm.org.apache.hadoop.fs.Path(name + os.path.basename(path))):
                    raise FileExistsError(path)
        except FileExistsError:
            raise CommitConflict(f"version {after + 1} is there already") from None
        finally:
            if self.fs.get_file_info(temp).type != pafs.FileType.NotFound:
                self.fs.delete_file(temp)
        return after + 1

    # arrivals and reads

    def append(self, df: DataFrame, shard_rows: int = SHARD_ROWS) -> int:
        """Adds df as shards of at most ``shard_rows`` rows; returns the new version."""
        before = self.manifest()
        schema = df.schema.json()
        if before["schema"] not in (None, schema):
            raise ValueError("the arrival's schema is not the table's")
        batch = uuid.uuid4().hex
        df.write.option("maxRecordsPerFile", shard_rows).parquet(f"{self.root}/data/{batch}")
        names = [f"{batch}/{f.base_name}" for f in self.fs.get_file_info(pafs.FileSelector(f"{self.base}/data/{batch}")) if f.is_file and f.base_name.endswith(".parquet")]
        new = [Shard(n, b, r, before["version"] + 1) for n, b, r in self._measured(sorted(names))]
        return self._commit(before["version"], schema, self.shards(before["version"]) + new)

    def _measured(self, names: list[str]) -> list[tuple[str, int, int]]:
        """Size and rows of new shards, from their footers, read on the executors."""
        base, root = self.base, self.root

        def run(batches):
            fs, _ = pafs.FileSystem.from_uri(root)
            for batch in batches:
                names = batch.column(0).to_pylist()
                rows = [pq.read_metadata(f"{base}/data/{n}", filesystem=fs).num_rows for n in names]
                sizes = [i.size for i in fs.get_file_info([f"{base}/data/{n}" for n in names])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(rows, pa.int64())], ["name", "bytes", "rows"])

        if not names:
            return []
        df = self.spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names) // 64))
        return sorted(map(tuple, df.mapInArrow(run, "name string, bytes long, rows long").collect()))

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, by default the newest."""
        from pyspark.sql.types import StructType

        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("nothing was ever appended")
        schema = StructType.fromJson(json.loads(m["schema"]))
        names = [f"{self.root}/data/{s['name']}" for s in m["shards"]]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    # compaction

    def tier(self, size: int) -> int:
        t = 0
        while size > self.small:
            size, t = size / self.fanout, t + 1
        return t

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Groups to merge: of each tier with at least fanout shards below the target, runs of up to the target."""
        tiers: dict[int, list[Shard]] = {}
        for s in sorted(shards, key=lambda s: (s.born, s.name)):
            if s.bytes < self.target / 2:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        groups = []
        for run in tiers.values():
            if len(run) < self.fanout:
                continue
            group, size = [], 0
            for s in run:
                if group and size + s.bytes > self.target:
                    groups.append(group)
                    group, size = [], 0
                group.append(s)
                size += s.bytes
            if len(group) > 1:
                groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self) -> int:
        """Merges until no tier has a run of fanout shards; each round is one job and one commit."""
        while True:
            before = self.manifest()
            shards = self.shards(before["version"])
            groups = self.plan(shards)
            if not groups:
                return before["version"]
            made = self._merge(groups)
            gone = {s.name for g in groups for s in g}
            born = {i: min(s.born for s in g) for i, g in enumerate(groups)}
            merged = [Shard(n, b, r, born[i]) for i, n, b, r in made]
            if sum(s.rows for s in merged) != sum(s.rows for g in groups for s in g):
                raise RuntimeError("merged shards don't have the rows of their sources")
            self._commit(before["version"], before["schema"], [s for s in shards if s.name not in gone] + merged)

    def _merge(self, groups: list[list[Shard]]) -> list[tuple[int, str, int, int]]:
        base, root, target, batch = self.base, self.root, self.target, uuid.uuid4().hex
        group_bytes = min(GROUP, target)  # a file is closed after a row group

        def run(batches):
            fs, _ = pafs.FileSystem.from_uri(root)
            fs.create_dir(f"{base}/data/{batch}", recursive=True)
            for rows in batches:
                for group, names in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    done, schema = [], None
                    out = stream = None
                    held: list[pa.RecordBatch] = []

                    def flush():
                        nonlocal out, stream, temp
                        if out is None:
                            temp = f"{base}/data/{batch}/.{uuid.uuid4().hex}"
                            stream = fs.open_output_stream(temp)
                            out = pq.ParquetWriter(stream, schema, compression="snappy")
                            done.append([group, f"{batch}/{group:06d}-{len(done):03d}.parquet", 0, 0])
                        if held:
                            table = pa.Table.from_batches(held, schema)
                            out.write_table(table, row_group_size=max(1, table.num_rows))
                            done[-1][3] += table.num_rows
                            held.clear()

                    def close():
                        nonlocal out
                        out.close()
                        stream.close()
                        final = f"{base}/data/{done[-1][1]}"
                        fs.move(temp, final)
                        done[-1][2] = fs.get_file_info(final).size
                        out = None

                    temp, size, n = "", 0, 0
                    for name in names:
                        with fs.open_input_file(f"{base}/data/{name}") as source:
                            f = pq.ParquetFile(source)
                            schema = schema or f.schema_arrow
                            for piece in f.iter_batches(1024):
                                held.append(piece.cast(schema))
                                size, n = size + piece.nbytes, n + piece.num_rows
                                if size >= group_bytes or n >= GROUP_ROWS:
                                    flush()
                                    size = n = 0
                                    if stream.tell() >= target:
                                        close()
                    if held or not done:  # the rest, or only empty shards
                        flush()
                    if out is not None:
                        close()
                    cols = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, ["grp", "name", "bytes", "rows"])

        rows = [(i, [s.name for s in g]) for i, g in enumerate(groups)]
        # one group a task; what is sent and returned is file names, as in the manifest itself
        df = self.spark.createDataFrame(self.spark.sparkContext.parallelize(rows, len(rows)), "grp long, names array<string>")
        return sorted(map(tuple, df.mapInArrow(run, "grp long, name string, bytes long, rows long").collect()))

    def vacuum(self, keep: int = 1) -> int:
        """Removes shards that none of the newest ``keep`` versions names, and older manifests; returns how many shards."""
        newest = self.version()
        live = {s.name for v in range(max(1, newest - keep + 1), newest + 1) for s in self.shards(v)}
        gone = 0
        for f in self.fs.get_file_info(pafs.FileSelector(f"{self.base}/data", recursive=True)):
            if f.is_file and f.path.split("/data/")[-1] not in live:
                gone += f.base_name.endswith(".parquet")
                self.fs.delete_file(f.path)
        for v in range(1, newest - keep + 1):
            path = f"{self.base}/manifest/v{v:010d}.json"
            if self.fs.get_file_info(path).type != pafs.FileType.NotFound:
                self.fs.delete_file(path)
        return gone
