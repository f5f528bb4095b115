"""What managed and external tables share: schemas with notes, files as DataFrames, copy-on-write of touched files."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.errors import BinderError, ExecutionError
from brindle.types import UNSIGNED, can_assign, type_name


@dataclass
class TableDef:
    """A table as declared. notes: by column, what its Spark type can't say."""

    name: str
    schema: T.StructType
    notes: dict[str, dict]
    primary_key: list[str]
    auto_id: bool
    external: bool
    location: str

    @property
    def user_columns(self) -> list[T.StructField]:
        """The columns that INSERT supplies."""
        return [f for f in self.schema.fields if not (self.auto_id and f.name == "_id")]

    def describe(self) -> dict:
        columns = [{"name": f.name, "type": type_name(f.dataType, self.notes.get(f.name)), "primary_key": f.name in self.primary_key} for f in self.schema.fields]
        return {"name": self.name, "columns": columns, "primary_key": list(self.primary_key), "generated_id": self.auto_id, "external": self.external, "location": self.location if self.external else None}

    def to_json(self) -> dict:
        return {"name": self.name, "schema": self.schema.jsonValue(), "notes": self.notes, "primary_key": self.primary_key, "auto_id": self.auto_id, "external": self.external, "location": self.location}

    @classmethod
    def from_json(cls, d: dict) -> TableDef:
        return cls(d["name"], T.StructType.fromJson(d["schema"]), d["notes"], d["primary_key"], d["auto_id"], d["external"], d["location"])


def from_files(spark: SparkSession, schema: T.StructType, files: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def write_files(df: DataFrame, folder: str) -> list[str]:
    """Writes df into a new folder under ``folder`` and returns its Parquet files that hold rows or are the only one."""
    path = os.path.join(folder, f"part-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet"))


def with_file(df: DataFrame) -> DataFrame:
    """A scan with __file, the file that each row comes from."""
    return df.select("*", F.col("_metadata.file_path").alias("__file"))


def touched_files(df: DataFrame) -> list[str]:
    """The files that rows of a scan with __file (filtered, joined) come from: at most as many as the manifest names."""
    return sorted(local_path(r[0]) for r in df.select("__file").distinct().collect())


def local_path(uri: str) -> str:
    from urllib.parse import unquote

    return unquote(uri[5:]).replace("///", "/", 1) if uri.startswith("file:") else uri


def fit(df: DataFrame, table: TableDef, fields: list[T.StructField]) -> DataFrame:
    """df's columns by position as the given fields: assignable types, strict casts, checks of unsigned and T[n]."""
    if len(df.schema.fields) != len(fields):
        raise BinderError(f"{table.name} takes {len(fields)} values, not {len(df.schema.fields)}")
    names = [f"__{i}" for i in range(len(fields))]
    return df.toDF(*names).select(*[assigned(F.col(n), s.dataType, f, table.notes.get(f.name, {})).alias(f.name) for n, s, f in zip(names, df.schema.fields, fields, strict=True)])


def assigned(value: Column, source: T.DataType, field: T.StructField, notes: dict) -> Column:
    """A value as stored in a column, or an error at run time where it doesn't fit."""
    whole = isinstance(source, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if not can_assign(source, field.dataType) and not ("unsigned" in notes and whole):  # the check below does
        raise BinderError(f"column {field.name} takes {type_name(field.dataType, notes)}, not {type_name(source)}")
    out = value.cast(field.dataType)
    if "unsigned" in notes:
        top = UNSIGNED[notes["unsigned"]]
        wide = value.cast("decimal(20,0)")
        bad = (wide < 0) | (wide > F.lit(str(top)).cast("decimal(20,0)"))
        out = F.when(bad, F.raise_error(F.lit(f"value out of range for {notes['unsigned'].upper()} column {field.name}")).cast(field.dataType)).otherwise(out)
    if "length" in notes:
        bad = F.size(out) != notes["length"]
        out = F.when(out.isNotNull() & bad, F.raise_error(F.lit(f"column {field.name} takes arrays of {notes['length']}")).cast(field.dataType)).otherwise(out)
    return out


def run(action, what: str):
    """Runs a Spark action, with its errors as ExecutionError."""
    try:
        return action()
    except (BinderError, ExecutionError):
        raise
    except Exception as e:
        raise ExecutionError(f"{what}: {str(e).splitlines()[0] if str(e) else type(e).__name__}") from e
