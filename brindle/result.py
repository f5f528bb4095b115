"""Results of statements: owned rows with a cursor, or the tag of a command."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brindle.errors import ProgrammingError
from brindle.types import type_name


def _plain(value: Any) -> Any:
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value.asDict(recursive=True) if isinstance(value, T.Row) else value


class Result:
    """Rows are collected once, when the statement runs; use Connection.query for a DataFrame that stays distributed."""

    def __init__(self, tag: str, schema: T.StructType | None = None, rows: list[tuple] | None = None, affected: int | None = None):
        self._tag, self._schema, self._rows, self._affected, self._at = tag, schema, rows or [], affected, 0

    @classmethod
    def of(cls, df: DataFrame) -> Result:
        return cls("SELECT", df.schema, [tuple(_plain(v) for v in r) for r in df.collect()])

    @property
    def columns(self) -> list[str]:
        return self._schema.names if self._schema else []

    @property
    def types(self) -> list[str]:
        return [type_name(f.dataType) for f in self._schema.fields] if self._schema else []

    @property
    def row_count(self) -> int:
        return len(self._rows)

    @property
    def is_command(self) -> bool:
        return self._schema is None

    @property
    def command_tag(self) -> str:
        return self._tag

    @property
    def affected_rows(self) -> int | None:
        return self._affected

    @property
    def status(self) -> str:
        n = self._affected if self.is_command else self.row_count
        return self._tag if n is None else f"{self._tag} {n}"

    def tuples(self) -> list[tuple]:
        return list(self._rows)

    def fetchone(self) -> tuple | None:
        if self._at >= len(self._rows):
            return None
        self._at += 1
        return self._rows[self._at - 1]

    def fetchmany(self, size: int = 1) -> list[tuple]:
        if size < 0:
            raise ProgrammingError("size must not be negative")
        out = self._rows[self._at : self._at + size]
        self._at += len(out)
        return out

    def fetchall(self) -> list[tuple]:
        return self.fetchmany(len(self._rows))

    def to_df(self):
        """A pandas frame: nullable types only for integers and booleans that hold nulls, objects for the rest."""
        import pandas as pd

        if self.is_command:
            raise ProgrammingError("a command has no rows")
        ints = {T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64"}
        out = {}
        for i, f in enumerate(self._schema.fields):
            values = [r[i] for r in self._rows]
            kind, nulls = type(f.dataType), any(r[i] is None for r in self._rows)
            if kind in ints:
                out[i] = pd.Series(values, dtype=ints[kind].capitalize() if nulls else ints[kind])
            elif kind is T.BooleanType:
                out[i] = pd.Series(values, dtype="boolean" if nulls else "bool")
            elif kind in (T.FloatType, T.DoubleType):
                out[i] = pd.Series(values, dtype="float32" if kind is T.FloatType else "float64")
            elif kind in (T.TimestampNTZType, T.TimestampType):
                out[i] = pd.Series(values, dtype="datetime64[us]")
            else:
                out[i] = pd.Series(values, dtype="object")
        frame = pd.DataFrame(out, index=range(len(self._rows)))
        frame.columns = self.columns
        return frame

    def __len__(self) -> int:
        return len(self._rows)

    def __iter__(self) -> Iterator[tuple]:
        return self

    def __next__(self) -> tuple:
        row = self.fetchone()
        if row is None:
            raise StopIteration
        return row
