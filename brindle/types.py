"""SQL type names, their Spark types, and the rules between types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from brindle.errors import BinderError

_NAMES: dict[str, T.DataType] = {}
for _t, _names in (
    (T.BooleanType(), "bool boolean logical"),
    (T.ByteType(), "tinyint int1"),
    (T.ShortType(), "smallint int2 short"),
    (T.IntegerType(), "int integer int4 signed"),
    (T.LongType(), "bigint int8 long"),
    (T.ShortType(), "utinyint"),
    (T.IntegerType(), "usmallint"),
    (T.LongType(), "uinteger"),
    (T.DecimalType(20, 0), "ubigint"),
    (T.FloatType(), "float float4 real"),
    (T.DoubleType(), "double float8 numeric decimal"),
    (T.StringType(), "varchar text char bpchar string"),
    (T.DateType(), "date"),
    (T.TimestampNTZType(), "timestamp datetime"),
):
    for _n in _names.split():
        _NAMES[_n] = _t

#: Largest value of the unsigned types, which Spark lacks: they are one step wider with a check on writes.
UNSIGNED = {"utinyint": 2**8 - 1, "usmallint": 2**16 - 1, "uinteger": 2**32 - 1, "ubigint": 2**64 - 1}
_INTEGERS = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]


def parse_type(text: str) -> tuple[T.DataType, dict]:
    """The Spark type of a declared one, and what Spark's type can't say: unsigned, or the length of T[n]."""
    m = re.fullmatch(r"\s*([A-Za-z_][A-Za-z0-9_]*)(?:\s+(?:precision|varying))?\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*(\[\s*(\d*)\s*\])?\s*", text, re.I)
    if not m or m[1].lower() not in _NAMES:
        raise BinderError(f"unknown type {text.strip()!r}")
    name, kind, notes = m[1].lower(), _NAMES[m[1].lower()], {}
    if name in ("decimal", "numeric") and m[2]:
        if m[3] is None:
            raise BinderError("DECIMAL takes both width and scale")
        width, scale = int(m[2]), int(m[3])
        if not 1 <= width <= 18 or scale > width:
            raise BinderError("DECIMAL takes a width of 1 to 18 and a scale within it")
        kind = T.DecimalType(width, scale)
    elif name == "decimal":
        raise BinderError("DECIMAL takes both width and scale")
    if name in UNSIGNED:
        notes["unsigned"] = name
    if m[4]:
        kind = T.ArrayType(kind)
        if m[5]:
            notes["length"] = int(m[5])
    return kind, notes


def type_name(kind: T.DataType, notes: dict | None = None) -> str:
    """The name under which results and descriptions show a type."""
    notes = notes or {}
    if "unsigned" in notes:
        return notes["unsigned"].upper()
    if isinstance(kind, T.ArrayType):
        return f"{type_name(kind.elementType)}[{notes.get('length', '')}]"
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    names = {T.BooleanType: "BOOLEAN", T.ByteType: "TINYINT", T.ShortType: "SMALLINT", T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.StringType: "VARCHAR", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMP", T.NullType: "UNKNOWN"}
    return names.get(type(kind), kind.simpleString().upper())


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type to which both sides of a comparison or a VALUES column are brought."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    text = [isinstance(x, T.StringType) for x in (a, b)]
    if any(text):
        other = b if text[0] else a
        return other if isinstance(other, (T.DateType, T.TimestampNTZType)) else T.StringType()
    for kind in (T.DoubleType, T.FloatType):
        if isinstance(a, kind) or isinstance(b, kind):
            return kind()
    if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
        return T.DecimalType(18, max(x.scale if isinstance(x, T.DecimalType) else 0 for x in (a, b)))
    if a in _INTEGERS and b in _INTEGERS:
        return max(a, b, key=_INTEGERS.index)
    if {type(a), type(b)} == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    raise BinderError(f"no common type of {type_name(a)} and {type_name(b)}")


def can_assign(source: T.DataType, target: T.DataType) -> bool:
    """Whether INSERT takes a value of one type for a column of another: integers never narrow."""
    if source == target or isinstance(source, T.NullType):
        return True
    if source in _INTEGERS and target in _INTEGERS:
        return _INTEGERS.index(source) <= _INTEGERS.index(target)
    numeric = (T.FloatType, T.DoubleType, T.DecimalType)
    if isinstance(target, numeric):
        return source in _INTEGERS or isinstance(source, (*numeric, T.StringType))
    if isinstance(target, T.StringType):
        return not isinstance(source, (T.ArrayType, T.StructType))
    if isinstance(source, T.StringType):
        return True
    if isinstance(target, T.TimestampNTZType):
        return isinstance(source, (T.DateType, T.TimestampType))
    if isinstance(target, T.ArrayType) and isinstance(source, T.ArrayType):
        return can_assign(source.elementType, target.elementType)
    return source in _INTEGERS and isinstance(target, T.DecimalType)
