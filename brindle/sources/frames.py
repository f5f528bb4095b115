"""pandas frames as DataFrames with the engine's types."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from brindle.errors import DataError

_KINDS = {
    pa.bool_(): (T.BooleanType(), None),
    pa.int8(): (T.ByteType(), None),
    pa.int16(): (T.ShortType(), None),
    pa.int32(): (T.IntegerType(), None),
    pa.int64(): (T.LongType(), None),
    pa.uint8(): (T.ShortType(), "utinyint"),
    pa.uint16(): (T.IntegerType(), "usmallint"),
    pa.uint32(): (T.LongType(), "uinteger"),
    pa.uint64(): (T.DecimalType(20, 0), "ubigint"),
    pa.float32(): (T.FloatType(), None),
    pa.float64(): (T.DoubleType(), None),
    pa.string(): (T.StringType(), None),
    pa.large_string(): (T.StringType(), None),
    pa.date32(): (T.DateType(), None),
}


def to_spark(spark: SparkSession, frame, include_index: bool = False) -> tuple[DataFrame, dict[str, dict]]:
    """The DataFrame of a pandas frame and its columns' notes; DataError for what has no column type."""
    import pandas as pd

    if not isinstance(frame, pd.DataFrame):
        raise DataError("load_df takes a pandas DataFrame")
    if include_index:
        frame = frame.reset_index()
    names = list(frame.columns)
    if not names or any(not isinstance(n, str) or not n for n in names):
        raise DataError("columns take non-empty string names")
    if len({n.lower() for n in names}) < len(names):
        raise DataError("two columns of one name")
    frame = frame.copy(deep=False)
    for n in names:
        if isinstance(frame[n].dtype, pd.CategoricalDtype):
            frame[n] = frame[n].astype(frame[n].cat.categories.dtype if not frame[n].isna().any() else object)
    try:
        table = pa.Table.from_pandas(frame, preserve_index=False)
    except (pa.ArrowInvalid, pa.ArrowTypeError, pa.ArrowNotImplementedError) as e:
        raise DataError(f"a column mixes types: {e}") from e
    fields, notes, columns = [], {}, []
    for f, c in zip(table.schema, table.columns, strict=True):
        kind, note = _KINDS.get(f.type, (None, None))
        if pa.types.is_null(f.type):
            kind, c = T.StringType(), c.cast(pa.string())
        elif pa.types.is_timestamp(f.type) and f.type.tz is None:
            kind, c = T.TimestampNTZType(), c.cast(pa.timestamp("us"), safe=False)
        elif pa.types.is_decimal(f.type) and f.type.precision <= 18:
            kind = T.DecimalType(f.type.precision, f.type.scale)
        elif note == "ubigint":
            c = c.cast(pa.decimal128(20, 0))
        elif note:
            c = c.cast({"utinyint": pa.int16(), "usmallint": pa.int32(), "uinteger": pa.int64()}[note])
        if kind is None:
            raise DataError(f"column {f.name} of type {f.type} has no column type")
        if note:
            notes[f.name] = {"unsigned": note}
        fields.append(T.StructField(f.name, kind))
        columns.append(c)
    return spark.createDataFrame(pa.table(columns, names=names), T.StructType(fields)), notes
