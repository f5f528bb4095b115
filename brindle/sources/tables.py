"""Sources and sinks: Parquet folders, constant rows, one empty row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.types import common_type

CODECS = ("none", "snappy", "gzip", "zstd")


def parquet(spark: SparkSession, *paths: str, schema: T.StructType | None = None) -> DataFrame:
    """A scan. Filters and columns reach the reader by themselves; a declared schema spares reading a footer."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)


def write_parquet(df: DataFrame, path: str, codec: str = "snappy", row_group: int = 128 << 20) -> None:
    if codec not in CODECS:
        raise ValueError(f"codec is one of {', '.join(CODECS)}")
    df.write.option("compression", codec).option("parquet.block.size", row_group).parquet(path)


def literal_type(value) -> T.DataType:
    """The type of a constant: the least of int and bigint that holds it, double for fractions and beyond."""
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.IntegerType() if -(2**31) <= value < 2**31 else T.LongType() if -(2**63) <= value < 2**63 else T.DoubleType()
    return {float: T.DoubleType(), str: T.StringType()}[type(value)]


def values(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """Constant rows, each column of the common type of its values."""
    kinds = [reduce(common_type, (literal_type(r[i]) for r in rows)) for i in range(len(names))]
    raw = [T.StructField(n, T.StringType()) for n in names]
    text = [tuple(None if v is None else str(v) for v in r) for r in rows]
    df = spark.createDataFrame(text, T.StructType(raw))
    return df.select(*[F.col(f"`{n}`").cast(k if not isinstance(k, T.NullType) else T.StringType()).alias(n) for n, k in zip(names, kinds, strict=True)])


def one_row(spark: SparkSession) -> DataFrame:
    """What SELECT without FROM reads."""
    return spark.range(1).select()
