"""Structured Streaming over files, as an extension: tumbling windows with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_of(spark: SparkSession, folder: str, file_glob: str) -> DataFrame:
    """Parquet files of a folder as a stream."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", file_glob).parquet(folder)


def tumbling_counts(events: DataFrame, at: str, by: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and sum of values for each window and key; state older than the watermark is dropped."""
    stamped = events.withColumn("__at", F.col(at).cast(T.TimestampType())).withWatermark("__at", late)
    out = stamped.groupBy(F.window("__at", width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), by, "n", "total")


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what is there and returns its complete result as of the last batch, from files in folder."""
    out, mark = f"{folder}/out-{uuid.uuid4().hex}", f"{folder}/mark-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{n}")

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    names = [int(f.getPath().getName()) for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return spark.read.parquet(f"{out}/{max(names)}")
