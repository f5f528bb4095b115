"""SparkSession construction with the settings that the engine's semantics rest on."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

#: Semantics, not tuning: strict casts and overflow errors, no time zone in timestamps.
SEMANTICS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
}

#: Planning that suits inputs of any size: partition counts, join sides and skew are settled at run time.
PLANNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "brindle", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session for local work; on a cluster, pass no master and let spark-submit decide."""
    b = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" not in os.environ:
        cpus = os.environ.get("BENCH_CPUS", "8")
        b = b.master(master or f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus)
        b = b.config("spark.driver.memory", os.environ.get("BRINDLE_DRIVER_MEMORY", "8g")).config("spark.ui.enabled", "false")
    for k, v in {**SEMANTICS, **PLANNING, **(conf or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application, so that they need no path of their own."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        temp = tempfile.mkdtemp(prefix="brindle-ship")
        shutil.copytree(here, f"{temp}/src/brindle", ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(f"{temp}/brindle_package", "zip", f"{temp}/src"))
        _SHIPPED.add(sc.applicationId)
