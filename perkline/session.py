"""The Spark session of a run."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from perkline.settings import Settings


def build_session(settings: Settings) -> SparkSession:
    """A session by the settings; SPARK_MASTER_URL or SPARK_LOCAL_MASTER name the master if spark-submit does not."""
    b = SparkSession.builder.appName(settings.app_name)
    master = os.environ.get("SPARK_MASTER_URL") or os.environ.get("SPARK_LOCAL_MASTER")
    if master:
        b = b.master(master)
    for variable, key in (("SPARK_DRIVER_BIND_ADDRESS", "spark.driver.bindAddress"), ("SPARK_DRIVER_HOST", "spark.driver.host")):
        if os.environ.get(variable):
            b = b.config(key, os.environ[variable])
    told = settings.raw.get("spark", {})
    b = b.config("spark.sql.shuffle.partitions", str(told.get("shuffle_partitions", 8)))
    for key, value in told.get("configs", {}).items():
        b = b.config(key, str(value))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel(os.environ.get("SPARK_LOG_LEVEL", "WARN"))
    return spark
