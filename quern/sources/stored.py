"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local runs without one, a temporary folder, set for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/quern/{tag}-{uuid.uuid4().hex}"


def store(spark: SparkSession, df: DataFrame, tag: str, free: bool = False) -> DataFrame:
    """``df``, written once and read back: what several parts of a query read is worked out once, and lost executors cost none of it.

    ``free`` lets Spark's cleaner drop the finished job's shuffle files at once, worth the pause where they are large.
    """
    path = new_path(spark, tag)
    df.write.parquet(path)
    schema = df.schema
    del df
    for _ in range(2 * free):  # what one collection frees, the next may follow up
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)
    return spark.read.schema(schema).parquet(path)
