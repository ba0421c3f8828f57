"""Parquet cache of results, by a key of their inputs and with an age limit."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def key_of(**inputs) -> str:
    """The same inputs in any order give the same key."""
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, default=str).encode()).hexdigest()[:24]


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame], max_age: float | None = None) -> DataFrame:
    """The table of that key in a folder all executors share; made and written
    if it is absent, unfinished or older than max_age seconds."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = f"{folder}/{key}.parquet"
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    files = done.getFileSystem(conf)
    fresh = files.exists(done) and (max_age is None or time.time() - files.getFileStatus(done).getModificationTime() / 1000 <= max_age)
    if not fresh:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
