"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes = threading.local()


def place(spark: SparkSession, name: str) -> str:
    """A new path in the session's spark.checkpoint.dir; in local mode, a temporary folder stands in where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again; deleted at the end of the scratch() around it, if any."""
    spark, path = df.sparkSession, place(df.sparkSession, name)
    df.write.parquet(path)
    if scopes := getattr(_scopes, "open", []):
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _there(spark: SparkSession, path: str) -> tuple:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    store, there = _there(spark, path)
    return store.exists(there)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder; nothing happens where there is none."""
    store, there = _there(spark, path)
    store.delete(there, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what is written inside once the block has ended: its results must have been stored by then."""
    _scopes.open = [*getattr(_scopes, "open", []), []]
    try:
        yield
    finally:
        *_scopes.open, paths = _scopes.open
        for path in paths:
            delete(spark, path)
