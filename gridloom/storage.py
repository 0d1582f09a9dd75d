"""Written tables in the folder that the cluster shares: they cut lineage and survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A fresh path under spark.checkpoint.dir. Only a local session, whose executors are the driver, may leave that unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.get("dir") or _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="gridloom-"))
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows, written and read again; with `by`, in a folder for each value of that column."""
    path = shared_folder(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished queries now. It does so for plans that are collected as garbage, which may be late."""
    gc.collect()
    spark._jvm.System.gc()
