"""Results kept in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_dir() -> str:
    there = tempfile.mkdtemp(prefix="sluice-")
    atexit.register(shutil.rmtree, there, ignore_errors=True)
    return there


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one of
    this process in a local session, and an error on a cluster, whose executors
    don't share the driver's folders."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", None) or "local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (there or _own_dir()).rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A folder of its own in the shared one, not made yet; deleted when Python ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def kept(df: DataFrame, what: str = "table", options: dict[str, str] | None = None) -> DataFrame:
    """df written as a table in the shared folder and read back, so that a lost
    executor costs no more than the tasks that it ran. Deleted when Python ends.
    options are the writer's."""
    spark = df.sparkSession
    path = scratch_dir(spark, what)
    df.write.option("compression", "zstd").options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
