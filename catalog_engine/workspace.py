"""Where intermediate results live.

Everything that has to outlive one plan (checkpoints, staged tables, stream state) goes under the shared folder named by
``spark.checkpoint.dir``. Only a local master may fall back to a folder on this machine.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_open_folders: ContextVar[list[str] | None] = ContextVar("open_folders", default=None)


def shared_root(spark: SparkSession) -> str:
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_root


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


#: has Spark remove the shuffle files of an execution at its end, not when the driver's memory happens to be collected
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_once(df: DataFrame, path: str) -> None:
    """Write a table whose shuffles nothing else reuses, and let them go with it."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back, for results that several branches reuse."""
    path = fresh_path(df.sparkSession, label)
    write_once(df, path)
    folders = _open_folders.get()
    if folders is not None:
        folders.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this workspace, wherever it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def settled(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``staged(build())``, after which the folders that ``build`` has staged are removed; only its result needed them."""
    folders: list[str] = []
    before = _open_folders.set(folders)
    try:
        made = build()
        path = fresh_path(spark, label)
        write_once(made, path)
    finally:
        _open_folders.reset(before)
        for folder in folders:
            remove(spark, folder)
    if before.old_value is not before.MISSING and before.old_value is not None:
        before.old_value.append(path)
    return spark.read.schema(made.schema).parquet(path)
