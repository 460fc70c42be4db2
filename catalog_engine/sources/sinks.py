"""Writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """``csv`` with a header, ``log`` (tab separated, no header), ``json`` lines or ``parquet``."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        # empty text and NULL stay apart
        writer.option("header", True).option("nullValue", "\\N").option("emptyValue", "").option("escape", '"').csv(path)
    elif fmt == "log":
        writer.option("sep", "\t").option("header", False).csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return path


BUCKET = "bucket"
VERSION = "version"


def in_buckets(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Add the bucket of the key, so that an update touches only the buckets of its keys."""
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def publish(df: DataFrame, path: str) -> None:
    """Replace a Parquet table by a new state that may have been computed from it.

    The state is written beside the table first; only then do two renames put it in place.
    """
    mark = uuid.uuid4().hex
    df.write.parquet(f"{path}.new-{mark}")
    _exchange(df.sparkSession, f"{path}.new-{mark}", path, f"{path}.old-{mark}")
    df.sparkSession.catalog.refreshByPath(path)


def publish_buckets(df: DataFrame, path: str, keys: list[str], tasks: int = 8) -> None:
    """Give those buckets of a bucketed table that occur in ``df`` a new version (its other buckets are left alone).

    A bucket is written by up to ``tasks`` tasks. Its rows lie in ``bucket=b/version=v``; the new version is complete before
    one rename shows it, and only then are versions before the last one removed. So a bucket is never missing, and a batch
    that was stopped halfway can be replayed. Read such a table with ``read_buckets``.
    """
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    fresh = f"{path}.new-{uuid.uuid4().hex}"
    df.repartition(F.col(BUCKET), F.pmod(F.xxhash64(F.lit(BUCKET), *keys), F.lit(tasks))).write.partitionBy(BUCKET).parquet(fresh)
    fs = place(fresh).getFileSystem(spark._jsc.hadoopConfiguration())
    known = _versions(spark, path)
    for name in _folders(fs, place(fresh), BUCKET):
        bucket = f"{path}/{BUCKET}={name}"
        fs.mkdirs(place(bucket))
        last = max(known.get(name, [0]))
        if not fs.rename(place(f"{fresh}/{BUCKET}={name}"), place(f"{bucket}/{VERSION}={last + 1}")):
            raise OSError(f"cannot publish {bucket}")
        for version in known.get(name, []):
            if version < last:
                fs.delete(place(f"{bucket}/{VERSION}={version}"), True)
    fs.delete(place(fresh), True)


def read_buckets(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The newest version of every bucket (or of some buckets) of a table written by ``publish_buckets``."""
    known = _versions(spark, path)
    wanted = [b for b in known if buckets is None or b in buckets]
    schema = spark.read.parquet(*[f"{path}/{BUCKET}={b}/{VERSION}={max(v)}" for b, v in list(known.items())[:1]]).schema
    newest = [f"{path}/{BUCKET}={b}/{VERSION}={max(known[b])}" for b in wanted]
    if not newest:
        return spark.createDataFrame([], schema.add(BUCKET, "int"))
    folder = F.regexp_extract(F.col("_metadata.file_path"), rf"/{BUCKET}=([0-9]+)/{VERSION}=[0-9]+/[^/]*$", 1)
    return spark.read.schema(schema).parquet(*newest).withColumn(BUCKET, folder.cast("int"))


def _folders(fs, folder, label: str) -> list[int]:
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return [int(n.removeprefix(f"{label}=")) for n in names if n.startswith(f"{label}=")]


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The versions of each bucket: a few numbers a bucket, read from folder names."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = {b: _folders(fs, place(f"{path}/{BUCKET}={b}"), VERSION) for b in _folders(fs, place(path), BUCKET)}
    return {b: v for b, v in found.items() if v}


def _exchange(spark: SparkSession, fresh: str, path: str, aside: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(place(path)) and not fs.rename(place(path), place(aside)):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(place(fresh), place(path)):
        fs.rename(place(aside), place(path))
        raise OSError(f"cannot publish {path}")
    if fs.exists(place(aside)):
        fs.delete(place(aside), True)
