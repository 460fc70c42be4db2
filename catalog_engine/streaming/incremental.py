"""Incremental loads as Structured Streaming jobs that run until they have caught up.

Each job keeps its progress in a checkpoint, so running it again handles only what is new, also after a crash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_engine.operators.tables import upsert
from catalog_engine.sources.sinks import BUCKET, in_buckets, publish_buckets, read_buckets


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, file_glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream; the schema is given because a stream must not guess it."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def _run(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def ingest_incremental(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append everything not seen before to a Parquet table, exactly once."""
    _run(stream.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint))


def stream_upsert(stream: DataFrame, target: str, keys: list[str], columns: list[str], checkpoint: str, order: str, buckets: int = 64) -> None:
    """Upsert every batch into a table stored in key buckets (see ``sinks.publish_buckets``).

    The table stores ``order``, so a late older row never replaces a newer one, whichever batch it comes in. A batch rewrites
    only the buckets its keys fall into, and replaying it after a failure leaves the same state.
    """
    spark = stream.sparkSession
    update = [*columns, *([] if order in columns else [order])]

    def apply(batch: DataFrame, _: int) -> None:
        feed = in_buckets(batch.select(*keys, *update), keys, buckets)
        touched = [r[BUCKET] for r in feed.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
        if touched:
            state = read_buckets(spark, target, touched)
            publish_buckets(upsert(state, feed, [*keys, BUCKET], update, order, keep_newer=True), target, keys)

    _run(stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint))


def stream_dedup(stream: DataFrame, keys: list[str], event_time: str, delay: str = "1 day") -> DataFrame:
    """Drop repeats of a key that come within the delay; keys are forgotten after it, which bounds the state."""
    return stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def high_water(df: DataFrame, key: str, last: int, existing: DataFrame, existing_key: str) -> DataFrame:
    """Ids above the last one handled that are not stored yet."""
    known = existing.select(F.col(existing_key).alias("_known")).distinct()
    return df.filter(F.col(key) > last).join(known, F.col(key) == F.col("_known"), "left_anti")


def next_mark(df: DataFrame, key: str, last: int) -> DataFrame:
    """The new high-water mark: the largest id seen, never below the last one."""
    return df.agg(F.greatest(F.coalesce(F.max(key), F.lit(last)), F.lit(last)).alias("mark"))
