"""Row numbers inside groups of any size.

``row_number() OVER (PARTITION BY key ORDER BY ...)`` is the cheap way, but it sends a whole group to one task. Groups above
``hot_rows`` are therefore numbered from one distributed sort instead: the sort cuts a hot group into many ranges, each row
gets its place inside its range, and the sizes of the earlier ranges are added. The sorted rows are written once so that
the counting pass and the reading pass see the same ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalog_engine.workspace import staged

HOT_ROWS = 2_000_000
_INSIDE_BITS = 33  # monotonically_increasing_id: partition above, place inside the partition below


def sorted_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows of one distributed sort, written once, with ``_range`` (which part of the order) and ``_mark`` (place)."""
    # sort on plain columns: a sort evaluates an expression again at every comparison
    places = [f"_order{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(p) for c, p in zip(order, places, strict=True)])
    marked = keyed.orderBy(*places).withColumn("_mark", F.monotonically_increasing_id()).drop(*places)
    return staged(marked, "sorted").withColumn("_range", F.shiftright("_mark", _INSIDE_BITS))


def global_row_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name`` = 1-based position of every row in the whole ordering, without a single-task window."""
    rows = sorted_ranges(df, order)
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row per sort partition, so the undivided window and the broadcast stay small
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.col("_mark").bitwiseAND((1 << _INSIDE_BITS) - 1)
    placed = rows.join(F.broadcast(offsets), "_range").withColumn(name, inside + F.col("_before") + 1)
    return placed.select(*df.columns, name)


def spread_row_number(
    df: DataFrame, keys: list[str], order: list[Column], name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``name`` = 1-based position of each row in its ``keys`` group; hot groups are spread over many tasks."""
    if not keys:
        return global_row_number(df, order, name)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    hot = hot_groups(df, keys, hot_rows)
    if hot is None:
        return df.withColumn(name, rank)
    same = _same_keys(keys)
    usual = df.join(hot, same, "left_anti").withColumn(name, rank)
    spread = df.join(hot, same, "left_semi")
    placed = global_row_number(spread, [F.col(k) for k in keys] + order, "_place")
    starts = placed.groupBy(*[F.col(k).alias(f"_hot_{k}") for k in keys]).agg(F.min("_place").alias("_start"))
    placed = placed.join(starts, same).withColumn(name, F.col("_place") - F.col("_start") + 1)
    return usual.unionByName(placed.select(*df.columns, name))


def hot_groups(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys of groups above ``hot_rows`` rows (at most total / hot_rows of them), or None when there are none."""
    sizes = df.groupBy(*[F.col(k).alias(f"_hot_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    return staged(sizes.filter(F.col("_n") > hot_rows).drop("_n"), "hot") if largest > hot_rows else None


def _same_keys(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
