"""Splits, pairing by file stem and choice of the best run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalog_engine.operators.numbering import HOT_ROWS, global_row_number, hot_groups, sorted_ranges


def _split(df: DataFrame, order: list[Column], size: Column, inside: str, outside: str) -> DataFrame:
    placed = global_row_number(df, order, "_place")
    total = df.agg(F.count(F.lit(1)).alias("n"))
    cut = total.select(size).scalar()
    return placed.withColumn("part", F.when(F.col("_place") <= cut, inside).otherwise(outside)).drop("_place")


def ordered_split(df: DataFrame, order: list[str], fraction: float) -> DataFrame:
    """The first floor(fraction · n) rows are ``train``, the rest ``val``."""
    return _split(df, [F.col(c) for c in order], F.floor(F.col("n") * fraction), "train", "val")


def random_split(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """floor(fraction · n) rows in seeded hash order are ``val``; the same seed gives the same rows on any cluster."""
    mixed = F.md5(F.concat_ws(":", F.lit(seed), F.col(key)))
    return _split(df, [mixed, F.col(key)], F.floor(F.col("n") * fraction), "val", "train")


def pair_by_stem(left: DataFrame, right: DataFrame, path: str, extensions: list[str]) -> DataFrame:
    """Each left file with the right file of the same stem, by extension priority; ``problem`` marks those without."""
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    ranked = right.select(stem.alias("_stem"), F.array_position(F.array(*[F.lit(e) for e in extensions]), F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))).alias("_rank"), F.col(path).alias("_path"))
    best = ranked.filter("_rank > 0").groupBy("_stem").agg(F.min(F.struct("_rank", "_path"))["_path"].alias("partner"))
    joined = left.withColumn("stem", stem).join(best, F.col("stem") == F.col("_stem"), "left").drop("_stem")
    return joined.withColumn("problem", F.when(F.col("partner").isNull(), "no partner"))


def best_checkpoint(metrics: DataFrame, run: str, epoch: str, loss: str) -> DataFrame:
    """Per run, the earliest epoch with the lowest loss."""
    best = metrics.groupBy(run).agg(F.min(F.struct(loss, epoch)).alias("_best"))
    return best.select(run, F.col(f"_best.{epoch}").alias(epoch), F.col(f"_best.{loss}").alias(loss))


def improvements(metrics: DataFrame, run: str, epoch: str, loss: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Epochs at which the loss fell below everything before.

    Usual runs take one running minimum. When some run is too long for a task, all rows are sorted once and each sorted
    range continues from the minimum of the earlier ranges of its run.
    """

    def running(*keys: str) -> Column:
        return F.min(loss).over(Window.partitionBy(*keys).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1))

    if hot_groups(metrics, [run], hot_rows) is None:
        return metrics.withColumn("improved", F.coalesce(F.col(loss) < running(run), F.lit(True)))
    rows = sorted_ranges(metrics, [F.col(run), F.col(epoch)])
    lowest = rows.groupBy(F.col(run).alias("_run"), F.col("_range").alias("_r")).agg(F.min(loss).alias("_low"))
    earlier = F.min("_low").over(Window.partitionBy("_run").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    continued = rows.withColumn("_inside", running(run, "_range")).join(
        lowest.select("_run", "_r", earlier.alias("_earlier")), F.col(run).eqNullSafe(F.col("_run")) & (F.col("_range") == F.col("_r"))
    )
    improved = F.coalesce(F.col(loss) < F.least("_inside", "_earlier"), F.lit(True))
    return continued.select(*metrics.columns, improved.alias("improved"))
