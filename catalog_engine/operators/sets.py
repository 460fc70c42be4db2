"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine.operators.numbering import spread_row_number


def set_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``."""
    return a.subtract(b)


def union_rules(findings: dict[str, DataFrame]) -> DataFrame:
    """One issue table from the violations of each rule."""
    named = [df.withColumn("rule", F.lit(rule)) for rule, df in findings.items()]
    return reduce(lambda x, y: x.unionByName(y), named)


def dedupe_preserve_order(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Distinct values of each key, numbered in the order they first appear."""
    first = df.groupBy(key, value).agg(F.min(order).alias("_at"))
    return spread_row_number(first, [key], [F.col("_at"), F.col(value)], "position").drop("_at")


def cover_missing(df: DataFrame, key: str, member: str, required: list) -> DataFrame:
    """Required members that a key lacks; keys lacking none are left out. A set never outgrows the required list."""
    wanted = F.array(*[F.lit(r) for r in required])
    held = df.groupBy(key).agg(F.collect_set(F.when(F.col(member).isin(required), F.col(member))).alias("_held"))
    return held.select(key, F.explode(F.array_except(wanted, "_held")).alias("missing"))
