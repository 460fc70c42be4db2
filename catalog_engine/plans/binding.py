"""Registry that ties an operator to the driver tables and to the SQL that states the same result independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the driver tables: ``t.orders`` or ``t("orders")``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def dealt(self, name: str, *keys: Column) -> DataFrame:
        """A table with its rows dealt evenly over the cluster, or by keys, for work that is heavy for each row.

        A million short rows may lie in one part of a file, so by bytes they would be one task.
        """
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 4 * self.spark.sparkContext.defaultParallelism)
        return self(name).repartition(tasks, *keys)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self(name)


def bind(name: str, oracle: str | None = None):
    """Register ``plan(t: Tables) -> DataFrame`` as query ``name``."""

    def decorate(plan: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is bound twice")
        QUERIES[name] = lambda spark, root: plan(Tables(spark, root))
        if oracle:
            ORACLES[name] = oracle.strip()
        return plan

    return decorate
