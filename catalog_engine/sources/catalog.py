"""Catalogue introspection, ad-hoc SQL and SQL functions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_engine.functions.normalise import REGISTRY, unescape_sql
from catalog_engine.operators.markup import canonical_sql

_IDENTIFIER = re.compile(r"^[a-zA-Z0-9_]+$")


def _checked(name: str) -> str:
    if not _IDENTIFIER.match(name):
        raise ValueError(f"invalid name {name!r}")
    return name


def list_tables(spark: SparkSession) -> DataFrame:
    """Names of tables and views, sorted."""
    rows = sorted((t.name, t.tableType) for t in spark.catalog.listTables())
    return spark.createDataFrame(rows, "name string, kind string")


def table_schema(spark: SparkSession, name: str) -> DataFrame:
    """Position, name, type and nullability of every column."""
    fields = spark.table(_checked(name)).schema.fields
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def view_definition(spark: SparkSession, name: str) -> str | None:
    """Text of a stored view; None for tables and for session views, of which Spark keeps only the plan."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {_checked(name)}").filter(F.col("col_name") == "View Text").first()
    return described["data_type"] if described else None


def database_info(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Apache Spark", spark.version)], "product string, version string")


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    """Rows of any SQL text as JSON objects, NULL kept."""
    result = spark.sql(sql)
    return result.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in result.columns]), {"ignoreNullFields": "false"}).alias("row"))


def register_functions(spark: SparkSession) -> list[str]:
    """Make every normaliser a SQL function of the same name. They are SQL expressions, so no Python runs on the way."""
    for name, recipe in REGISTRY.items():
        params = [p if " " in p else f"{p} STRING" for p in recipe.params]
        body = recipe.build(*[p.split()[0] for p in params])
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(params)}) RETURNS {recipe.returns} RETURN {body}")
    return sorted(REGISTRY)


def register_html_rows(spark: SparkSession) -> None:
    """SQL table function ``html_rows(markup)`` for lateral joins over documents: one row per table cell.

    A table inside a cell is text of that cell; entities are resolved."""
    plain = r"trim(regexp_replace(regexp_replace(cell, r'<[^>]*>', ' '), r'[\s\x{00a0}]+', ' '))"
    spark.sql(
        rf"""CREATE OR REPLACE TEMPORARY FUNCTION html_rows(markup STRING)
            RETURNS TABLE (row_no INT, cell_no INT, is_header BOOLEAN, text STRING) RETURN
            SELECT cells.* FROM inline(flatten(transform(regexp_extract_all({canonical_sql("markup")}, r'(?is)<tr\b[^>]*>(.*?)</tr>', 1), (body, i) ->
              transform(regexp_extract_all(body, r'(?is)(<t[hd]\b[^>]*>.*?</t[hd]>)', 1), (cell, j) -> struct(
                i + 1, j + 1, lower(left(cell, 3)) = '<th', transform(array({plain}), shown -> {unescape_sql("shown")})[0]
              ))))) AS cells(row_no, cell_no, is_header, text)"""
    )
