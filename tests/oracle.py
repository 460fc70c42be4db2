"""Run a query and its SQL twin side by side and compare them value by value."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(body, key=repr)


def compare(df, con, sql) -> tuple[int, str | None]:
    spark_side = table(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(spark_side[1]), None if spark_side[1] else "no rows"
    cursor = con.execute(sql)
    sql_side = table([d[0] for d in cursor.description], cursor.fetchall())
    if spark_side[0] != sql_side[0]:
        return len(spark_side[1]), f"columns {spark_side[0]} against {sql_side[0]}"
    if spark_side[1] == sql_side[1]:
        return len(spark_side[1]), None if spark_side[1] else "no rows"
    left, right = spark_side[1], sql_side[1]
    only_left = [r for r in left if r not in set(right)][:3]
    only_right = [r for r in right if r not in set(left)][:3]
    return len(left), f"{len(left)} rows against {len(right)}; columns {spark_side[0]}; only here {only_left}; only there {only_right}"
