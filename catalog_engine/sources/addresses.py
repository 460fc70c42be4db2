"""Addresses: listing pages to fetch and full locations of stored images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expand_pages(df: DataFrame, url: str, last_page: Column, first_page: Column | None = None) -> DataFrame:
    """One row per page: an existing ``page=`` number is replaced, otherwise one is appended."""
    start = first_page if first_page is not None else F.lit(1)
    pages = F.when(last_page >= start, F.sequence(start.cast("int"), last_page.cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = df.withColumn("page", F.explode(pages))
    replaced = F.regexp_replace(F.col(url), F.lit(r"(page=)\d+"), F.concat(F.lit("$1"), F.col("page").cast("string")))
    appended = F.concat(F.col(url), F.lit("&page="), F.col("page"))
    return rows.withColumn("page_url", F.when(F.contains(url, F.lit("page=")), replaced).otherwise(appended))


def asset_url(kind: Column, name: str, slug: str, bases: dict[int, str]) -> Column:
    """Download address by sample kind; reference images (kind 1) live in the owner's folder under their original name."""
    original = F.regexp_replace(name, r"^(.*?)(\.[^.]*)?$", "$1-original$2")
    result = F.when(kind == 1, F.concat(F.lit(bases[1]), F.col(slug), F.lit("/"), original))
    result = result.when(kind == 2, F.concat(F.lit(bases[2]), F.col(name)))
    return result.otherwise(F.concat(F.lit(bases[3]), F.col(name)))


def face_url(base: str, prefix: str, item: str, side: Column, file: str) -> Column:
    """Address of one face: base, folder, ``item-side``, file."""
    return F.concat(F.lit(base), F.concat_ws("/", F.col(prefix), F.concat_ws("-", F.col(item), side), F.col(file)))


def face_file(year: str, item: str, side: Column) -> Column:
    """Local file name of one face; a missing year is written XXXX."""
    return F.concat(F.concat_ws("-", F.coalesce(F.col(year).cast("string"), F.lit("XXXX")), F.col(item), side), F.lit(".jpg"))
