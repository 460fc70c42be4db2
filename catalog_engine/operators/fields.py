"""Typed columns from catalogue text: denominations, measures, shapes, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.functions.normalise import hard_trim
from catalog_engine.operators.joins import lookup_nocase

# Vulgar fractions and their plain spelling.
FRACTIONS = {
    "¼": "1/4", "½": "1/2", "¾": "3/4", "⅐": "1/7", "⅑": "1/9", "⅒": "1/10", "⅓": "1/3", "⅔": "2/3", "⅕": "1/5",
    "⅖": "2/5", "⅗": "3/5", "⅘": "4/5", "⅙": "1/6", "⅚": "5/6", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8",
}


def _number(text: Column) -> Column:
    """Plain decimal text as a double; ``try_cast`` alone would also accept suffixes such as ``1.5d``."""
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def parse_denomination(df: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """Add text, decimal value, two remarks, the alternative value and two exception flags.

    The first parenthesis and the lines after the first are remarks; text without a leading number counts as one of it;
    what follows ``=`` is the alternative. ``12/5`` reads as one and two fifths unless ``strict``; ``1,000`` reads as 1; a
    zero denominator gives no value.
    """
    fractions = "".join(FRACTIONS)
    work = df.withColumn("_raw", F.expr(hard_trim(f"replace({column}, '\u00a0', ' ')")))
    work = work.withColumn("_paren", F.regexp_extract("_raw", r"(?s)\((.*?)\)", 0))
    work = work.withColumn("_rest", F.when(F.col("_paren") != "", F.trim(F.replace("_raw", F.col("_paren"), F.lit(" ")))).otherwise(F.col("_raw")))
    lines = F.filter(F.transform(F.split("_rest", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    work = work.withColumn("_lines", lines).withColumn("_main", F.get("_lines", F.lit(0)))
    counted = F.when(F.col("_main").rlike(r"^\p{N}"), F.col("_main")).otherwise(F.concat(F.lit("1 "), F.col("_main")))
    work = work.withColumn("_main", F.when(F.col("_main").isNotNull(), counted))
    has_alt = F.instr("_main", "=") > 0
    work = work.withColumn("_alt", F.when(has_alt, F.trim(F.expr("substr(_main, instr(_main, '=') + 1)"))))
    work = work.withColumn("_norm", F.replace(F.when(has_alt, F.trim(F.substring_index("_main", "=", 1))).otherwise(F.col("_main")), F.lit("⁄"), F.lit("/")))
    spaced = F.regexp_replace("_norm", rf"(?<=\d)(?=[{fractions}])", " ")
    plain = reduce(lambda text, f: F.replace(text, F.lit(f), F.lit(FRACTIONS[f])), FRACTIONS, spaced)
    work = work.withColumn("_slash", F.col("_norm").rlike(r"[a-zA-Z]\s*/\s*[a-zA-Z]"))
    work = work.withColumn("_odd", ~F.trim("_norm").rlike(rf"^[\p{{Nd}}²³¹⁰-⁹₀-₉{fractions}]"))
    work = work.withColumn("_text", plain)
    work = work.withColumn("_calc", F.trim(F.regexp_replace("_text", r"\s+", " ")))
    pattern = r"^(?:(\d+)\s+)?(\d+)/(\d+)" if strict else r"^(\d+)?\s*(\d+)/(\d+)"
    group = lambda i: _filled(F.regexp_extract("_calc", pattern, i)).cast("double")
    fraction = F.coalesce(group(1), F.lit(0.0)) + group(2) / F.nullif(group(3), F.lit(0.0))
    simple = _filled(F.regexp_extract("_calc", r"^(\d+(\.\d+)?)", 1)).cast("double")
    return work.select(
        *df.columns, F.col("_text").alias("denomination_text"), F.when(F.col("_calc").rlike(pattern), fraction).otherwise(simple).alias("denomination_value"),
        F.when(F.col("_paren") != "", F.trim(F.expr("substr(_paren, 2, length(_paren) - 2)"))).alias("info_1"),
        F.when(F.size("_lines") > 1, F.array_join(F.slice("_lines", F.lit(2), F.size("_lines")), " ")).alias("info_2"),
        F.col("_alt").alias("denomination_alt"), F.col("_slash").alias("has_slash"), F.col("_odd").alias("non_digit_start"),
    )


def parse_measure(df: DataFrame, column: str, unit: str, name: str) -> DataFrame:
    """Add ``name`` (number), ``name_info`` (first parenthesis) and ``name_exception`` (the text when it holds no number)."""
    work = df.withColumn("_raw", _filled(F.expr(hard_trim(column))))
    work = work.withColumn("_info", F.trim(_filled(F.regexp_extract("_raw", r"\((.*?)\)", 1))))
    work = work.withColumn("_bare", F.expr(hard_trim(r"regexp_replace(_raw, r'\(.*?\)', '')")))
    value = F.expr(hard_trim(f"regexp_replace(_bare, '{unit}$', '')")) if unit else F.col("_bare")
    work = work.withColumn("_value", _number(F.replace(value, F.lit(","), F.lit("."))))
    return work.select(
        *df.columns, F.col("_value").alias(name), F.col("_info").alias(f"{name}_info"),
        F.when(F.col("_value").isNull(), F.col("_raw")).alias(f"{name}_exception"),
    )


def measure_unit_alarm(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Add ``<column>_value`` per measured column and one message listing those in the wrong unit."""
    values, messages = [], []
    for column, unit in expected.items():
        number = F.replace(F.regexp_extract(column, r"([\d.,]+)\s*([A-Za-z]+)", 1), F.lit(","), F.lit("."))
        found = F.regexp_extract(column, r"([\d.,]+)\s*([A-Za-z]+)", 2)
        fits = F.lower(found) == unit
        values.append(F.when(fits, _number(number)).alias(f"{column}_value"))
        wrong = _number(number).isNotNull() & ~fits
        title = column.replace("_", " ").capitalize()
        messages.append(F.when(wrong, F.concat(F.lit(f"{title} unit mismatch: expected '{unit}', got '"), found, F.lit("'"))))
    work = df.select("*", *values, F.array_compact(F.array(*messages)).alias("_m"))
    return work.withColumn("alarm", F.size("_m") > 0).withColumn("alarm_message", F.when(F.col("alarm"), F.array_join("_m", "; "))).drop("_m")


def parse_shape(df: DataFrame, column: str, dim: DataFrame, dim_name: str, dim_id: str) -> DataFrame:
    """Add ``shape_id`` and ``shape_info`` from ``shape (info)``; an unknown shape is kept in the info and in ``shape_exception``."""
    pattern = r"(?s)^([^(]+)(?:\((.*)\))?"
    work = df.withColumn("_shape", _filled(F.trim(F.regexp_extract(column, pattern, 1)))).withColumn("_info", _filled(F.trim(F.regexp_extract(column, pattern, 2))))
    found = lookup_nocase(work, dim, "_shape", dim_name, dim_id, "shape_id")
    unknown = F.col("shape_id").isNull() & F.col("_shape").isNotNull()
    return found.select(
        *df.columns, "shape_id", F.when(unknown, F.concat_ws(", ", "_shape", "_info")).otherwise(F.col("_info")).alias("shape_info"),
        F.when(unknown, F.col(column)).alias("shape_exception"),
    )


def map_labels(df: DataFrame, label: str, mapping: dict[str, str], out: str = "field") -> DataFrame:
    """Add the field a label stands for, retrying without its ``(unit)``; rows with an unmapped label are dropped."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    clean = F.rtrim(F.lower(F.trim(F.regexp_replace(label, r"[\s\x{00a0}]+", " "))), F.lit(":"))
    bare = F.trim(F.regexp_replace(clean, r"\s*\([^)]*\)", ""))
    field = F.coalesce(F.try_element_at(table, clean), F.try_element_at(table, bare))
    return df.withColumn(out, field).filter(F.col(out).isNotNull())
