"""Row filters, predicates and listing projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.functions.normalise import fold_text, literal
from catalog_engine.operators.numbering import spread_row_number


def live_rows(df: DataFrame, removed: Column) -> DataFrame:
    """Rows not soft-deleted; an unknown flag counts as live."""
    return df.filter(~F.coalesce(removed.cast("boolean"), F.lit(False)))


def filter_curated(df: DataFrame, fixed: Column, mode: str) -> DataFrame:
    """``all``, ``hide_fixed`` (unknown counts as not fixed) or ``only_fixed``."""
    is_fixed = F.coalesce(fixed.cast("boolean"), F.lit(False))
    if mode == "all":
        return df
    if mode == "hide_fixed":
        return df.filter(~is_fixed)
    if mode == "only_fixed":
        return df.filter(is_fixed)
    raise ValueError(f"unknown mode {mode!r}")


def search_contains(df: DataFrame, column: str, text: str | None) -> DataFrame:
    """Case-insensitive substring search; blank text keeps every row."""
    if not text or not text.strip():
        return df
    return df.filter(F.contains(F.lower(column), F.lower(F.lit(text))))


def search_word_prefix(df: DataFrame, column: str, text: str | None) -> DataFrame:
    """Rows whose folded text, or any word of it, starts with the folded search text."""
    if not text or not text.strip():
        return df
    wanted = fold_text(literal(text))
    # a word starts either at the beginning or after the single separating space
    return df.filter(F.contains(F.concat(F.lit(" "), fold_text(column)), F.concat(F.lit(" "), wanted)))


def lookup_entity(df: DataFrame, key: str, text: str) -> DataFrame:
    """Point lookup by an id given as text; text that is no number finds nothing."""
    return df.filter(F.col(key) == F.lit(text).try_cast("bigint"))


def resume_from(df: DataFrame, order: str, key: str, value) -> DataFrame:
    """Rows from the first match of ``key = value`` to the end of the ordering; none without a match."""
    start = df.filter(F.col(key) == F.lit(value)).agg(F.min(order)).scalar()
    return df.filter(F.col(order) >= start)


def changed_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New rows that differ from the old row of the same key; NULL and empty text are the same."""

    def text(side: str, c: str) -> Column:
        return F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit(""))

    differs = F.lit(False)
    for c in columns:
        differs = differs | (text("o", c) != text("n", c))
    return new.alias("n").join(old.alias("o"), F.col(f"n.{key}") == F.col(f"o.{key}")).filter(differs).select("n.*")


def project_listing(
    parents: DataFrame, children: DataFrame, key: str, child_key: str, order: list[str], faces: list[str]
) -> DataFrame:
    """Each parent with the faces of its first child (lowest ``order``), childless parents kept.

    ``min`` over a struct combines on the map side, so a parent with very many children costs one row per task.
    """
    first = children.groupBy(F.col(child_key).alias("_key")).agg(F.min(F.struct(*order, *faces)).alias("_first"))
    joined = parents.join(first, parents[key] == first["_key"], "left")
    return joined.select(*[parents[c] for c in parents.columns], *[F.col(f"_first.{f}").alias(f) for f in faces])


def project_detail(
    parents: DataFrame, children: DataFrame, key: str, child_key: str, order: list[Column], fields: list[str], chunk: int = 1000
) -> DataFrame:
    """Each parent with its children nested as ordered lists.

    A list holds at most ``chunk`` children; parents with more get several rows, numbered by ``chunk_no``, so no single
    record grows without bound and no child is left out.
    """
    numbered = spread_row_number(children, [child_key], order, "_pos")
    lists = (
        numbered.withColumn("chunk_no", F.floor((F.col("_pos") - 1) / chunk))
        .groupBy(F.col(child_key).alias("_key"), "chunk_no")
        .agg(F.sort_array(F.collect_list(F.struct("_pos", *fields))).alias("_list"))
    )
    nested = F.transform("_list", lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    joined = parents.join(lists, parents[key] == lists["_key"], "left")
    return joined.select(*[parents[c] for c in parents.columns], F.coalesce("chunk_no", F.lit(0)).alias("chunk_no"), nested.alias("children"))


def is_combined(a: str, b: str) -> Column:
    """Both faces come from one file."""
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def guard_delete(df: DataFrame, key: str, kind: Column, deletable: int = 3) -> DataFrame:
    """Rows that may go: of the deletable kind and not the last one of it for their key."""
    flagged = df.withColumn("_d", kind == deletable)
    spare = flagged.filter("_d").groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return flagged.filter("_d").join(spare, F.col(key) == F.col("_key"), "left_semi").select(*df.columns)


def valid_records(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows in which every required column is present and not blank."""
    kept = df.dropna(subset=required)
    for name, dtype in kept.select(*required).dtypes:
        if dtype == "string":
            kept = kept.filter(F.trim(name) != "")
    return kept
