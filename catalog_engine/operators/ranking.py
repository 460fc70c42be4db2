"""Ranking, first-of-group choices, orderings and one-dimensional profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.functions.arrays import let
from catalog_engine.functions.normalise import start_year
from catalog_engine.operators.numbering import global_row_number, spread_row_number


def choose_best(df: DataFrame, key: str, row_id: list[str], resolution: str, is_reference: Column, size: str, name: str) -> DataFrame:
    """Rows of groups with several members: survivor or loser, and whether the survivor must become the reference.

    The survivor has the highest resolution, then is a reference, then is the largest, then comes first by name. It is
    found by one aggregate per group and marked by a join, so no group is sorted in one task.
    """
    flagged = df.withColumn("_ref", F.coalesce(is_reference, F.lit(False)))
    best = F.min(F.struct((-F.col(resolution)).alias("a"), (~F.col("_ref")).alias("b"), (-F.col(size)).alias("c"), F.col(name).alias("d"), F.struct(*row_id).alias("id")))
    groups = flagged.groupBy(F.col(key).alias("_key")).agg(
        best.alias("_best"), F.count(F.lit(1)).alias("_n"), F.bool_or("_ref").alias("_any_ref")
    ).filter("_n > 1")
    joined = flagged.join(groups, F.col(key) == F.col("_key"))
    survivor = F.struct(*row_id) == F.col("_best.id")
    promoted = survivor & F.col("_any_ref") & ~F.col("_ref")
    return joined.select(*df.columns, survivor.alias("survivor"), promoted.alias("promoted"))


def first_per_group(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of every key."""
    rest = [c for c in df.columns if c != key and c not in order]
    first = df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(*[F.col(c) if c == key else F.col(f"_first.{c}").alias(c) for c in df.columns])


def latest(df: DataFrame, order: list[str], owners: DataFrame, owner_key: str, key: str) -> DataFrame:
    """The newest row with its owner (a top-1, so nothing is sorted in full)."""
    newest = df.orderBy(*[F.desc(c) for c in order]).limit(1)
    return newest.join(owners, F.col(owner_key) == F.col(key), "left")


def ordinal_positions(df: DataFrame, items: Column, nested: Column) -> DataFrame:
    """1-based place in the outer list and, where an item is itself a list, in the inner one (NULL otherwise).

    ``nested`` turns the column ``item`` into the array of inner items, or NULL when it is a plain one.
    """
    outer = df.select("*", F.posexplode(items).alias("_o", "item"))
    inner = outer.select("*", F.posexplode_outer(nested).alias("_i", "_part"))
    return inner.select(*df.columns, (F.col("_o") + 1).alias("outer_pos"), (F.col("_i") + 1).alias("inner_pos"), F.coalesce("_part", "item").alias("item"))


def pair_by_position(df: DataFrame, key: str, position: str, item: str) -> DataFrame:
    """Item 1 and 2 of a key become face A and B; a single item fills both, further ones are ignored."""
    first, second = (F.max(F.when(F.col(position) == n, F.col(item))) for n in (1, 2))
    return df.groupBy(key).agg(first.alias("face_a"), F.coalesce(second, first).alias("face_b")).filter("face_a IS NOT NULL")


def label_or_position(df: DataFrame, key: str, position: str, label: str, item: str) -> DataFrame:
    """Faces of a key: exactly two items go by position; otherwise by label ending, else by being first or second.

    A later item replaces an earlier one on the same face.
    """
    placed = spread_row_number(df, [key], [F.col(position)], "_place")
    text = F.lower(F.coalesce(label, F.lit("")))
    by_place = F.when(F.col("_place") == 1, "a").when(F.col("_place") == 2, "b")
    by_label = F.when(text.endswith("obverse"), "a").when(text.endswith("reverse"), "b").otherwise(by_place)

    def last(face: Column, which: str) -> Column:
        return F.max(F.when(face == which, F.struct("_place", item)))[item]

    grouped = placed.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), *[last(f, w).alias(f"_{n}{w}") for n, f in (("place", by_place), ("label", by_label)) for w in "ab"]
    )
    return grouped.select(
        key,
        F.when(F.col("_n") == 2, F.col("_placea")).otherwise(F.col("_labela")).alias("face_a"),
        F.when(F.col("_n") == 2, F.col("_placeb")).otherwise(F.col("_labelb")).alias("face_b"),
    )


def order_by_start_year(df: DataFrame, years: str, primary: Column, name: str, row_id: str) -> DataFrame:
    """Rows with their place by start year, primary ones first, then name; unreadable years last."""
    order = [start_year(years), F.when(primary, 0).otherwise(1), F.col(name), F.col(row_id)]
    return global_row_number(df, order, "position")


def reference_first(df: DataFrame, key: str, is_reference: Column, position: list[str]) -> DataFrame:
    """Place inside the key with reference rows first, otherwise in the given order."""
    order = [F.when(is_reference, 0).otherwise(1), *[F.col(p) for p in position]]
    return spread_row_number(df, [key], order, "position")


def catalog_order(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """Place in a simple ordering, NULL first."""
    return global_row_number(df, [F.col(c) for c in [*columns, row_id]], "position")


# --- profiles: one array per picture, one value per pixel column -----------------------------------------------------


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.size(values)


def widest_low_run(profile: str, fraction: int = 3, low: float = 0.2, high: float = 0.8) -> Column:
    """Centre, as a share of the width, of the longest run below mean / ``fraction`` in the middle part; 0.5 without one."""
    values = F.col(profile)
    width = F.size(values)
    total = F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    threshold = F.floor(F.floor(total / width) / fraction)
    start, stop = F.floor(width * low).cast("int"), F.floor(width * high).cast("int")
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("stop"))

    def step(acc: Column, i: Column, limit: Column) -> Column:
        run = F.when(F.get(values, i) < limit, acc["run"] + 1).otherwise(0)
        longer = run > acc["best"]
        return F.struct(run.alias("run"), F.when(longer, run).otherwise(acc["best"]).alias("best"), F.when(longer, i + 1).otherwise(acc["stop"]).alias("stop"))

    def centre(acc: Column) -> Column:
        middle = acc["stop"] - acc["best"] + F.floor(acc["best"] / 2)
        return F.when(acc["best"] > 0, middle / width).otherwise(F.lit(0.5))

    found = let(threshold, lambda limit: F.aggregate(F.sequence(start, stop - 1), zero, lambda acc, i: step(acc, i, limit), centre))
    return F.when(stop > start, found).otherwise(F.lit(0.5))


def peak_in_window(profile: str, start: Column, stop: Column, factor: float = 3.0) -> Column:
    """Place of the highest value in [start, stop) when it exceeds ``factor`` times the mean there, else NULL."""
    window = F.slice(profile, start + 1, F.greatest(stop - start, F.lit(0)))

    def peak(part: Column) -> Column:
        top = F.array_max(part)
        return F.when(top > _mean(part) * factor, start + F.array_position(part, top) - 1)

    return F.when(stop > start, let(window, peak))


def column_energy(cells: str, width: int) -> Column:
    """Per pixel column, the summed change from each row to the next; ``cells`` is one row-major array."""

    def energy(x: Column) -> Column:
        steps = F.sequence(F.lit(0), (F.size(cells) / width).cast("int") - 2)
        here = lambda y: F.get(cells, (y * width + x).cast("int")).cast("double")
        return F.aggregate(steps, F.lit(0.0), lambda acc, y: acc + F.abs(here(y) - here(y + 1)))

    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), energy)
