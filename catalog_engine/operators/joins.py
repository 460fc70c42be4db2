"""Joins between catalogue tables.

No join here is hinted: build sides are left to the optimiser's size estimate, and the adaptive skew join splits hot keys.
Sides that only answer "is there one" are made distinct first, so a hot key on them shrinks to one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, live: Column, order: list[str]) -> DataFrame:
    """Parents with their live children, ordered; the filter sits on the join so childless parents stay."""
    joined = parents.join(children.filter(live), F.col(key) == F.col(child_key), "left")
    return joined.orderBy(*[F.asc_nulls_first(c) for c in order])


def join_star(facts: DataFrame, entities: DataFrame, owners: DataFrame, fact_key: tuple[str, str], owner_key: tuple[str, str]) -> DataFrame:
    """Facts with their entity and the owner of that entity."""
    return facts.join(entities, F.col(fact_key[0]) == F.col(fact_key[1])).join(owners, F.col(owner_key[0]) == F.col(owner_key[1]))


def semi_owners(owners: DataFrame, entities: DataFrame, children: DataFrame, owner_key: tuple[str, str], child_key: tuple[str, str]) -> DataFrame:
    """Owners with at least one entity that has one of the given children."""
    touched = children.select(child_key[1]).distinct()
    held = entities.join(touched, F.col(child_key[0]) == F.col(child_key[1]), "left_semi").select(owner_key[1]).distinct()
    return owners.join(held, F.col(owner_key[0]) == F.col(owner_key[1]), "left_semi")


def leaf_nodes(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """Nodes that are nobody's parent."""
    parents = nodes.select(F.col(parent).alias("_parent")).dropna().distinct()
    return nodes.join(parents, F.col(key) == F.col("_parent"), "left_anti")


def anti_missing(found: DataFrame, existing: DataFrame, key: str, existing_key: str) -> DataFrame:
    """Rows whose key is not in the existing table; rows without a key are skipped."""
    known = existing.select(F.col(existing_key).alias("_known")).dropna().distinct()
    return found.filter(F.col(key).isNotNull()).join(known, F.col(key) == F.col("_known"), "left_anti")


def inventory_path(group: str, slug: str, entity: str, year: str, item: str) -> Column:
    """Expected file of one face; a missing year is written XXXX."""
    folder = F.concat(F.col(slug), F.lit("-"), F.col(entity))
    name = F.concat_ws("-", F.coalesce(F.col(year).cast("string"), F.lit("XXXX")), F.col(item), F.col("side"))
    return F.concat_ws("/", F.col(group), folder, F.concat(name, F.lit(".jpg")))


def inventory_missing(expected: DataFrame, path: Column, listing: DataFrame, listed: str) -> DataFrame:
    """One row per record and side whose expected path (an expression that may use ``side``) is not in the listing."""
    sides = expected.withColumn("side", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("expected_path", path)
    return sides.join(listing.select(F.col(listed).alias("_listed")).distinct(), F.col("expected_path") == F.col("_listed"), "left_anti")


def asset_complete(entities: DataFrame, key: str, assets: DataFrame, asset_key: str, path: str, listing: DataFrame, listed: str) -> DataFrame:
    """Entities flagged complete when every one of their assets is in the listing (also when they have none)."""
    present = listing.select(F.col(listed).alias("_listed")).distinct()
    checked = assets.join(present, F.col(path) == F.col("_listed"), "left")
    gaps = checked.groupBy(F.col(asset_key).alias("_key")).agg(
        F.count_if(F.col("_listed").isNull()).alias("missing_assets"), F.count(F.lit(1)).alias("assets")
    )
    joined = entities.join(gaps, F.col(key) == F.col("_key"), "left").drop("_key")
    filled = joined.fillna(0, ["missing_assets", "assets"])
    return filled.withColumn("complete", F.col("missing_assets") == 0)


def lookup_nocase(df: DataFrame, dim: DataFrame, name: str, dim_name: str, dim_id: str, out: str) -> DataFrame:
    """Dimension id by trimmed case-insensitive name, the lowest id on a tie, NULL when unknown."""
    first = dim.groupBy(F.lower(F.trim(dim_name)).alias("_name")).agg(F.min(dim_id).alias(out))
    return df.join(first, F.lower(F.trim(name)) == F.col("_name"), "left").drop("_name")


def link_pairs(pairs: DataFrame, child: str, parent: str, dim: DataFrame, slug: str, dim_id: str, existing: DataFrame) -> DataFrame:
    """(child_id, parent_id) for slug pairs: self-links, unknown slugs and known pairs left out."""
    with_child = lookup_nocase(pairs, dim, child, slug, dim_id, "child_id")
    with_both = lookup_nocase(with_child, dim, parent, slug, dim_id, "parent_id")
    resolved = with_both.select("child_id", "parent_id").filter(F.col("child_id") != F.col("parent_id")).distinct()
    return resolved.join(existing.select("child_id", "parent_id"), ["child_id", "parent_id"], "left_anti")


def match_variants(df: DataFrame, row_key: str, id_col: str, years: str, variants: str, ref: DataFrame, ref_id: str, ref_years: str, ref_name: str) -> DataFrame:
    """Flag ``is_match``: the reference knows the id under one of the name variants with the same years (or no years given)."""
    wide = df.select(row_key, id_col, F.coalesce(years, F.lit("")).alias("_years"), F.explode(variants).alias("_name"))
    dated = ref.select(F.col(ref_id).alias("_rid"), F.col(ref_name).alias("_rname"), F.col(ref_years).alias("_ryears")).distinct()
    same = (F.col(id_col) == F.col("_rid")) & (F.col("_name") == F.col("_rname"))
    with_years = wide.filter("_years <> ''").join(dated, same & (F.col("_years") == F.col("_ryears")), "left_semi")
    undated = wide.filter("_years = ''").join(dated.select("_rid", "_rname").distinct(), same, "left_semi")
    hits = with_years.unionByName(undated).select(F.col(row_key).alias("_hit")).distinct()
    return df.join(hits, F.col(row_key) == F.col("_hit"), "left").withColumn("is_match", F.col("_hit").isNotNull().cast("int")).drop("_hit")


HEAD = 4  # letters by which names first meet the lengths of owner names


def auto_associate(items: DataFrame, owners: DataFrame) -> DataFrame:
    """Link items (row_id, owner_name, owner_id, is_manual) to owners (id, name, territory, is_section) by rule.

    A section yields to a leaf of the same name and then changes nothing. An owner without territory takes items named
    like it; one with territory takes ``name…territory`` and, when it is the only leaf of that name, also ``name``.
    Automatic links that no longer fit are released and go to the lowest fitting owner, manual ones are not touched.
    """
    leaf = ~F.coalesce(F.col("is_section").cast("boolean"), F.lit(False))
    leaves = owners.filter(leaf).groupBy(F.col("name").alias("_name")).agg(F.count(F.lit(1)).alias("_leaves"))
    rules = (
        owners.join(leaves, F.col("name") == F.col("_name"), "left")
        .withColumn("_leaves", F.coalesce("_leaves", F.lit(0)))
        .withColumn("_typed", F.coalesce("territory", F.lit("")) != "")
        .withColumn("_active", leaf | (F.col("_leaves") == 0))
        .select("id", "name", F.lower("name").alias("_prefix"), F.lower("territory").alias("_suffix"), "_leaves", "_typed", "_active")
    )
    active = rules.filter("_active")
    exact = active.filter("NOT _typed OR _leaves <= 1").select(F.col("name").alias("item_name"), F.col("id").alias("owner"))

    # name…territory as an equi-join: of the prefixes of a name only those as long as an owner name of the same beginning
    typed = active.filter("_typed")
    sizes = typed.groupBy(F.left("_prefix", F.lit(HEAD)).alias("_head")).agg(F.collect_set(F.length("_prefix")).alias("_sizes"))
    names = items.select(F.col("owner_name").alias("item_name")).dropna().distinct().withColumn("_text", F.lower("item_name"))
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("_text"), F.lit(HEAD)))), lambda n: F.left(F.col("_text"), n))
    met = names.withColumn("_head", F.explode(heads)).join(sizes, "_head")
    prefixes = met.select("item_name", "_text", F.explode(F.filter("_sizes", lambda n: n <= F.length("_text"))).alias("_size")).withColumn("_start", F.left("_text", F.col("_size")))
    fits = F.col("_text").endswith(F.col("_suffix")) & (F.length("_text") >= F.length("_prefix") + F.length("_suffix"))
    patterned = prefixes.join(typed, (F.col("_start") == F.col("_prefix")) & fits).select("item_name", F.col("id").alias("owner"))

    candidates = exact.unionByName(patterned)
    # which owner would take an unlinked item of this name
    lowest = candidates.groupBy("item_name").agg(F.min("owner").alias("_lowest"))
    # does the present owner still fit
    fitting = candidates.select(F.col("item_name").alias("_fit_name"), F.col("owner").alias("_fit_owner")).distinct()
    present = rules.select(F.col("id").alias("_present"), "_active")
    manual = F.coalesce(F.col("is_manual").cast("boolean"), F.lit(False))
    joined = (
        items.join(lowest, F.col("owner_name") == F.col("item_name"), "left")
        .join(fitting, (F.col("owner_name") == F.col("_fit_name")) & (F.col("owner_id") == F.col("_fit_owner")), "left")
        .join(present, F.col("owner_id") == F.col("_present"), "left")
    )
    released = F.col("_active") & F.col("_fit_owner").isNull()
    free = ~manual & (F.col("owner_id").isNull() | F.coalesce(released, F.lit(False)))
    return joined.select(*[c for c in items.columns], F.when(free, F.col("_lowest")).otherwise(F.col("owner_id")).alias("new_owner_id"))


def pairwise_within(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per group, how many unordered pairs of rows there are and how many agree or differ in ``value``.

    Computed from counts: the pairs themselves, quadratic in a hot group, are never formed.
    """
    per_value = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))

    def pairs(n: Column) -> Column:
        return (n * (n - 1) / 2).cast("bigint")

    totals = per_value.groupBy(key).agg(F.sum("_n").alias("n_rows"), F.sum(pairs(F.col("_n"))).alias("equal_pairs"))
    return totals.filter("n_rows > 1").select(
        key, "n_rows", pairs(F.col("n_rows")).alias("n_pairs"), "equal_pairs", (pairs(F.col("n_rows")) - F.col("equal_pairs")).alias("different_pairs")
    )


def match_reference(rows: DataFrame, group: str, is_reference: Column, order: str, fields: list[str]) -> DataFrame:
    """Every non-reference row next to the first reference row of its group; groups lacking either are dropped."""
    flagged = rows.withColumn("_ref", is_reference)
    refs = flagged.filter("_ref").groupBy(F.col(group).alias("_group")).agg(F.min(F.struct(order, *fields)).alias("reference"))
    return flagged.filter(~F.col("_ref")).join(refs, F.col(group) == F.col("_group")).drop("_ref", "_group")

