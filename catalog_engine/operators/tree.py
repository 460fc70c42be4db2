"""Hierarchies stored as (id, parent id).

Only the inner nodes, those with children, are walked level by level from the roots: each round joins them to the level
above, so the number of rounds is the depth of the tree. A level is written to the shared folder before the next one starts,
which keeps plans short and survives lost executors. The leaves, usually most of the table, are attached by one last join
and never written. Nodes inside a parent cycle hang below no root and are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.functions.normalise import fold_text
from catalog_engine.operators.numbering import global_row_number
from catalog_engine.workspace import staged

PATH_SEPARATOR = " -> "


def resolve_slug_parents(nodes: DataFrame, key: str, slug: str, parent_slug: str) -> DataFrame:
    """Add ``parent_id`` for parents given by slug; of several rows with one slug the lowest id counts."""
    first = nodes.groupBy(F.col(slug).alias("_slug")).agg(F.min(key).alias("parent_id"))
    return nodes.join(first, F.col(parent_slug) == F.col("_slug"), "left").drop("_slug")


def tree_paths(nodes: DataFrame, key: str, parent: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """Add ``depth``, ``root_id``, ``ancestors`` (root to self) and, per ``carry`` item, its values along that path.

    A node whose parent is missing or unknown is a root; nodes that reach none, because their parents form a loop, are left
    out. Every node holds a piece of its path and the node above that piece; each round puts the piece of that node before its
    own, so a tree of depth d takes log2(d) rounds.
    """
    carry = carry or {}
    known = nodes.select(F.col(key).alias("_known")).distinct()
    linked = nodes.join(known, F.col(parent) == F.col("_known"), "left")
    lists = ["ancestors", *carry]
    state = staged(linked.select(*nodes.columns, F.col("_known").alias("_above"), F.array(key).alias("ancestors"), *[F.array(c).alias(n) for n, c in carry.items()]), "tree")
    waiting = state.filter("_above IS NOT NULL").count()
    while waiting:
        above = state.select(F.col(key).alias("_key"), F.col("_above").alias("_next"), *[F.col(n).alias(f"_up_{n}") for n in lists])
        joined = state.join(above, F.col("_above") == F.col("_key"), "left")
        longer = [F.when(F.col("_key").isNull(), F.col(n)).otherwise(F.concat(f"_up_{n}", n)).alias(n) for n in lists]
        state = staged(joined.select(*nodes.columns, F.col("_next").alias("_above"), *longer), "tree")
        left = state.filter("_above IS NOT NULL").count()
        if left == waiting:  # as long as a path is unfinished, a shorter one gets finished; so these are loops
            break
        waiting = left
    done = state.filter("_above IS NULL")
    return done.select(*nodes.columns, (F.size("ancestors") - 1).alias("depth"), F.get("ancestors", F.lit(0)).alias("root_id"), *lists)


def tree_closure(nodes: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """Every (ancestor, descendant) pair with its distance, and the root and name path of the descendant."""
    paths = tree_paths(nodes, key, parent, {"names": F.col(name)})
    pairs = paths.select("*", F.posexplode("ancestors").alias("_pos", "ancestor"))
    return pairs.select(
        "ancestor", F.col(key).alias("descendant"), (F.col("depth") - F.col("_pos")).alias("distance"), "root_id",
        F.array_join("names", PATH_SEPARATOR).alias("path"),
    )


def tree_listing(nodes: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """Nodes in display order: children below their parent, siblings by lower-case name, with depth and position."""
    paths = tree_paths(nodes, key, parent, {"_sort": F.struct(F.lower(name).alias("n"), F.col(key).alias("k"))})
    return global_row_number(paths, [F.col("_sort")], "position").select(*nodes.columns, "depth", "position")


def _childless(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    parents = nodes.select(F.col(parent).alias("_parent")).dropna().distinct()
    return nodes.join(parents, F.col(key) == F.col("_parent"), "left_anti")


def leaf_paths(nodes: DataFrame, key: str, parent: str, name: str, keep: DataFrame, keep_key: str) -> DataFrame:
    """Leaves with content, and their path of names."""
    paths = tree_paths(nodes, key, parent, {"names": F.col(name)})
    leaves = _childless(paths, key, parent).join(keep.select(F.col(keep_key).alias("_keep")).distinct(), F.col(key) == F.col("_keep"), "left_semi")
    return leaves.select(key, F.array_join("names", PATH_SEPARATOR).alias("path"))


def owner_of_path(nodes: DataFrame, key: str, parent: str, wanted) -> DataFrame:
    """The path from the root down to one node, found by walking up from it: one scan per level and nothing to shuffle."""
    links = nodes.select(key, F.col(parent).alias("_up"))
    steps, seen = [staged(links.filter(F.col(key) == F.lit(wanted)), "path")], {wanted}
    while True:
        above = steps[-1].select(F.col("_up").alias("_next")).dropna()
        step = staged(links.join(F.broadcast(above), F.col(key) == F.col("_next"), "left_semi"), "path")  # a single id
        found = step.first()
        if found is None or found[key] in seen:  # a root, or a loop of parents
            break
        seen.add(found[key])
        steps.append(step)
    numbered = [s.select(F.lit(i).alias("step"), key) for i, s in enumerate(reversed(steps))]
    return reduce(lambda a, b: a.unionByName(b), numbered)


def tree_filter_ancestors(nodes: DataFrame, key: str, parent: str, matches: Column) -> DataFrame:
    """Nodes that match or lead to a match."""
    paths = tree_paths(nodes, key, parent, {"_hits": matches})
    wanted = paths.filter(F.element_at("_hits", -1)).select(F.explode("ancestors").alias("_wanted")).distinct()
    return nodes.join(wanted, F.col(key) == F.col("_wanted"), "left_semi")


def tree_filter_both(nodes: DataFrame, key: str, parent: str, matches: Column) -> DataFrame:
    """Nodes that match, lead to a match or lie below one; ``expand`` marks those holding a match at or below them."""
    paths = tree_paths(nodes, key, parent, {"_hits": matches})
    holding = paths.filter(F.element_at("_hits", -1)).select(F.explode("ancestors").alias("_holding")).distinct()
    joined = paths.join(holding, F.col(key) == F.col("_holding"), "left").withColumn("expand", F.col("_holding").isNotNull())
    return joined.filter(F.col("expand") | F.array_contains("_hits", True)).select(*nodes.columns, "expand")


def leaf_index(nodes: DataFrame, key: str, parent: str, name: str, territory: str, historical: str) -> DataFrame:
    """Leaves under their first letter (``#`` for anything else), flagged when they stand for their whole root.

    A leaf does when it is a root itself, or is named like its root and has no territory type; for a historical leaf a
    parenthesis at the end of the name does not count.
    """
    leaves = _childless(tree_paths(nodes, key, parent, {"_names": F.col(name)}), key, parent)
    letters = rf"regexp_replace(translate({name}, 'Đđ', 'Dd'), r'^[^\p{{L}}\p{{N}}]+', '')"
    first = F.upper(fold_text(f"substr({letters}, 1, 1)"))
    plain = F.when(F.coalesce(F.col(historical).cast("boolean"), F.lit(False)), F.regexp_replace(name, r"\s*\(.*\)$", "")).otherwise(F.col(name))
    same = (plain == F.element_at("_names", 1)) & (F.coalesce(territory, F.lit("")) == "")
    return leaves.select(
        *nodes.columns, F.when(first.rlike("^[A-Z]"), first).otherwise("#").alias("letter"),
        ((F.col("depth") == 0) | F.coalesce(same, F.lit(False))).alias("top_level"),
    )


def node_weight(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """One plus the number of direct children."""
    counts = nodes.groupBy(F.col(parent).alias("_parent")).agg(F.count(F.lit(1)).alias("_n"))
    return nodes.join(counts, F.col(key) == F.col("_parent"), "left").select(*nodes.columns, (1 + F.coalesce("_n", F.lit(0))).alias("weight"))
