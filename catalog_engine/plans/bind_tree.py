"""Hierarchy operators on region → nation → customer, with ids prefixed by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catalog_engine.operators import tree as op
from catalog_engine.plans.binding import bind
from catalog_engine.workspace import staged

NODES_SQL = """SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
    UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 97 = 0 THEN 'n99' ELSE 'n' || c_nationkey END, c_name FROM customer"""
PATHS_SQL = f"""WITH RECURSIVE nodes AS ({NODES_SQL}), paths AS (
    SELECT id, parent, name, 0 AS depth, id AS root_id, [id] AS ancestors, [name] AS names FROM nodes WHERE parent IS NULL OR parent NOT IN (SELECT id FROM nodes)
    UNION ALL SELECT n.id, n.parent, n.name, p.depth + 1, p.root_id, list_append(p.ancestors, n.id), list_append(p.names, n.name) FROM nodes n JOIN paths p ON n.parent = p.id)"""


def nodes(t):
    c = F.col("c_custkey")
    levels = [
        t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name")),
        t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name")),
        t.customer.select(
            F.concat(F.lit("c"), c).alias("id"), F.when(c % 97 == 0, "n99").otherwise(F.concat(F.lit("n"), "c_nationkey")).alias("parent"), F.col("c_name").alias("name")
        ),
    ]
    return reduce(lambda a, b: a.unionByName(b), levels)


@bind(
    "tree_closure",
    f"""{PATHS_SQL} SELECT a AS ancestor, id AS descendant, depth - (i - 1) AS distance, root_id, path FROM (
        SELECT id, depth, root_id, array_to_string(names, ' -> ') AS path, unnest(ancestors) AS a, generate_subscripts(ancestors, 1) AS i FROM paths)""",
)
def _(t):
    return op.tree_closure(nodes(t), "id", "parent", "name")


@bind(
    "tree_listing",
    f"""{PATHS_SQL}, sorted AS (SELECT *, list_transform(list_zip(names, ancestors), lambda z: lower(z[1]) || chr(1) || z[2]) AS sort FROM paths)
        SELECT id, parent, name, depth, row_number() OVER (ORDER BY sort) AS position FROM sorted""",
)
def _(t):
    return op.tree_listing(nodes(t), "id", "parent", "name")


@bind(
    "leaf_paths",
    f"""{PATHS_SQL} SELECT id, array_to_string(names, ' -> ') AS path FROM paths WHERE id NOT IN (SELECT parent FROM nodes WHERE parent IS NOT NULL)
        AND id IN (SELECT 'c' || o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def _(t):
    keep = t.orders.filter("o_orderstatus = 'P'").select(F.concat(F.lit("c"), "o_custkey").alias("k"))
    return op.leaf_paths(nodes(t), "id", "parent", "name", keep, "k")


@bind("owner_of_path", f"{PATHS_SQL} SELECT unnest(ancestors) AS id, generate_subscripts(ancestors, 1) - 1 AS step FROM paths WHERE id = 'c42'")
def _(t):
    return op.owner_of_path(nodes(t), "id", "parent", "c42")


@bind(
    "tree_filter_ancestors",
    f"""{PATHS_SQL}, hit AS (SELECT ancestors FROM paths WHERE name LIKE '%77%' OR name = 'NATION_3') SELECT id, parent, name FROM nodes
        WHERE id IN (SELECT unnest(ancestors) FROM hit)""",
)
def _(t):
    return op.tree_filter_ancestors(nodes(t), "id", "parent", F.col("name").contains("77") | (F.col("name") == "NATION_3"))


@bind(
    "tree_filter_both",
    f"""{PATHS_SQL}, hit AS (SELECT id, ancestors FROM paths WHERE name LIKE '%77%' OR name = 'NATION_3'), up AS (SELECT DISTINCT unnest(ancestors) AS id FROM hit)
        SELECT id, parent, name, id IN (SELECT id FROM up) AS expand FROM paths WHERE id IN (SELECT id FROM up) OR list_has_any(ancestors, (SELECT list(id) FROM hit))""",
)
def _(t):
    return op.tree_filter_both(nodes(t), "id", "parent", F.col("name").contains("77") | (F.col("name") == "NATION_3"))


@bind(
    "leaf_index",
    f"""{PATHS_SQL}, named AS (SELECT id, CASE right(id, 1) WHEN '1' THEN '  «Élan»' WHEN '2' THEN 'Đ' || name WHEN '3' THEN '42' WHEN '4' THEN names[1] || ' (x)' ELSE name END AS nm,
            CASE WHEN depth = 0 THEN name ELSE names[1] END AS root_name, depth, right(id, 2) AS tail FROM paths WHERE id NOT IN (SELECT parent FROM nodes WHERE parent IS NOT NULL))
        SELECT id, CASE right(id, 1) WHEN '1' THEN 'E' WHEN '2' THEN 'D' WHEN '3' THEN '#' ELSE upper(left(nm, 1)) END AS letter,
          depth = 0 OR (right(id, 1) = '4' AND tail NOT IN ('14', '34')) AS top_level FROM named""",
)
def _(t):
    # leaves named like their root need the root's name, so the names are built from one walk of the tree
    named = op.tree_paths(nodes(t), "id", "parent", {"names": F.col("name")})
    last = F.right("id", F.lit(1))
    leaf = F.substr("id", F.lit(1), F.lit(1)) == "c"
    label = (
        F.when(last == "1", "  «Élan»").when(last == "2", F.concat(F.lit("Đ"), "name")).when(last == "3", "42")
        .when(last == "4", F.concat(F.element_at("names", 1), F.lit(" (x)"))).otherwise(F.col("name"))
    )
    rows = named.select("id", "parent", F.when(leaf, label).otherwise(F.col("name")).alias("name"), F.when(F.right("id", F.lit(2)) == "14", "City").alias("territory"), (F.right("id", F.lit(2)) != "34").alias("historical"))
    return op.leaf_index(staged(rows, "nodes"), "id", "parent", "name", "territory", "historical").select("id", "letter", "top_level")


@bind("node_weight", f"WITH nodes AS ({NODES_SQL}) SELECT id, parent, name, 1 + (SELECT count(*) FROM nodes c WHERE c.parent = nodes.id) AS weight FROM nodes")
def _(t):
    return op.node_weight(nodes(t), "id", "parent")
