"""Joins on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_engine.functions.normalise import name_variants
from catalog_engine.operators import joins as op
from catalog_engine.operators.filters import live_rows
from catalog_engine.plans.bind_filters import LINE_KEY, removed
from catalog_engine.plans.binding import bind


@bind(
    "join_children",
    """SELECT o_orderkey, o_orderpriority, l_linenumber, l_partkey, l_suppkey FROM orders
       LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag <> 'R'""",
)
def _(t):
    live = F.coalesce(removed(), F.lit(0)) == 0
    joined = op.join_children(t.orders, t.lineitem, "o_orderkey", "l_orderkey", live, ["o_orderpriority", "l_linenumber"])
    return joined.select("o_orderkey", "o_orderpriority", *LINE_KEY[1:])


@bind(
    "join_star",
    """SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey""",
)
def _(t):
    star = op.join_star(t.lineitem, t.orders, t.customer, ("l_orderkey", "o_orderkey"), ("o_custkey", "c_custkey"))
    return star.select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "c_name")


@bind(
    "semi_owners",
    """SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
         WHERE l_returnflag <> 'R')""",
)
def _(t):
    children = live_rows(t.lineitem, removed())
    owners = t.customer.select("c_custkey", "c_name")
    return op.semi_owners(owners, t.orders, children, ("c_custkey", "o_custkey"), ("o_orderkey", "l_orderkey"))


@bind("leaf_nodes", "SELECT n_nationkey AS id, n_regionkey AS parent FROM nation WHERE n_nationkey NOT IN (SELECT n_regionkey FROM nation)")
def _(t):
    nodes = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("parent"))
    return op.leaf_nodes(nodes, "id", "parent")


@bind("anti_missing", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(t):
    return op.anti_missing(t.orders.select("o_orderkey", "o_custkey"), t.lineitem, "o_orderkey", "l_orderkey")


@bind(
    "inventory_missing",
    """WITH e AS (SELECT o_orderkey, side, o_orderstatus || '/' || o_orderpriority || '-' || o_orderkey || '/' ||
                    CASE WHEN o_orderkey % 9 = 0 THEN 'XXXX' ELSE year(o_orderdate)::VARCHAR END || '-' || o_custkey || '-' || side || '.jpg' AS expected_path
                  FROM orders, (VALUES (1), (2)) s(side)),
            listing AS (SELECT DISTINCT o_orderstatus || '/' || o_orderpriority || '-' || o_orderkey || '/' ||
                    CASE WHEN o_orderkey % 9 = 0 THEN 'XXXX' ELSE year(o_orderdate)::VARCHAR END || '-' || o_custkey || '-' || (1 + l_linenumber % 2) || '.jpg' AS path
                  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R')
       SELECT * FROM e WHERE expected_path NOT IN (SELECT path FROM listing)""",
)
def _(t):
    year = F.when(F.col("o_orderkey") % 9 != 0, F.year("o_orderdate"))
    orders = t.orders.withColumn("year", year)
    path = op.inventory_path("o_orderstatus", "o_orderpriority", "o_orderkey", "year", "o_custkey")
    lines = t.lineitem.filter("l_returnflag <> 'R'").select("l_orderkey", (1 + F.col("l_linenumber") % 2).alias("side"))
    listing = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select(path.alias("path"))
    return op.inventory_missing(orders, path, listing, "path").select("o_orderkey", "side", "expected_path")


@bind(
    "asset_complete",
    """WITH a AS (SELECT o_orderkey AS k, 'h' || o_orderkey AS p FROM orders UNION ALL SELECT l_orderkey, l_orderkey || '/' || l_linenumber FROM lineitem),
            listing AS (SELECT 'h' || o_orderkey AS p FROM orders WHERE o_orderkey % 13 <> 0
                        UNION SELECT l_orderkey || '/' || l_linenumber FROM lineitem WHERE l_discount <= 0.08),
            c AS (SELECT k, count(*) AS assets, count(*) FILTER (WHERE p NOT IN (SELECT p FROM listing)) AS missing_assets FROM a GROUP BY k)
       SELECT o_orderkey, missing_assets, assets, missing_assets = 0 AS complete FROM orders JOIN c ON k = o_orderkey""",
)
def _(t):
    pages = t.orders.select(F.col("o_orderkey").alias("k"), F.concat(F.lit("h"), "o_orderkey").alias("p"))
    line_path = F.concat_ws("/", "l_orderkey", "l_linenumber").alias("p")
    assets = pages.union(t.lineitem.select("l_orderkey", line_path))
    listing = pages.filter("k % 13 <> 0").select("p").union(t.lineitem.filter("l_discount <= 0.08").select(line_path))
    return op.asset_complete(t.orders.select("o_orderkey"), "o_orderkey", assets, "k", "p", listing, "p")


@bind(
    "lookup_nocase",
    """SELECT s_suppkey, wanted, (SELECT min(n_nationkey) FROM nation WHERE lower(trim(n_name)) = lower(trim(wanted))) AS nation_id
       FROM (SELECT s_suppkey, ' nation_' || (s_suppkey % 30) || ' ' AS wanted FROM supplier)""",
)
def _(t):
    wanted = t.supplier.select("s_suppkey", F.concat(F.lit(" nation_"), F.col("s_suppkey") % 30, F.lit(" ")).alias("wanted"))
    return op.lookup_nocase(wanted, t.nation, "wanted", "n_name", "n_nationkey", "nation_id")


@bind(
    "link_pairs",
    """WITH p AS (SELECT 'nation_' || (s_suppkey % 28) AS c, 'NATION_' || s_nationkey AS p FROM supplier)
       SELECT DISTINCT a.n_nationkey AS child_id, b.n_nationkey AS parent_id FROM p JOIN nation a ON lower(a.n_name) = lower(p.c)
         JOIN nation b ON lower(b.n_name) = lower(p.p) WHERE a.n_nationkey <> b.n_nationkey
           AND NOT EXISTS (SELECT 1 FROM nation x WHERE x.n_nationkey = a.n_nationkey AND x.n_regionkey = b.n_nationkey)""",
)
def _(t):
    pairs = t.supplier.select(F.concat(F.lit("nation_"), F.col("s_suppkey") % 28).alias("c"), F.concat(F.lit("NATION_"), "s_nationkey").alias("p"))
    existing = t.nation.select(F.col("n_nationkey").alias("child_id"), F.col("n_regionkey").alias("parent_id"))
    return op.link_pairs(pairs, "c", "p", t.nation, "n_name", "n_nationkey", existing)


@bind(
    "match_variants",
    """WITH d AS (SELECT s_suppkey, s_suppkey % 40 AS rid, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE (1900 + s_nationkey)::VARCHAR END AS years,
                    n_name AS raw, CASE WHEN s_suppkey % 2 = 0 THEN 'City' END AS kind, upper(n_name) || 'X' AS nm
                  FROM supplier JOIN nation ON n_nationkey = s_nationkey),
            r AS (SELECT s_suppkey % 40 AS rid, (1900 + s_nationkey + s_suppkey % 2)::VARCHAR AS years,
                    CASE WHEN s_suppkey % 4 = 0 THEN n_name || ', City' WHEN s_suppkey % 4 = 1 THEN n_name ELSE n_name || 'X' END AS nm
                  FROM supplier JOIN nation ON n_nationkey = s_nationkey)
       SELECT s_suppkey, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.rid = d.rid AND (r.years = d.years OR d.years = '')
           AND r.nm IN (CASE WHEN kind IS NOT NULL THEN raw || ', ' || kind ELSE raw END, raw, d.nm)) THEN 1 ELSE 0 END AS is_match FROM d""",
)
def _(t):
    named = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).withColumn("rid", F.col("s_suppkey") % 40)
    year = (1900 + F.col("s_nationkey")).cast("string")
    wanted = named.select(
        "s_suppkey", "rid", F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(year).alias("years"), F.col("n_name").alias("raw"),
        F.when(F.col("s_suppkey") % 2 == 0, "City").alias("kind"), F.concat(F.upper("n_name"), F.lit("X")).alias("nm"),
    ).withColumn("variants", name_variants("raw", "kind", "nm"))
    kind = F.col("s_suppkey") % 4
    ref = named.select(
        F.col("rid").alias("ref_id"), (1900 + F.col("s_nationkey") + F.col("s_suppkey") % 2).cast("string").alias("ref_years"),
        F.when(kind == 0, F.concat("n_name", F.lit(", City"))).when(kind == 1, F.col("n_name")).otherwise(F.concat("n_name", F.lit("X"))).alias("ref_name"),
    )
    flagged = op.match_variants(wanted, "s_suppkey", "rid", "years", "variants", ref, "ref_id", "ref_years", "ref_name")
    return flagged.select("s_suppkey", "is_match")


OWNERS_SQL = """SELECT n_nationkey::BIGINT AS id, 'NATION_' || (n_nationkey % 12) AS name,
    CASE WHEN n_nationkey % 3 = 1 THEN 'City' END AS territory, CASE WHEN n_nationkey % 5 = 2 THEN 1 WHEN n_nationkey % 5 = 1 THEN 0 END AS is_section FROM nation"""
ITEMS_SQL = """SELECT s_suppkey AS row_id, CASE s_suppkey % 4 WHEN 0 THEN 'NATION_' || (s_suppkey % 14) WHEN 1 THEN 'nation_' || (s_suppkey % 14) || ', city'
      WHEN 2 THEN 'NATION_' || (s_suppkey % 14) || ', City' ELSE 'NATION_' || (s_suppkey % 14) END AS owner_name,
    CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey::BIGINT END AS owner_id, CASE WHEN s_suppkey % 10 = 0 THEN 1 WHEN s_suppkey % 10 = 1 THEN 0 END AS is_manual FROM supplier"""


@bind(
    "auto_associate",
    f"""WITH owners AS ({OWNERS_SQL}), items AS ({ITEMS_SQL}),
        o AS (SELECT *, (SELECT count(*) FROM owners l WHERE l.name = owners.name AND coalesce(l.is_section, 0) = 0) AS leaves FROM owners),
        act AS (SELECT *, coalesce(is_section, 0) = 0 OR leaves = 0 AS active FROM o),
        fit AS (SELECT row_id, id FROM items JOIN act ON active AND ((owner_name = name AND (territory IS NULL OR leaves <= 1))
                  OR (territory IS NOT NULL AND owner_name ILIKE replace(name, '_', '\\_') || '%' || territory ESCAPE '\\')))
        SELECT i.row_id, i.owner_name, CASE WHEN coalesce(i.is_manual, 0) = 0 AND (i.owner_id IS NULL
              OR (EXISTS (SELECT 1 FROM act WHERE act.id = i.owner_id AND active) AND NOT EXISTS (SELECT 1 FROM fit WHERE fit.row_id = i.row_id AND fit.id = i.owner_id)))
            THEN (SELECT min(id) FROM fit WHERE fit.row_id = i.row_id) ELSE i.owner_id END AS new_owner_id FROM items i""",
)
def _(t):
    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    owners = t.nation.select(
        n.cast("bigint").alias("id"), F.concat(F.lit("NATION_"), n % 12).alias("name"), F.when(n % 3 == 1, "City").alias("territory"),
        F.when(n % 5 == 2, 1).when(n % 5 == 1, 0).alias("is_section"),
    )
    upper = F.concat(F.lit("NATION_"), s % 14)
    items = t.supplier.select(
        s.alias("row_id"),
        F.when(s % 4 == 1, F.concat(F.lower(upper), F.lit(", city"))).when(s % 4 == 2, F.concat(upper, F.lit(", City"))).otherwise(upper).alias("owner_name"),
        F.when(s % 3 != 0, F.col("s_nationkey").cast("bigint")).alias("owner_id"),
        F.when(s % 10 == 0, 1).when(s % 10 == 1, 0).alias("is_manual"),
    )
    return op.auto_associate(items, owners).select("row_id", "owner_name", "new_owner_id")


@bind(
    "pairwise_within",
    """WITH l AS (SELECT l_orderkey, l_linestatus, row_number() OVER () AS r FROM lineitem)
       SELECT a.l_orderkey, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = a.l_orderkey) AS n_rows, count(*) AS n_pairs,
         count(*) FILTER (WHERE a.l_linestatus = b.l_linestatus) AS equal_pairs, count(*) FILTER (WHERE a.l_linestatus <> b.l_linestatus) AS different_pairs
       FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.r < b.r GROUP BY a.l_orderkey""",
)
def _(t):
    return op.pairwise_within(t.lineitem, "l_orderkey", "l_linestatus")


@bind(
    "match_reference",
    """SELECT e.vec_id, e.label, r.vec_id AS reference_id FROM embeddings e
       JOIN (SELECT label, min(vec_id) AS vec_id FROM embeddings WHERE vec_id % 7 = 0 GROUP BY label) r USING (label) WHERE e.vec_id % 7 <> 0""",
)
def _(t):
    matched = op.match_reference(t.embeddings, "label", F.col("vec_id") % 7 == 0, "vec_id", ["embedding"])
    return matched.select("vec_id", "label", F.col("reference.vec_id").alias("reference_id"))
