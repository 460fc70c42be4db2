"""Filters and projections on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_engine.operators import filters as op
from catalog_engine.plans.binding import bind

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def removed():
    """A three-valued soft-delete flag: returned lines are removed, accepted ones are unknown."""
    return F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "N", 0)


@bind(
    "live_rows",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem WHERE l_returnflag <> 'R'",
)
def _(t):
    return op.live_rows(t.lineitem, removed()).select(*LINE_KEY, "l_returnflag")


@bind(
    "filter_curated",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus <> 'F'",
)
def _(t):
    return op.filter_curated(t.orders, F.col("o_orderstatus") == "F", "hide_fixed").select("o_orderkey", "o_orderstatus")


@bind("search_contains", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def _(t):
    return op.search_contains(t.part, "p_name", "RING").select("p_partkey", "p_name")


@bind(
    "search_word_prefix",
    r"""SELECT p_partkey, p_name FROM part WHERE list_bool_or(list_transform(string_split(
        trim(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: starts_with(w, 'wi')))""",
)
def _(t):
    return op.search_word_prefix(t.part, "p_name", " Wí").select("p_partkey", "p_name")


@bind("lookup_entity", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = TRY_CAST('42' AS BIGINT)")
def _(t):
    return op.lookup_entity(t.orders, "o_orderkey", "42").select("o_orderkey", "o_custkey")


@bind(
    "resume_from",
    "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 3)",
)
def _(t):
    return op.resume_from(t.nation, "n_nationkey", "n_regionkey", 3).select("n_nationkey", "n_name")


@bind(
    "changed_rows",
    """WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment,
                  CASE WHEN c_custkey % 11 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey FROM customer)
       SELECT n.* FROM n JOIN customer o USING (c_custkey)
       WHERE coalesce(n.c_mktsegment, '') <> coalesce(CASE WHEN o.c_custkey % 14 = 0 THEN NULL ELSE o.c_mktsegment END, '')
          OR n.c_nationkey <> o.c_nationkey""",
)
def _(t):
    base = t.customer.select("c_custkey", "c_mktsegment", "c_nationkey")
    old = base.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 14 != 0, F.col("c_mktsegment")))
    new = base.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_mktsegment"))).withColumn(
        "c_nationkey", F.when(F.col("c_custkey") % 11 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey"))
    )
    return op.changed_rows(old, new, "c_custkey", ["c_mktsegment", "c_nationkey"])


@bind(
    "project_listing",
    """WITH live AS (SELECT * FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber = 1),
            ranked AS (SELECT l_orderkey, l_partkey AS face_a, l_suppkey AS face_b,
                         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM live)
       SELECT o_orderkey, o_custkey, o_orderstatus, face_a, face_b
       FROM orders LEFT JOIN ranked ON l_orderkey = o_orderkey AND r = 1""",
)
def _(t):
    children = op.live_rows(t.lineitem, removed()).filter("l_linenumber = 1")
    children = children.withColumnsRenamed({"l_partkey": "face_a", "l_suppkey": "face_b"})
    parents = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    return op.project_listing(parents, children, "o_orderkey", "l_orderkey", ["l_linenumber"], ["face_a", "face_b"])


@bind(
    "project_detail",
    """WITH k AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1) AS pos
                  FROM lineitem)
       SELECT o_orderkey, o_custkey, coalesce(pos // 3, 0)::BIGINT AS chunk_no,
              coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY pos), '') AS children
       FROM orders LEFT JOIN k ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def _(t):
    order = [F.col(c) for c in LINE_KEY[1:]]
    nested = op.project_detail(
        t.orders.select("o_orderkey", "o_custkey"), t.lineitem.select(*LINE_KEY), "o_orderkey", "l_orderkey", order,
        ["l_linenumber", "l_partkey"], chunk=3,
    )
    flat = F.array_join(F.transform("children", lambda r: F.concat_ws(":", r["l_linenumber"], r["l_partkey"])), ",")
    return nested.withColumn("children", F.coalesce(flat, F.lit("")))


@bind(
    "is_combined",
    "SELECT p_partkey, lower(trim(a)) = lower(trim(p_name)) AS combined FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN ' ' || upper(p_name) ELSE p_type END AS a FROM part)",
)
def _(t):
    faces = t.part.withColumn("a", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.upper("p_name"))).otherwise(F.col("p_type")))
    return faces.select("p_partkey", op.is_combined("a", "p_name").alias("combined"))


@bind(
    "guard_delete",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, count(*) FILTER (WHERE l_linenumber >= 3)
         OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE l_linenumber >= 3 AND n > 1""",
)
def _(t):
    return op.guard_delete(t.lineitem, "l_orderkey", F.least("l_linenumber", F.lit(3))).select(*LINE_KEY)


@bind(
    "valid_records",
    """SELECT doc_id, title FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN ' ' ELSE source END AS title
         FROM documents) WHERE title IS NOT NULL AND trim(title) <> ''""",
)
def _(t):
    title = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 7 == 0, " ").otherwise(F.col("source"))
    return op.valid_records(t.documents.select("doc_id", title.alias("title")), ["doc_id", "title"])
