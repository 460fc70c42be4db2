"""Table maintenance and dataset splits on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_engine.operators import dataset
from catalog_engine.operators import tables as op
from catalog_engine.plans.binding import bind

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


def customer_feed(t):
    """Two versions of every fifth customer, and as many new ones."""
    old = t.customer.filter("c_custkey % 5 = 0")
    versions = [
        old.select("c_custkey", F.concat("c_name", F.lit(f" v{v}")).alias("c_name"), (F.col("c_nationkey") + v).alias("c_nationkey"), F.lit("FEED").alias("c_mktsegment"), F.lit(v).alias("v"))
        for v in (1, 2)
    ]
    new = old.select((F.col("c_custkey") + 1_000_000_000).alias("c_custkey"), "c_name", "c_nationkey", F.lit("NEW").alias("c_mktsegment"), F.lit(1).alias("v"))
    return versions[0].unionByName(versions[1]).unionByName(new)


@bind(
    "upsert",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name || ' v2' ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 2 ELSE c_nationkey END AS c_nationkey, c_mktsegment FROM customer
       UNION ALL SELECT c_custkey + 1000000000, c_name, c_nationkey, 'NEW' FROM customer WHERE c_custkey % 5 = 0""",
)
def _(t):
    return op.upsert(t.customer.select(*CUSTOMER), customer_feed(t), ["c_custkey"], ["c_name", "c_nationkey"], "v")


@bind(
    "insert_ignore",
    """SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer UNION ALL SELECT c_custkey + 1000000000, c_name, c_nationkey, 'NEW' FROM customer WHERE c_custkey % 5 = 0""",
)
def _(t):
    return op.insert_ignore(t.customer.select(*CUSTOMER), customer_feed(t).drop("v"), ["c_custkey"])


@bind(
    "replace_rows",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name || ' v2' ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 > 0 THEN c_nationkey END AS c_nationkey,
         CASE WHEN c_custkey % 5 = 0 THEN 'FEED' ELSE c_mktsegment END AS c_mktsegment FROM customer
       UNION ALL SELECT c_custkey + 1000000000, c_name, NULL, 'NEW' FROM customer WHERE c_custkey % 5 = 0""",
)
def _(t):
    return op.replace_rows(t.customer.select(*CUSTOMER), customer_feed(t).drop("c_nationkey"), ["c_custkey"], "v")


@bind(
    "get_or_create_ids",
    """WITH d AS (SELECT p_brand, min(p_partkey) AS id FROM part WHERE length(p_brand) = 7 GROUP BY p_brand),
            n AS (SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM d))
       SELECT id, p_brand FROM d UNION ALL SELECT (SELECT max(id) FROM d) + row_number() OVER (ORDER BY p_brand), p_brand FROM n""",
)
def _(t):
    dim = t.part.filter("length(p_brand) = 7").groupBy("p_brand").agg(F.min("p_partkey").alias("id"))
    return op.get_or_create_ids(dim, "id", ["p_brand"], t.part)


@bind(
    "bridge_rows",
    """WITH d AS (SELECT role, min(turn) AS id FROM conversations GROUP BY role)
       SELECT DISTINCT conv_id, d.id, s.side FROM conversations c JOIN (VALUES (1), (2)) s(side) ON s.side = 1 + c.turn % 2 JOIN d ON d.role = c.role""",
)
def _(t):
    dim = t.conversations.groupBy("role").agg(F.min("turn").alias("id"))
    listed = F.array("role", F.col("role"), F.lit("nobody"))
    return op.bridge_rows(t.conversations, "conv_id", listed, dim, "role", "id", (1 + F.col("turn") % 2).cast("int"))


@bind(
    "replace_children",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0)
       UNION ALL SELECT o_orderkey, 1, -o_custkey FROM orders WHERE o_orderkey % 7 = 0""",
)
def _(t):
    source = t.orders.filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (-F.col("o_custkey")).alias("l_partkey"))
    return op.replace_children(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), source, "l_orderkey")


def part_feed(t):
    third, fifth = F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 5 == 0
    return t.part.filter(third).select("p_partkey", F.when(fifth, F.upper("p_name")).alias("p_name"), F.when(fifth, F.col("p_size") + 1).alias("p_size"))


@bind(
    "coalesce_update",
    """SELECT p_partkey, CASE WHEN p_partkey % 15 = 0 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_partkey % 15 = 0 THEN p_size + 1 WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS p_size, p_brand FROM part""",
)
def _(t):
    return op.coalesce_update(t.part.select("p_partkey", "p_name", "p_size", "p_brand"), part_feed(t), "p_partkey", ["p_name"], ["p_size"])


@bind(
    "append_info",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ring' WHEN 1 THEN 'old; ring' WHEN 2 THEN 'ring; old' ELSE p_name END AS info FROM part""",
)
def _(t):
    kind = F.col("p_partkey") % 4
    target = t.part.select("p_partkey", F.when(kind == 1, "old").when(kind == 2, "ring; old").when(kind == 3, F.col("p_name")).alias("info"))
    source = t.part.filter(kind < 3).select("p_partkey", F.lit("ring").alias("info"))
    once = op.append_info(target, source, "p_partkey", "info")
    return op.append_info(once, source, "p_partkey", "info")


@bind(
    "soft_delete",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 10 = 0 OR l_suppkey % 10 = 0 THEN 1 END AS removed FROM lineitem""",
)
def _(t):
    target = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit(None).cast("int").alias("removed"))
    doomed = target.select("l_orderkey", F.explode(F.array("l_partkey", "l_suppkey")).alias("name")).filter("name % 10 = 0")
    return op.soft_delete(target, doomed, "l_orderkey", "name", ("l_partkey", "l_suppkey"), "removed")


SAMPLES_SQL = """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS id, l_orderkey AS entity, least(l_linenumber, 3) AS sample_type,
    'a' || l_partkey AS face_a, 'b' || l_suppkey AS face_b, l_partkey FROM lineitem"""


@bind(
    "apply_changes",
    f"""WITH s AS ({SAMPLES_SQL}), p AS (SELECT entity FROM s WHERE l_partkey % 11 = 1)
       SELECT id, CASE WHEN l_partkey % 11 = 2 THEN 7 ELSE entity END AS entity,
         CASE WHEN l_partkey % 11 = 1 THEN 1 WHEN l_partkey % 11 = 2 THEN 2 WHEN l_partkey % 11 = 3 THEN 3 WHEN sample_type = 1 AND entity IN (SELECT entity FROM p) THEN 2 ELSE sample_type END AS sample_type,
         CASE WHEN l_partkey % 11 = 0 THEN 1 END AS removed, CASE l_partkey % 11 WHEN 4 THEN face_b WHEN 5 THEN 'y' WHEN 6 THEN 'y' WHEN 7 THEN face_a ELSE face_a END AS face_a,
         CASE l_partkey % 11 WHEN 4 THEN face_a WHEN 5 THEN 'x' WHEN 6 THEN 'z' ELSE face_b END AS face_b, CASE WHEN l_partkey % 11 = 8 THEN 1 ELSE 0 END AS is_roll FROM s""",
)
def _(t):
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    samples = t.lineitem.select(
        key.alias("id"), F.col("l_orderkey").alias("entity"), F.least("l_linenumber", F.lit(3)).alias("sample_type"), F.lit(None).cast("int").alias("removed"),
        F.concat(F.lit("a"), "l_partkey").alias("face_a"), F.concat(F.lit("b"), "l_suppkey").alias("face_b"), F.lit(0).alias("is_roll"), (F.col("l_partkey") % 11).alias("k"),
    )
    # per remainder: which changes, in which order
    log = {
        0: [("delete", None, None, None)], 1: [("set_type", 3, None, None), ("promote", None, None, None)], 2: [("transfer", 7, None, None)], 3: [("set_type", 1, None, None), ("set_type", 3, None, None)],
        4: [("swap", None, None, None)], 5: [("rename", None, "x", "y"), ("swap", None, None, None)], 6: [("swap", None, None, None), ("rename", None, "y", "z")],
        7: [("swap", None, None, None), ("swap", None, None, None)], 8: [("is_roll", 0, None, None), ("is_roll", 1, None, None)],
    }
    rows = [(k, i, *change) for k, steps in log.items() for i, change in enumerate(steps)]
    kinds = t.spark.createDataFrame(rows, "ck long, seq int, kind string, number long, text_a string, text_b string")
    changes = samples.select("id", "k").join(F.broadcast(kinds), F.col("k") == F.col("ck")).drop("k", "ck")
    return op.apply_changes(samples.drop("k"), changes, "id", "entity", ["is_roll"])


@bind(
    "assign_owner",
    """SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey % 4 = 0 THEN NULL WHEN s_nationkey % 4 = 1 THEN s_nationkey + 100 ELSE s_suppkey END AS owner_id, CASE WHEN s_nationkey % 4 < 2 THEN 1 ELSE 0 END AS is_manual FROM supplier""",
)
def _(t):
    items = t.supplier.select("s_suppkey", "s_nationkey", F.col("s_suppkey").alias("owner_id"), F.lit(0).alias("is_manual"))
    group = F.col("n_nationkey") % 4
    assignments = t.nation.filter(group < 2).select(F.col("n_nationkey").alias("s_nationkey"), F.when(group == 1, F.col("n_nationkey") + 100).alias("owner_id"))
    return op.assign_owner(items, assignments, ["s_nationkey"])


@bind(
    "cascade_delete",
    """SELECT 'parent' AS side, o_orderkey AS key, 1 AS n FROM orders WHERE o_custkey % 9 <> 0
       UNION ALL SELECT 'child', l_orderkey, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 9 = 0) GROUP BY l_orderkey""",
)
def _(t):
    parents, children = op.cascade_delete(t.orders, t.lineitem, "o_orderkey", "l_orderkey", t.orders.filter("o_custkey % 9 = 0").select("o_orderkey"))
    counted = children.groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return parents.select(F.lit("parent").alias("side"), F.col("o_orderkey").alias("key"), F.lit(1).cast("bigint").alias("n")).unionByName(counted.select(F.lit("child").alias("side"), "key", "n"))


@bind(
    "bulk_update",
    """SELECT p_partkey, CASE WHEN p_partkey % 15 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name END AS p_name, p_size, CASE WHEN p_partkey % 15 = 0 THEN 1 ELSE 0 END AS fixed FROM part""",
)
def _(t):
    target = t.part.select("p_partkey", "p_name", "p_size", F.lit(0).alias("fixed"))
    updates = t.part.filter("p_partkey % 3 = 0").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"), "p_size")
    return op.bulk_update(target, updates, "p_partkey", ["p_name", "p_size"], "fixed")


# --- splits ----------------------------------------------------------------------------------------------------------


@bind(
    "ordered_split",
    "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY source, doc_id) <= floor(0.85 * (SELECT count(*) FROM documents)) THEN 'train' ELSE 'val' END AS part FROM documents",
)
def _(t):
    return dataset.ordered_split(t.documents.select("doc_id", "source"), ["source", "doc_id"], 0.85).select("doc_id", "part")


@bind(
    "random_split",
    "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= floor(0.2 * (SELECT count(*) FROM documents)) THEN 'val' ELSE 'train' END AS part FROM documents",
)
def _(t):
    return dataset.random_split(t.documents.select("doc_id"), "doc_id", 0.2, 42)


@bind(
    "pair_by_stem",
    """SELECT doc_id, CASE WHEN quality IS NULL THEN NULL WHEN doc_id % 3 = 0 THEN 'masks/d' || doc_id || '.png' WHEN doc_id % 3 = 1 THEN 'masks/d' || doc_id || '.PNG' ELSE 'masks/d' || doc_id || '.jpg' END AS partner,
         CASE WHEN quality IS NULL THEN 'no partner' END AS problem FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(t):
    images = t.documents.select("doc_id", F.concat(F.lit("images/d"), "doc_id", F.lit(".jpg")).alias("path"))
    kind = F.col("doc_id") % 3
    names = F.when(kind == 0, F.array(F.lit(".jpg"), F.lit(".png"))).when(kind == 1, F.array(F.lit(".PNG"), F.lit(".gif"))).otherwise(F.array(F.lit(".jpg")))
    masks = t.labels.select(F.explode(names).alias("ext"), "doc_id").select(F.concat(F.lit("masks/d"), "doc_id", "ext").alias("path"))
    return dataset.pair_by_stem(images, masks, "path", [".png", ".jpg"]).select("doc_id", "partner", "problem")


@bind(
    "best_checkpoint",
    "SELECT user_id, value, min(event_id) AS event_id FROM events e WHERE value = (SELECT min(value) FROM events f WHERE f.user_id = e.user_id) GROUP BY user_id, value",
)
def _(t):
    return dataset.best_checkpoint(t.events, "user_id", "event_id", "value")


@bind(
    "improvements",
    """SELECT user_id, event_id, coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM events""",
)
def _(t):
    return dataset.improvements(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", "value").drop("value")
