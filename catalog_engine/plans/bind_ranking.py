"""Rankings, profiles and set operations on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_engine.operators import ranking as op
from catalog_engine.operators import sets
from catalog_engine.plans.bind_aggregates import GRID_SQL
from catalog_engine.plans.bind_filters import LINE_KEY
from catalog_engine.plans.binding import bind


def reference():
    return F.col("l_linenumber") == 1


@bind(
    "choose_best",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber = 1 DESC, l_extendedprice DESC,
                    l_partkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n,
                    bool_or(l_linenumber = 1) OVER (PARTITION BY l_orderkey) AS any_ref FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, r = 1 AS survivor, r = 1 AND any_ref AND l_linenumber <> 1 AS promoted FROM r WHERE n > 1""",
)
def _(t):
    # line numbers repeat, so the quantity, price and date belong to the key of a row
    row_id = [*LINE_KEY, "l_quantity", "l_extendedprice", "l_shipdate"]
    best = op.choose_best(t.lineitem, "l_orderkey", row_id, "l_quantity", reference(), "l_extendedprice", "l_partkey")
    return best.select(*LINE_KEY, "survivor", "promoted")


@bind(
    "first_per_group",
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1""",
)
def _(t):
    return op.first_per_group(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", ["o_orderkey"])


@bind(
    "latest",
    """SELECT o_orderkey, c_custkey, c_name FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) LEFT JOIN customer ON c_custkey = o_custkey""",
)
def _(t):
    return op.latest(t.orders, ["o_orderdate", "o_orderkey"], t.customer, "o_custkey", "c_custkey").select("o_orderkey", "c_custkey", "c_name")


@bind(
    "ordinal_positions",
    r"""WITH o AS (SELECT doc_id, unnest(l) AS item, generate_subscripts(l, 1) AS outer_pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
             p AS (SELECT *, string_split(item, '. ') AS parts FROM o)
        SELECT doc_id, outer_pos, inner_pos, length(part) AS size FROM (
          SELECT doc_id, outer_pos, generate_subscripts(parts, 1) AS inner_pos, unnest(parts) AS part FROM p WHERE len(parts) > 1
          UNION ALL SELECT doc_id, outer_pos, NULL, item FROM p WHERE len(parts) = 1)""",
)
def _(t):
    parts = F.split("item", r"\. ")
    placed = op.ordinal_positions(t.documents.select("doc_id", "text"), F.split("text", "\n"), F.when(F.size(parts) > 1, parts))
    return placed.select("doc_id", "outer_pos", "inner_pos", F.length("item").alias("size"))


@bind(
    "pair_by_position",
    """SELECT l_orderkey, max(l_partkey) FILTER (WHERE l_linenumber = 1) AS face_a,
         coalesce(max(l_partkey) FILTER (WHERE l_linenumber = 2), max(l_partkey) FILTER (WHERE l_linenumber = 1)) AS face_b
       FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_linenumber = 1) > 0""",
)
def _(t):
    return op.pair_by_position(t.lineitem, "l_orderkey", "l_linenumber", "l_partkey")


LABELLED_SQL = """SELECT l_orderkey, struct_pack(n := l_linenumber, p := l_partkey, s := l_suppkey) AS pos, l_partkey AS item,
    CASE l_suppkey % 3 WHEN 0 THEN 'Coin Obverse' WHEN 1 THEN 'coin reverse' END AS label FROM lineitem"""


@bind(
    "label_or_position",
    f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM ({LABELLED_SQL})),
             k AS (SELECT *, CASE WHEN n = 2 OR label IS NULL THEN CASE r WHEN 1 THEN 'a' WHEN 2 THEN 'b' END
                     WHEN lower(label) LIKE '%obverse' THEN 'a' ELSE 'b' END AS face FROM p)
        SELECT l_orderkey, arg_max(item, r) FILTER (WHERE face = 'a') AS face_a, arg_max(item, r) FILTER (WHERE face = 'b') AS face_b FROM k GROUP BY l_orderkey""",
)
def _(t):
    kind = F.col("l_suppkey") % 3
    lines = t.lineitem.select(
        "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.col("l_partkey").alias("item"),
        F.when(kind == 0, "Coin Obverse").when(kind == 1, "coin reverse").alias("label"),
    )
    return op.label_or_position(lines, "l_orderkey", "pos", "label", "item")


@bind(
    "order_by_start_year",
    """WITH y AS (SELECT o_orderkey, o_orderpriority, o_orderstatus = 'F' AS prim, CASE o_orderkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN year(o_orderdate) || ' BC'
                ELSE 'c. ' || year(o_orderdate) || '-' || (year(o_orderdate) + 3) END AS years FROM orders)
       SELECT o_orderkey, years, row_number() OVER (ORDER BY CASE WHEN years = 'unknown' THEN 2147483647
           WHEN years LIKE '%BC' THEN -regexp_extract(years, '[0-9]+')::INT ELSE regexp_extract(years, '[0-9]+')::INT END,
         CASE WHEN prim THEN 0 ELSE 1 END, o_orderpriority, o_orderkey) AS position FROM y""",
)
def _(t):
    kind, year = F.col("o_orderkey") % 5, F.year("o_orderdate")
    years = F.when(kind == 0, "unknown").when(kind == 1, F.concat(year, F.lit(" BC"))).otherwise(F.concat(F.lit("c. "), year, F.lit("-"), year + 3))
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", years.alias("years"))
    return op.order_by_start_year(rows, "years", F.col("o_orderstatus") == "F", "o_orderpriority", "o_orderkey").select("o_orderkey", "years", "position")


@bind(
    "reference_first",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber <> 1, l_partkey, l_suppkey, l_linenumber) AS position
       FROM lineitem""",
)
def _(t):
    return op.reference_first(t.lineitem.select(*LINE_KEY), "l_orderkey", reference(), ["l_partkey", "l_suppkey", "l_linenumber"])


@bind(
    "catalog_order",
    """SELECT n_nationkey, seq, n_name, row_number() OVER (ORDER BY seq NULLS FIRST, n_name, n_nationkey) AS position
       FROM (SELECT *, CASE WHEN n_nationkey % 4 <> 0 THEN n_regionkey END AS seq FROM nation)""",
)
def _(t):
    rows = t.nation.select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_regionkey")).alias("seq"))
    return op.catalog_order(rows, ["seq", "n_name"], "n_nationkey")


PROFILE_SQL = """SELECT vec_id, pos, floor(abs(v - nxt) * 1000)::BIGINT AS e FROM (SELECT vec_id, pos, v, lead(v) OVER (PARTITION BY vec_id ORDER BY pos) AS nxt
    FROM (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)) WHERE nxt IS NOT NULL"""


def profiles(t):
    """Change between neighbouring vector components, as one whole-number profile per vector."""
    pairs = F.zip_with(F.slice("embedding", 1, 63), F.slice("embedding", 2, 63), lambda a, b: F.floor(F.abs(a.cast("double") - b.cast("double")) * 1000))
    return t.embeddings.select("vec_id", "embedding", pairs.alias("profile"))


@bind(
    "widest_low_run",
    f"""WITH p AS (SELECT *, floor(floor(avg(e) OVER (PARTITION BY vec_id)) / 3) AS threshold FROM ({PROFILE_SQL})),
             l AS (SELECT vec_id, pos, pos - row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS island FROM p WHERE e < threshold AND pos >= 12 AND pos < 50),
             i AS (SELECT vec_id, min(pos) AS start, count(*) AS width FROM l GROUP BY vec_id, island),
             b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY width DESC, start) AS r FROM i)
        SELECT e.vec_id, round(coalesce((start + width // 2) / 63.0, 0.5), 6) AS ratio FROM embeddings e LEFT JOIN b ON b.vec_id = e.vec_id AND r = 1""",
)
def _(t):
    return profiles(t).select("vec_id", F.round(op.widest_low_run("profile"), 6).alias("ratio"))


@bind(
    "peak_in_window",
    f"""WITH p AS (SELECT * FROM ({PROFILE_SQL}) WHERE pos >= 20 AND pos < 44), m AS (SELECT vec_id, max(e) AS top, avg(e) AS mean FROM p GROUP BY vec_id)
        SELECT vec_id, CASE WHEN any_value(top) > 3 * any_value(mean) THEN min(pos) FILTER (WHERE e = top) END AS peak FROM p JOIN m USING (vec_id) GROUP BY vec_id""",
)
def _(t):
    return profiles(t).select("vec_id", op.peak_in_window("profile", F.lit(20), F.lit(44)).alias("peak"))


@bind(
    "column_energy",
    f"""SELECT vec_id, x, round(sum(abs(v - nxt)), 6) AS energy FROM (SELECT vec_id, x, v, lead(v) OVER (PARTITION BY vec_id, x ORDER BY y) AS nxt FROM ({GRID_SQL}))
        WHERE nxt IS NOT NULL GROUP BY ALL""",
)
def _(t):
    energies = t.embeddings.select("vec_id", F.posexplode(op.column_energy("embedding", 8)).alias("x", "energy"))
    return energies.withColumn("energy", F.round("energy", 6))


@bind("set_minus", "SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity < 1.5 AND l_tax > 0.07")
def _(t):
    picked = lambda condition: t.lineitem.filter(condition).select("l_suppkey")
    return sets.set_minus(picked("l_quantity > 49"), picked("l_quantity < 1.5 AND l_tax > 0.07"))


@bind(
    "union_rules",
    """SELECT 'expensive' AS rule, l_orderkey, l_partkey FROM lineitem WHERE l_extendedprice > 90000
       UNION ALL SELECT 'undiscounted', l_orderkey, l_partkey FROM lineitem WHERE l_discount = 0""",
)
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount")
    found = {"expensive": lines.filter("l_extendedprice > 90000"), "undiscounted": lines.filter("l_discount = 0")}
    return sets.union_rules({rule: df.select("l_orderkey", "l_partkey") for rule, df in found.items()})


@bind(
    "dedupe_preserve_order",
    """SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY seen, role) AS position
       FROM (SELECT conv_id, role, min(turn) AS seen FROM conversations GROUP BY ALL)""",
)
def _(t):
    return sets.dedupe_preserve_order(t.conversations, "conv_id", "turn", "role")


@bind(
    "cover_missing",
    """SELECT l_orderkey, m AS missing FROM (SELECT DISTINCT l_orderkey FROM lineitem), (VALUES ('A'), ('N'), ('R')) v(m)
       WHERE (l_orderkey, m) NOT IN (SELECT l_orderkey, l_returnflag FROM lineitem)""",
)
def _(t):
    return sets.cover_missing(t.lineitem, "l_orderkey", "l_returnflag", ["A", "N", "R"])
