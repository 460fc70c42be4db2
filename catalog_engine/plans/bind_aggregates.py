"""Aggregations on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_engine.operators import aggregates as op
from catalog_engine.plans.binding import bind

GRID_SQL = "SELECT vec_id, pos % 8 AS x, pos // 8 AS y, v FROM (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def grid(t):
    """The 64 vector components as an 8 by 8 picture."""
    cells = t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return cells.select("vec_id", (F.col("pos") % 8).alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"), F.col("v").cast("double").alias("v"))


@bind("groups_with_many", "SELECT l_orderkey, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def _(t):
    return op.groups_with_many(t.lineitem, "l_orderkey")


@bind("conditional_having", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_discount = 0) > 0")
def _(t):
    return op.conditional_having(t.lineitem, "l_orderkey", F.col("l_discount") == 0)


@bind("distinct_owners", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL")
def _(t):
    return op.distinct_owners(t.orders, "o_custkey")


CONTEST_SQL = """SELECT l_orderkey, l_partkey, p_brand, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS flag
                 FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL"""


LINES_A_TASK = 500_000


def contests(t):
    """The parts of each order. One shuffle by order and brand serves both groupings, in tasks of so many lines at any size."""
    lines = t.lineitem.select("l_orderkey", "l_partkey", (F.col("l_linestatus") == "F").cast("int").alias("flag"))
    met = lines.join(t.part.select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    tasks = max(t.spark.sparkContext.defaultParallelism, -(-t.lineitem.count() // LINES_A_TASK))
    return met.repartition(tasks, "l_orderkey", "p_brand").groupBy("l_orderkey", "l_partkey", "p_brand").agg(F.max("flag").alias("flag"))


@bind(
    "dominance",
    f"""WITH c AS ({CONTEST_SQL}),
        d AS (SELECT a.l_partkey AS a, b.l_partkey AS b, sum(CASE WHEN a.flag = 1 AND b.flag = 0 THEN 1 ELSE 0 END) AS win,
                count(*) AS met FROM c a JOIN c b ON a.l_orderkey = b.l_orderkey AND a.p_brand = b.p_brand AND a.l_partkey <> b.l_partkey GROUP BY ALL)
        SELECT a AS l_partkey, CASE WHEN bool_and(win = met) THEN 1 ELSE 0 END AS is_primary FROM d GROUP BY a""",
)
def _(t):
    return op.dominance(contests(t), "l_orderkey", "p_brand", "l_partkey", "flag")


@bind(
    "mark_dominance",
    f"""WITH c AS ({CONTEST_SQL}),
        d AS (SELECT a.l_partkey AS a, bool_and(a.flag = 1 AND b.flag = 0) AS won
              FROM c a JOIN c b ON a.l_orderkey = b.l_orderkey AND a.p_brand = b.p_brand AND a.l_partkey <> b.l_partkey GROUP BY a.l_partkey)
        SELECT p_partkey, CASE WHEN won THEN 1 WHEN NOT won THEN 0 END AS is_primary FROM part LEFT JOIN d ON a = p_partkey""",
)
def _(t):
    verdicts = op.dominance(contests(t), "l_orderkey", "p_brand", "l_partkey", "flag")
    return op.mark_dominance(t.part.select("p_partkey"), "p_partkey", verdicts, "l_partkey")


PERIOD_SQL = """SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 5 = 0 THEN ' ' ELSE 'period ' || (s_suppkey % 3) END AS period,
                (s_suppkey % 2)::INT AS ord, s_acctbal > 2000 AS linked FROM supplier"""


def periods(t):
    s = F.col("s_suppkey")
    return t.supplier.select(
        s, "s_nationkey", F.when(s % 5 == 0, " ").otherwise(F.concat(F.lit("period "), s % 3)).alias("period"),
        (s % 2).cast("int").alias("ord"), (F.col("s_acctbal") > 2000).alias("linked"),
    )


@bind(
    "period_groups",
    f"""SELECT s_nationkey, CASE WHEN trim(period) = '' THEN '' ELSE period END AS period, CASE WHEN trim(period) <> '' THEN ord END AS period_order,
          CASE WHEN trim(period) = '' THEN s_suppkey END AS single_id, count(*) AS members, bool_and(linked) AS associated,
          bool_or(linked) AND NOT bool_and(linked) AS partly_associated FROM ({PERIOD_SQL}) GROUP BY 1, 2, 3, 4""",
)
def _(t):
    return op.period_groups(periods(t), "s_nationkey", "period", "ord", "s_suppkey", F.col("linked"))


@bind("period_members", f"SELECT s_suppkey, period, CASE WHEN trim(period) = '' THEN s_suppkey END AS single_id FROM ({PERIOD_SQL})")
def _(t):
    return op.period_members(periods(t), "period", "s_suppkey").select("s_suppkey", "period", "single_id")


@bind(
    "first_seen_ids",
    """SELECT conv_id, role, first_at, row_number() OVER (PARTITION BY conv_id ORDER BY first_at, role) AS value_id
       FROM (SELECT conv_id, role, min(turn) AS first_at FROM conversations GROUP BY ALL)""",
)
def _(t):
    return op.first_seen_ids(t.conversations, "conv_id", "turn", "role")


@bind(
    "last_non_null",
    """SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'click') AS event_type,
         arg_max(value, event_id) FILTER (WHERE value > 20) AS value FROM events GROUP BY user_id""",
)
def _(t):
    sparse = t.events.select(
        "user_id", "event_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("event_type"),
        F.when(F.col("value") > 20, F.col("value")).alias("value"),
    )
    return op.last_non_null(sparse, "user_id", "event_id", ["event_type", "value"])


@bind(
    "distinct_values_across",
    """SELECT l_orderkey, l_partkey AS value FROM lineitem UNION SELECT l_orderkey, CASE WHEN l_suppkey % 4 <> 0 THEN l_suppkey END FROM lineitem
       WHERE l_suppkey % 4 <> 0""",
)
def _(t):
    lines = t.lineitem.withColumn("l_suppkey", F.when(F.col("l_suppkey") % 4 != 0, F.col("l_suppkey")))
    return op.distinct_values_across(lines, "l_orderkey", ["l_partkey", "l_suppkey"], "value")


@bind("ambiguity_count", "SELECT p_partkey, p_name, count(*) FILTER (WHERE p_size > 25) OVER (PARTITION BY p_name) AS leaf_count FROM part")
def _(t):
    return op.ambiguity_count(t.part.select("p_partkey", "p_name", "p_size"), "p_name", F.col("p_size") > 25).drop("p_size")


@bind(
    "summary_counts",
    """SELECT count(*) AS processed, count(*) FILTER (WHERE l_returnflag = 'R') AS removed, count(*) FILTER (WHERE l_quantity < 10) AS small,
         count(*) FILTER (WHERE l_discount IS NULL) AS exceptions FROM lineitem""",
)
def _(t):
    return op.summary_counts(
        t.lineitem, {"removed": F.col("l_returnflag") == "R", "small": F.col("l_quantity") < 10, "exceptions": F.col("l_discount").isNull()}
    )


@bind(
    "bbox",
    f"""SELECT vec_id, coalesce(greatest(min(x) FILTER (WHERE v > 0.25) - 1, 0), 0) AS x_from, coalesce(least(max(x) FILTER (WHERE v > 0.25) + 1, 8), 8) AS x_to,
          coalesce(greatest(min(y) FILTER (WHERE v > 0.25) - 1, 0), 0) AS y_from, coalesce(least(max(y) FILTER (WHERE v > 0.25) + 1, 8), 8) AS y_to
        FROM ({GRID_SQL}) GROUP BY vec_id""",
)
def _(t):
    return op.bbox(grid(t), "vec_id", "x", "y", F.col("v") > 0.25, 1, 8, 8)


@bind(
    "masked_mean",
    f"""SELECT vec_id, round(coalesce(avg(v) FILTER (WHERE v >= -0.1), 7), 6) AS v, round(coalesce(avg(y) FILTER (WHERE v >= -0.1), 7), 6) AS y
        FROM ({GRID_SQL}) GROUP BY vec_id""",
)
def _(t):
    means = op.masked_mean(grid(t), "vec_id", ["v", "y"], F.col("v") < -0.1, 7.0)
    return means.select("vec_id", F.round("v", 6).alias("v"), F.round("y", 6).alias("y"))


@bind(
    "dice_score",
    """WITH d AS (SELECT doc_id % 10 AS k, (2 * sum(quality * toxic) + 1e-7) / (sum(quality) + sum(toxic) + 1e-7) AS dice FROM labels GROUP BY 1)
       SELECT k, round(dice, 6) AS dice, round((SELECT 1 - avg(dice) FROM d), 6) AS dice_loss FROM d""",
)
def _(t):
    scored = op.dice_score(t.labels.withColumn("k", F.col("doc_id") % 10), "k", "quality", "toxic")
    return scored.select("k", F.round("dice", 6).alias("dice"), F.round("dice_loss", 6).alias("dice_loss"))


@bind(
    "bce_loss",
    """WITH r AS (SELECT doc_id % 8 AS b, (n_chars % 17 - 8) / 4.0::DOUBLE AS x, quality::DOUBLE AS t FROM labels JOIN documents USING (doc_id)),
            p AS (SELECT b, count(*) AS n, avg(greatest(x, 0) - x * t + ln(1 + exp(-abs(x)))) AS bce,
                    1 - (2 * sum(t / (1 + exp(-x))) + 1e-7) / (sum(1 / (1 + exp(-x))) + sum(t) + 1e-7) AS dice FROM r GROUP BY b)
       SELECT round(sum(bce * n) / sum(n), 6) AS bce, round(sum((bce + 0.5 * dice) * n) / sum(n), 6) AS combined_loss FROM p""",
)
def _(t):
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        (F.col("doc_id") % 8).alias("b"), ((F.col("n_chars") % 17 - 8) / 4.0).alias("x"), F.col("quality").cast("double").alias("t")
    )
    loss = op.bce_loss(rows, "x", "t", 0.5, "b")
    return loss.select(F.round("bce", 6).alias("bce"), F.round("combined_loss", 6).alias("combined_loss"))


@bind(
    "string_rollup",
    """WITH k AS (SELECT n_regionkey, n_name, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name, n_nationkey) - 1) // 3 AS chunk_no FROM nation)
       SELECT n_regionkey, chunk_no::BIGINT AS chunk_no, string_agg(n_name, '; ' ORDER BY n_name) AS joined FROM k GROUP BY ALL""",
)
def _(t):
    return op.string_rollup(t.nation, "n_regionkey", "n_name", "n_nationkey", chunk=3)
