"""Sources, sinks, SQL surface and streaming on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_engine.plans.bind_extract import part_pages
from catalog_engine.plans.binding import bind
from catalog_engine.sources import addresses, catalog, files, sinks
from catalog_engine.streaming import incremental
from catalog_engine.workspace import fresh_path


def saved_files(t):
    """A text file per supplier below ``nation=n/entity=name_id``; every sixth folder has no id.

    A folder is written by one task, which also moves its files to their place; the job's end would move them one by one.
    """
    name = F.lower(F.translate("s_name", "#", "-"))
    folder = F.when(F.col("s_suppkey") % 6 == 0, name).otherwise(F.concat_ws("_", name, "s_suppkey"))
    path = fresh_path(t.spark, "saved")
    rows = t.dealt("supplier", folder).select(F.col("s_nationkey").alias("nation"), folder.alias("entity"), "s_name")
    rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("nation", "entity").text(path)
    return path


@bind(
    "scan_documents",
    """SELECT 'nation=' || s_nationkey AS "group", 'entity=' || lower(replace(s_name, '#', '-')) AS slug, s_suppkey AS entity_id, s_name || chr(10) AS text FROM supplier WHERE s_suppkey % 6 <> 0""",
)
def _(t):
    return files.scan_documents(t.spark, saved_files(t), "*.txt").select("group", "slug", "entity_id", "text")


@bind(
    "scan_listing",
    """WITH f AS (SELECT 'nation=' || s_nationkey AS top, 'entity=' || lower(replace(s_name, '#', '-')) || CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE '_' || s_suppkey END AS folder, length(s_name) + 1 AS length FROM supplier)
       SELECT false AS is_dir, top || '/' || folder AS place, NULL AS name, 'txt' AS ext, length FROM f
       UNION ALL SELECT DISTINCT true, '', top, '', NULL::BIGINT FROM f UNION ALL SELECT true, top, folder, '', NULL FROM f""",
)
def _(t):
    listing = files.scan_listing(t.spark, saved_files(t), ["TXT"], folders=True)
    above = F.regexp_replace("relative", "/?[^/]*$", "")
    # Spark chooses the names of the files
    return listing.select("is_dir", above.alias("place"), F.when(F.col("is_dir"), F.col("name")).alias("name"), "ext", "length")


@bind("read_json_rows", "SELECT event_id, (props->>'k')::BIGINT AS k, event_type FROM events")
def _(t):
    path = sinks.write_report(t.events.select("event_id", "event_type", F.from_json("props", "k long").alias("props")), fresh_path(t.spark, "json"), "json")
    rows = files.read_json_rows(t.spark, path, "event_id long, event_type string, props struct<k: long>")
    return rows.select("event_id", "props.k", "event_type")


@bind(
    "read_catalog_csv",
    """SELECT c_custkey AS id, c_name || ', "' || c_mktsegment || '"' AS name, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS nation FROM customer""",
)
def _(t):
    rows = t.customer.select("c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("n"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("k"))
    path = fresh_path(t.spark, "csv")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return files.read_catalog_csv(t.spark, path, "id long, name string, nation int")


def progress_log(t):
    path = fresh_path(t.spark, "log")
    t.events.orderBy("event_id").select(F.concat("event_type", "user_id", F.lit(", "), F.col("event_id") % 50)).write.text(path)
    return files.read_progress_log(t.spark, path)


@bind("read_progress_log", "SELECT event_type || user_id AS slug, (event_id % 50)::INT AS page, row_number() OVER (ORDER BY event_id) AS line_no FROM events")
def _(t):
    return progress_log(t).select("slug", "page", "line_no")


@bind("last_entry", "SELECT event_type || user_id AS slug, (event_id % 50)::INT AS page FROM events WHERE event_id = (SELECT max(event_id) FROM events)")
def _(t):
    return files.last_entry(progress_log(t)).select("slug", "page")


@bind("read_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    return files.read_table(t.spark, t.root, "nation")


@bind("write_report", "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus FROM orders")
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    path = sinks.write_report(rows, fresh_path(t.spark, "report"), "csv")
    return t.spark.read.schema(rows.schema).option("header", True).option("nullValue", "\\N").option("escape", '"').csv(path)


@bind("publish", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 100 + n_nationkey, n_name FROM nation")
def _(t):
    path = fresh_path(t.spark, "table")
    base = t.nation.select("n_nationkey", "n_name")
    sinks.publish(base, path)
    state = t.spark.read.parquet(path)
    sinks.publish(state.unionByName(state.withColumn("n_nationkey", F.col("n_nationkey") + 100)), path)
    return t.spark.read.parquet(path)


def views(t):
    for name in ("orders", "part", "pages"):
        t(name).createOrReplaceTempView(name)


@bind("run_sql", "SELECT '{\"o_orderstatus\":\"' || o_orderstatus || '\",\"n\":' || count(*) || ',\"nothing\":null}' AS \"row\" FROM orders GROUP BY o_orderstatus")
def _(t):
    views(t)
    return catalog.run_sql(t.spark, "SELECT o_orderstatus, count(*) AS n, cast(NULL AS INT) AS nothing FROM orders GROUP BY o_orderstatus")


@bind(
    "expand_pages",
    r"""SELECT page_id, n::INT AS page, CASE WHEN contains(url, 'page=') THEN regexp_replace(url, 'page=[0-9]+', 'page=' || n, 'g') ELSE url || '&page=' || n END AS page_url
        FROM pages, (SELECT unnest(range(2, 7)) AS n) WHERE n <= page_id % 7""",
)
def _(t):
    return addresses.expand_pages(t.pages.select("page_id", "url"), "url", F.col("page_id") % 7, F.lit(2)).select("page_id", "page", "page_url")


@bind(
    "asset_url",
    """SELECT p_partkey, CASE p_size % 3 WHEN 1 THEN 'https://a/ref/' || p_brand || '/' || p_name || '-original.jpg' WHEN 2 THEN 'https://a/ex/' || p_name || '.jpg' ELSE 'https://a/sale/' || p_name || '.jpg' END AS url,
         'https://i/' || p_size || '/' || p_partkey || '-2/' || p_name || '.jpg' AS face, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE 'XXXX' END || '-' || p_partkey || '-2.jpg' AS local FROM part""",
)
def _(t):
    rows = t.part.withColumn("file", F.concat("p_name", F.lit(".jpg"))).withColumn("year", F.when(F.col("p_size") % 2 == 0, F.col("p_size")))
    bases = {1: "https://a/ref/", 2: "https://a/ex/", 3: "https://a/sale/"}
    return rows.select(
        "p_partkey", addresses.asset_url(F.when(F.col("p_size") % 3 == 0, 3).otherwise(F.col("p_size") % 3), "file", "p_brand", bases).alias("url"),
        addresses.face_url("https://i/", "p_size", "p_partkey", F.lit(2), "file").alias("face"), addresses.face_file("year", "p_partkey", F.lit(2)).alias("local"),
    )


@bind(
    "register_functions",
    """SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS slug, p_size AS first_year, p_name AS bare, 'p' || p_partkey AS file FROM part""",
)
def _(t):
    views(t)
    catalog.register_functions(t.spark)
    return t.spark.sql(
        """SELECT p_partkey, slugify(concat(' ', p_name, ' ')) AS slug, start_year(concat('c. ', p_size)) AS first_year, split_parenthetical(concat(p_name, ' (', p_type, ')')).name AS bare,
             file_name(concat('https://h/a/p', p_partkey, '?x')) AS file FROM part"""
    )


@bind(
    "html_rows",
    """WITH c(row_no, cell_no, is_header, fixed) AS (VALUES (1, 1, true, 'Issuer:'), (2, 1, true, 'Value'), (3, 1, true, 'Weight (max)'), (4, 1, true, 'Edge'), (4, 2, false, 'Reeded & fine'), (5, 1, false, 'Size'), (6, 1, true, 'Issuer'), (6, 2, false, 'wrong'))
       SELECT p_partkey, row_no, cell_no, is_header, fixed AS text FROM part, c UNION ALL SELECT p_partkey, 1, 2, false, p_brand FROM part
       UNION ALL SELECT p_partkey, 2, 2, false, p_size || ' Cents (old) second line' FROM part UNION ALL SELECT p_partkey, 3, 2, false, p_retailprice || ' g hint' FROM part
       UNION ALL SELECT p_partkey, 5, 2, false, p_size || ' mm' FROM part""",
)
def _(t):
    catalog.register_html_rows(t.spark)
    part_pages(t).createOrReplaceTempView("part_pages")
    return t.spark.sql("SELECT p_partkey, row_no, cell_no, is_header, text FROM part_pages, LATERAL html_rows(html)")


# --- streaming -------------------------------------------------------------------------------------------------------


def event_stream(t):
    return incremental.file_stream(t.spark, t.root, t.events.schema, "events.parquet")


@bind("ingest_incremental", "SELECT event_id, user_id, event_type, value FROM events")
def _(t):
    target, checkpoint = fresh_path(t.spark, "ingested"), fresh_path(t.spark, "progress")
    for _run in range(2):  # the second run finds nothing new
        incremental.ingest_incremental(event_stream(t).select("event_id", "user_id", "event_type", "value"), target, checkpoint)
    return t.spark.read.parquet(target)


@bind(
    "stream_upsert",
    """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id UNION ALL SELECT -1, 0, 'seed'""",
)
def _(t):
    target = fresh_path(t.spark, "users")
    rows = t.events.select("user_id", "event_id", "event_type")
    start = t.events.agg(F.count(F.lit(1))).select(F.lit(-1).cast("bigint").alias("user_id"), F.lit(0).cast("bigint").alias("event_id"), F.lit("seed").alias("event_type"))
    sinks.publish_buckets(sinks.in_buckets(start, ["user_id"], 8), target, ["user_id"])
    newer = F.col("event_id") > rows.agg(F.avg("event_id").alias("m")).scalar()
    for half in (newer, ~newer):  # the older rows come last and change nothing
        inbox, checkpoint = fresh_path(t.spark, "inbox"), fresh_path(t.spark, "progress")
        rows.filter(half).write.parquet(inbox)
        feed = incremental.file_stream(t.spark, inbox, rows.schema)
        incremental.stream_upsert(feed, target, ["user_id"], ["event_type"], checkpoint, "event_id", buckets=8)
    return sinks.read_buckets(t.spark, target).drop(sinks.BUCKET)


@bind("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    target, checkpoint = fresh_path(t.spark, "distinct"), fresh_path(t.spark, "progress")
    unique = incremental.stream_dedup(event_stream(t).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "1 day")
    incremental.ingest_incremental(unique.drop("ts"), target, checkpoint)
    return t.spark.read.parquet(target)


@bind(
    "high_water",
    "SELECT event_id, event_type, (SELECT max(event_id) FROM events) AS mark FROM events WHERE event_id > 500 AND event_id % 3 <> 0",
)
def _(t):
    stored = t.events.filter("event_id % 3 = 0").select("event_id")
    fresh = incremental.high_water(t.events.select("event_id", "event_type"), "event_id", 500, stored, "event_id")
    return fresh.withColumn("mark", incremental.next_mark(t.events, "event_id", 500).scalar())
