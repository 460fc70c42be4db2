"""Field parsers on strings built from ``part`` the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_engine.operators import fields as op
from catalog_engine.operators import quality
from catalog_engine.plans.binding import bind


def cases(column, modulus, *values):
    """``CASE column % modulus WHEN 0 THEN ... END``; every value is SQL that both engines read alike."""
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {column} % {modulus} {whens} END"


DENOMINATIONS = cases(
    "p_partkey", 9, "concat(p_size, '½ Cents (old)', chr(10), ' note')", "p_name", "concat(p_size, '/5 x')", "concat('5 Francs = ', p_size, ' Ecu')", "'1/0 x'", "'1,000 Reis'",
    "'a / b c'", "'= 5'", "concat('⅜ ', p_name)",
)
EXPECTED_DENOMINATIONS = f"""SELECT p_partkey,
    {cases('p_partkey', 9, "p_size || ' 1/2 Cents'", "'1 ' || p_name", "p_size || '/5 x'", "'5 Francs'", "'1/0 x'", "'1,000 Reis'", "'1 a / b c'", "'1'", "'3/8 ' || p_name")} AS denomination_text,
    {cases('p_partkey', 9, "p_size + 0.5", "1", "CASE WHEN p_size > 9 THEN p_size // 10 + (p_size % 10) / 5 ELSE p_size / 5 END", "5", "NULL", "1", "1", "1", "0.375")}::DOUBLE AS denomination_value,
    CASE WHEN p_partkey % 9 = 0 THEN 'old' END AS info_1, CASE WHEN p_partkey % 9 = 0 THEN 'note' END AS info_2,
    CASE p_partkey % 9 WHEN 3 THEN p_size || ' Ecu' WHEN 7 THEN '5' END AS denomination_alt, p_partkey % 9 = 6 AS has_slash, FALSE AS non_digit_start FROM part"""


def denominations(t):
    return t.part.select("p_partkey", F.expr(DENOMINATIONS).alias("value"))


@bind("parse_denomination", EXPECTED_DENOMINATIONS)
def _(t):
    return op.parse_denomination(denominations(t), "value").drop("value")


WEIGHTS = cases(
    "p_partkey", 6, "concat(p_size, '.5 g (with ring)')", "concat(p_size, ',25 g')", "concat('about ', p_size, ' g')", "concat(chr(160), p_size, 'g', chr(160))", "concat(p_size, '.5d')", "'(none)'",
)
EXPECTED_WEIGHTS = f"""SELECT p_partkey, {cases('p_partkey', 6, 'p_size + 0.5', 'p_size + 0.25', 'NULL', 'p_size', 'NULL', 'NULL')}::DOUBLE AS weight,
    CASE p_partkey % 6 WHEN 0 THEN 'with ring' WHEN 5 THEN 'none' END AS weight_info,
    CASE p_partkey % 6 WHEN 2 THEN 'about ' || p_size || ' g' WHEN 4 THEN p_size || '.5d' WHEN 5 THEN '(none)' END AS weight_exception FROM part"""


def weights(t):
    # chr(160) is one byte in Spark, so the no-break space is written out
    return t.part.select("p_partkey", F.expr(WEIGHTS.replace("chr(160)", "'\u00a0'")).alias("raw"))


@bind("parse_measure", EXPECTED_WEIGHTS)
def _(t):
    return op.parse_measure(weights(t), "raw", "g", "weight").drop("raw")


@bind(
    "measure_unit_alarm",
    f"""SELECT p_partkey, CASE WHEN p_partkey % 3 <> 1 THEN p_size + 0.5 END::DOUBLE AS weight_value, CASE WHEN p_partkey % 2 = 0 THEN p_size END::DOUBLE AS diameter_value,
          p_partkey % 3 = 1 OR p_partkey % 2 = 1 AS alarm, nullif(concat_ws('; ', CASE WHEN p_partkey % 3 = 1 THEN 'Weight unit mismatch: expected ''g'', got ''oz''' END,
            CASE WHEN p_partkey % 2 = 1 THEN 'Diameter unit mismatch: expected ''mm'', got ''cm''' END), '') AS alarm_message FROM part""",
)
def _(t):
    weight = F.concat("p_size", F.when(F.col("p_partkey") % 3 == 1, ",5 oz").when(F.col("p_partkey") % 3 == 2, ".5G").otherwise(",5 g (x)"))
    diameter = F.concat("p_size", F.when(F.col("p_partkey") % 2 == 1, "cm").otherwise(" mm"))
    measured = t.part.select("p_partkey", weight.alias("weight"), diameter.alias("diameter"))
    return op.measure_unit_alarm(measured, {"weight": "g", "diameter": "mm"}).drop("weight", "diameter")


def shape_dim(t):
    return t.part.filter("p_type <> 'SMALL'").groupBy("p_type").agg(F.min("p_partkey").alias("id"))


def shapes(t):
    return t.part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.concat(F.lower("p_type"), F.lit(" (with hole) "))).otherwise(F.col("p_type")).alias("shape"))


EXPECTED_SHAPES = """WITH d AS (SELECT p_type, min(p_partkey) AS id FROM part WHERE p_type <> 'SMALL' GROUP BY 1)
    SELECT p_partkey, id AS shape_id, CASE WHEN id IS NULL THEN CASE WHEN p_size % 2 = 0 THEN 'small, with hole' ELSE p_type END WHEN p_size % 2 = 0 THEN 'with hole' END AS shape_info,
      CASE WHEN id IS NULL THEN CASE WHEN p_size % 2 = 0 THEN 'small (with hole) ' ELSE p_type END END AS shape_exception FROM part LEFT JOIN d USING (p_type)"""


@bind("parse_shape", EXPECTED_SHAPES)
def _(t):
    return op.parse_shape(shapes(t), "shape", shape_dim(t), "p_type", "id").drop("shape")


@bind(
    "map_labels",
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'pressed' WHEN 'view' THEN 'seen' ELSE 'failed' END AS field FROM events WHERE event_type IN ('click', 'view', 'error')",
)
def _(t):
    label = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), F.upper("event_type"), F.lit("  (g) :"))).otherwise(F.concat("event_type", F.lit(":")))
    events = t.events.select("event_id", F.regexp_replace(label, r" :$", ":").alias("label"))
    return op.map_labels(events, "label", {"click": "pressed", "view": "seen", "error": "failed"}).drop("label")


# --- validation ------------------------------------------------------------------------------------------------------

LISTING_SQL = """SELECT 'c' || o_orderstatus || '/' || CASE WHEN o_orderkey % 10 = 0 THEN 'x-' ELSE 'C' || o_orderstatus || '-' END || o_orderkey AS folder, o_orderkey FROM orders"""


@bind(
    "validate_structure",
    f"""WITH f AS ({LISTING_SQL}),
        files AS (SELECT folder, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 7 THEN 'sub' || l_partkey WHEN l_linenumber = 6 THEN 'n' || l_partkey || '.png' WHEN l_linenumber = 5 THEN 'n' || l_partkey || '.JPG'
                    WHEN l_linenumber = 4 THEN '.hidden' ELSE 'b' || l_linenumber || '-' || (1 + l_partkey % 2) || '.jpg' END AS name FROM lineitem JOIN f ON l_orderkey = o_orderkey),
        d AS (SELECT DISTINCT folder, name, l_linenumber AS n FROM files WHERE l_linenumber <> 4)
        SELECT 'NON_FOLDER_IN_ROOT' AS issue, 'readme' || r_regionkey AS path, '' AS detail FROM region
        UNION ALL SELECT 'NON_FOLDER_IN_COUNTRY', 'cF/file' || n_nationkey, '' FROM nation
        UNION ALL SELECT 'BAD_COIN_TYPE_NAME', folder, '' FROM f WHERE o_orderkey % 10 = 0
        UNION ALL SELECT 'EMPTY_COIN_TYPE_FOLDER', folder, '' FROM f WHERE folder NOT IN (SELECT folder FROM d)
        UNION ALL SELECT 'UNEXPECTED_SUBFOLDERS', folder, name FROM d WHERE n = 7
        UNION ALL SELECT 'NON_JPG_FILES', folder, name FROM d WHERE n = 6
        UNION ALL SELECT 'BAD_IMAGE_NAME', folder || '/' || name, '' FROM d WHERE n = 5
        UNION ALL SELECT 'INCOMPLETE_PAIR', folder || '/b' || n, CASE WHEN min(name) LIKE '%-1.jpg' THEN '2' ELSE '1' END FROM d WHERE n < 4 GROUP BY folder, n HAVING count(*) = 1""",
)
def _(t):
    status = F.col("o_orderstatus")
    leaf = F.when(F.col("o_orderkey") % 10 == 0, "x-").otherwise(F.concat(F.lit("C"), status, F.lit("-")))
    folders = t.orders.select("o_orderkey", F.concat(F.lit("c"), status, F.lit("/"), leaf, "o_orderkey").alias("folder"))
    line = F.col("l_linenumber")
    name = (
        F.when(line == 7, F.concat(F.lit("sub"), "l_partkey")).when(line == 6, F.concat(F.lit("n"), "l_partkey", F.lit(".png"))).when(line == 5, F.concat(F.lit("n"), "l_partkey", F.lit(".JPG")))
        .when(line == 4, ".hidden").otherwise(F.concat(F.lit("b"), line, F.lit("-"), 1 + F.col("l_partkey") % 2, F.lit(".jpg")))
    )
    files = t.lineitem.join(folders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat_ws("/", "folder", name).alias("path"), (line == 7).alias("is_dir"))
    listing = (
        files.distinct().unionByName(folders.select(F.col("folder").alias("path"), F.lit(True).alias("is_dir")))
        .unionByName(t.region.select(F.concat(F.lit("readme"), "r_regionkey").alias("path"), F.lit(False).alias("is_dir")))
        .unionByName(t.nation.select(F.concat(F.lit("cF/file"), "n_nationkey").alias("path"), F.lit(False).alias("is_dir")))
    )
    return quality.validate_structure(listing, "path", "is_dir")


@bind(
    "validate_links",
    """WITH l AS (SELECT page_id, 'en' AS owner, url, string_split(string_split(regexp_replace(split_part(url, 'example.', 2), '[?#].*$', ''), '/')[2], '-')[1] AS slug FROM pages)
       SELECT page_id, slug, CASE WHEN contains(slug, 'n') THEN 1 ELSE 2 END AS exception_type FROM (SELECT page_id, slug FROM l) WHERE slug NOT IN ('n', 'es')""",
)
def _(t):
    # the language part of the address plays the owner; 'n' is the owner of every listing page
    links = t.pages.select("page_id", F.lit("n").alias("owner"), F.regexp_replace("url", r"^(https?://[^/]*)/", "$1/coin/").alias("url"))
    owners = t.nation.select(F.lit("es").alias("slug")).union(t.nation.select(F.lit("n")))
    return quality.validate_links(links, "owner", "url", owners, "slug").select("page_id", "slug", "exception_type")


@bind(
    "parse_exceptions",
    f"""WITH w AS ({EXPECTED_WEIGHTS}), s AS ({EXPECTED_SHAPES}), d AS ({EXPECTED_DENOMINATIONS})
       SELECT p_partkey, weight_exception AS weight, shape_exception AS shape, CASE WHEN has_slash THEN 1 WHEN NOT has_slash THEN 0 END AS has_slash
       FROM w JOIN s USING (p_partkey) JOIN d USING (p_partkey) WHERE weight_exception IS NOT NULL OR shape_exception IS NOT NULL OR has_slash""",
)
def _(t):
    rows = t.part.select("p_partkey").join(weights(t), "p_partkey").join(shapes(t), "p_partkey").join(denominations(t), "p_partkey")
    parsed = op.parse_denomination(op.parse_shape(op.parse_measure(rows, "raw", "g", "weight"), "shape", shape_dim(t), "p_type", "id"), "value")
    found = quality.parse_exceptions(parsed, "p_partkey", {"weight": "weight_exception", "shape": "shape_exception"}, {"has_slash": "has_slash"})
    return found.select("p_partkey", "weight", "shape", "has_slash")


@bind(
    "verify_reference",
    """WITH p AS (SELECT o_orderkey, o_custkey % 40 AS owner, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 120 END AS parsed FROM orders)
       SELECT o_orderkey, CASE WHEN parsed IS NULL THEN NULL WHEN s_suppkey IS NOT NULL THEN 'verified' ELSE 'inspect' END AS state, s_name AS name
       FROM p LEFT JOIN supplier ON s_suppkey = parsed AND s_nationkey = owner""",
)
def _(t):
    parsed = t.orders.select("o_orderkey", (F.col("o_custkey") % 40).alias("owner"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 120).alias("parsed"))
    return quality.verify_reference(parsed, "owner", "parsed", t.supplier, "s_nationkey", "s_suppkey", {"s_name": "name"}).select("o_orderkey", "state", "name")


@bind(
    "verify_dimension",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 77 ELSE (SELECT min(n_nationkey) FROM nation WHERE n_name = 'NATION_' || (c_nationkey + 3)) END AS verified_id FROM customer""",
)
def _(t):
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, 77).alias("stored"), F.concat(F.lit("nation_"), F.col("c_nationkey") + 3).alias("parsed"))
    return quality.verify_dimension(rows, "stored", "parsed", t.nation, "n_name", "n_nationkey").select("c_custkey", "verified_id")


@bind(
    "reference_exists",
    "SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) AS has_reference FROM orders",
)
def _(t):
    return quality.reference_exists(t.orders.select("o_orderkey"), "o_orderkey", t.lineitem, "l_orderkey", F.col("l_linenumber") == 1)
