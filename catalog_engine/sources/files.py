"""Readers for files and relational tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_engine.functions.normalise import folder_id, folder_slug
from catalog_engine.operators.numbering import global_row_number

IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp")


def document_columns(files: DataFrame, path: str, text: Column) -> DataFrame:
    """Split ``.../{group}/{slug}_{id}/file`` into columns; folders without a numeric id are skipped."""
    parts = files.select(F.split(path, "/").alias("_p"), F.col(path).alias("path"), text.alias("text"))
    named = parts.withColumn("group", F.try_element_at("_p", F.lit(-3))).withColumn("folder", F.try_element_at("_p", F.lit(-2)))
    keyed = named.withColumn("entity_id", folder_id("folder")).filter("entity_id IS NOT NULL")
    return keyed.select("group", folder_slug("folder").alias("slug"), "entity_id", "path", "text")


def scan_documents(spark: SparkSession, root: str, file_glob: str = "*.html") -> DataFrame:
    """Saved pages below a root as (group, slug, entity_id, path, text)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", file_glob).option("recursiveFileLookup", True).load(root)
    return document_columns(files, "path", F.decode("content", "UTF-8"))


def listing_columns(files: DataFrame, path: str) -> DataFrame:
    """Add folder, name, lower-case name key and extension to a table of paths."""
    name = F.substring_index(path, "/", -1)
    return files.select(
        "*", F.regexp_replace(path, "/[^/]*$", "").alias("dir"), name.alias("name"), F.lower(name).alias("name_key"),
        F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).alias("ext"),
    )


def scan_listing(spark: SparkSession, root: str, extensions: list[str] | None = None, folders: bool = False) -> DataFrame:
    """Files below a root with size and time; file bodies are never read.

    ``relative`` is the path below the root. With ``folders``, every folder that holds a file at any depth has a row too
    (``is_dir``); a folder without any file is not seen, because Spark lists files.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    named = files.select(F.lit(False).alias("is_dir"), F.substr("path", F.lit(len(base) + 1)).alias("relative"), "*")
    listed = listing_columns(named, "path")
    kept = listed.filter(F.col("ext").isin([e.lower() for e in extensions])) if extensions else listed
    if not folders:
        return kept
    parts = F.split("relative", "/")
    above = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))
    found = named.select(F.explode(above).alias("relative")).distinct()
    rows = found.select(
        F.lit(True).alias("is_dir"), "relative", F.concat(F.lit(base), "relative").alias("path"), F.lit(None).cast("bigint").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime")
    )
    return kept.unionByName(listing_columns(rows, "path").withColumn("ext", F.lit("")))


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images; files that do not decode stay, with height -1."""
    return spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(root)


def read_json_rows(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines, or files that hold one array or object each; every file of a folder is judged by its own first line."""
    reader = lambda: spark.read.schema(schema) if schema is not None else spark.read
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("place")).filter("line <> ''")
    first = lines.groupBy("file").agg(F.min_by("line", "place").alias("line"))
    shapes = first.select("file", (F.col("line").startswith("[") | ~F.col("line").endswith("}")).alias("whole")).collect()  # a row per file
    parts = [reader().option("multiLine", whole).json([r["file"] for r in shapes if r["whole"] == whole]) for whole in {r["whole"] for r in shapes}]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else reader().json(path)


def read_catalog_csv(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """Delimited text with a header; the schema is applied by position, so repeated header names do no harm.

    A quote inside a quoted field is doubled, and such a field may hold line ends.
    """
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("escape", '"').option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return reader.csv(path)


def progress_entries(lines: DataFrame, line: str) -> DataFrame:
    """``slug,page`` lines as columns; a line of another shape raises."""
    good = F.col(line).rlike(r"^[^,]+,\s*\d+\s*$")
    checked = F.when(good, F.col(line)).otherwise(F.raise_error(F.concat(F.lit("bad progress line: "), F.col(line))))
    return lines.withColumn(line, checked).select(
        *[c for c in lines.columns if c != line], F.trim(F.substring_index(line, ",", 1)).alias("slug"), F.trim(F.substring_index(line, ",", -1)).cast("int").alias("page")
    )


def read_progress_log(spark: SparkSession, path: str) -> DataFrame:
    """The progress log in file order, with ``line_no``; its last entry is the resume point."""
    place = {"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()}
    lines = spark.read.text(path).select("value", *[c.alias(n) for n, c in place.items()]).filter(F.trim("value") != "")
    numbered = global_row_number(lines, [F.col(n) for n in place], "line_no").select("value", "line_no")
    return progress_entries(numbered, "value")


def last_entry(log: DataFrame, order: str = "line_no") -> DataFrame:
    """The entry to resume from."""
    columns = [c for c in log.columns if c != order]
    return log.agg(F.max(F.struct(order, *columns)).alias("_l")).filter("_l IS NOT NULL").select(*[F.col(f"_l.{c}").alias(c) for c in columns])


def read_table(spark: SparkSession, location: str, name: str, **options: str) -> DataFrame:
    """A relational table: over JDBC for a ``jdbc:`` location, else Parquet below a folder."""
    if location.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=location, dbtable=name, **options).load()
    return spark.read.parquet(f"{location}/{name}.parquet")
