"""Validation and quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.functions.normalise import url_slug_part
from catalog_engine.operators.joins import lookup_nocase

# Names of the issues.
ISSUES = (
    "NON_FOLDER_IN_ROOT", "NON_FOLDER_IN_COUNTRY", "BAD_COIN_TYPE_NAME", "EMPTY_COIN_TYPE_FOLDER",
    "UNEXPECTED_SUBFOLDERS", "NON_JPG_FILES", "BAD_IMAGE_NAME", "INCOMPLETE_PAIR",
)


def validate_structure(listing: DataFrame, path: str, is_dir: str) -> DataFrame:
    """Issues of a three-level image tree (owner folder, entity folder, image pairs ``-1`` and ``-2``).

    Subfolders and files of a wrong kind come one per row. Names starting with a dot or underscore are ignored.
    """
    entries = listing.select(F.col(path).alias("path"), F.col(is_dir).alias("is_dir"), F.split(path, "/").alias("_p"))
    entries = entries.filter(~F.col("path").rlike("(^|/)[._]"))
    flat = entries.select(
        "path", "is_dir", F.size("_p").alias("depth"), F.element_at("_p", -1).alias("name"), F.lower(F.get("_p", F.lit(0))).alias("owner"),
        F.regexp_replace("path", "/[^/]*$", "").alias("folder"),
    )
    is_jpg, is_pair = F.lower("name").rlike(r"\.jpe?g$"), F.col("name").rlike(r"(?i)^.+-[12]\.jpe?g$")
    file = (F.col("depth") == 3) & ~F.col("is_dir")
    own_folder = (F.col("depth") == 2) & F.col("is_dir")

    def issue(code: str, place: Column, detail: Column) -> Column:
        return F.struct(F.lit(code).alias("issue"), place.alias("path"), detail.alias("detail"))

    nothing = F.lit("")
    # first pass: issues that one entry shows by itself
    single = F.array(
        F.when((F.col("depth") == 1) & ~F.col("is_dir"), issue(ISSUES[0], F.col("path"), nothing)),
        F.when((F.col("depth") == 2) & ~F.col("is_dir"), issue(ISSUES[1], F.col("path"), nothing)),
        F.when(own_folder & ~F.lower("name").startswith(F.concat("owner", F.lit("-"))), issue(ISSUES[2], F.col("path"), nothing)),
        F.when((F.col("depth") == 3) & F.col("is_dir"), issue(ISSUES[4], F.col("folder"), F.col("name"))),
        F.when(file & ~is_jpg, issue(ISSUES[5], F.col("folder"), F.col("name"))),
        F.when(file & is_jpg & ~is_pair, issue(ISSUES[6], F.col("path"), nothing)),
    )
    # second pass: what each folder and each pair holds, as (kind, key, member); "0" is the folder itself
    held = F.array(
        F.when(own_folder, F.struct(F.lit("folder").alias("kind"), F.col("path").alias("key"), F.lit("0").alias("member"))),
        F.when(F.col("depth") == 3, F.struct(F.lit("folder").alias("kind"), F.col("folder").alias("key"), F.lit("1").alias("member"))),
        F.when(file & is_pair, F.struct(
            F.lit("pair").alias("kind"), F.concat_ws("/", "folder", F.regexp_extract("name", r"(?i)^(.+)-[12]\.jpe?g$", 1)).alias("key"),
            F.regexp_extract("name", r"(?i)-([12])\.jpe?g$", 1).alias("member"),
        )),
    )
    members = flat.select(F.inline(F.array_compact(held))).groupBy("kind", "key").agg(F.min("member").alias("low"), F.max("member").alias("high"))
    empty = (F.col("kind") == "folder") & (F.col("high") == "0")
    lacking = (F.col("kind") == "pair") & (F.col("low") == F.col("high"))
    grouped = members.filter(empty | lacking).select(
        F.when(empty, ISSUES[3]).otherwise(ISSUES[7]).alias("issue"), F.col("key").alias("path"),
        F.when(empty, "").when(F.col("low") == "1", "2").otherwise("1").alias("detail"),
    )
    return flat.select(F.inline(F.array_compact(single))).unionByName(grouped)


def validate_links(links: DataFrame, owner: str, url: str, owners: DataFrame, slug: str, marker: str = "/coin/") -> DataFrame:
    """Links to an owner that is neither the page's own nor known; class 1 when the page's owner is inside the segment."""
    work = links.withColumn("slug", url_slug_part(url, marker)).withColumn("_segment", F.regexp_extract(url, rf"{marker}([^/?#]*)", 1))
    known = owners.select(F.col(slug).alias("_known")).distinct()
    strange = work.filter(F.col("slug") != F.col(owner)).join(known, F.col("slug") == F.col("_known"), "left_anti")
    inside = F.contains(F.regexp_replace("_segment", "[-_]+", "_"), F.col(owner))
    return strange.withColumn("exception_type", F.when(inside, 1).otherwise(2)).drop("_segment")


def parse_exceptions(parsed: DataFrame, key: str, texts: dict[str, str], flags: dict[str, str], earlier: DataFrame | None = None) -> DataFrame:
    """One row per entity that failed to parse: the raw text per failed field, 0/1 per flag; merged with earlier findings."""
    columns = [F.col(source).alias(out) for out, source in texts.items()] + [F.col(source).cast("int").alias(out) for out, source in flags.items()]
    failed = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in texts.values()] + [F.coalesce(F.col(c), F.lit(False)) for c in flags.values()])
    found = parsed.filter(failed).select(key, *columns)
    if earlier is None:
        return found
    joined = earlier.alias("e").join(found.alias("f"), F.col(f"e.{key}") == F.col(f"f.{key}"), "full_outer")
    return joined.select(*[F.coalesce(f"f.{c}", f"e.{c}").alias(c) for c in found.columns])


def verify_reference(parsed: DataFrame, owner: str, parsed_id: str, stored: DataFrame, stored_owner: str, stored_id: str, fields: dict[str, str]) -> DataFrame:
    """``verified`` with the stored fields when the parsed id belongs to the owner, ``inspect`` when not, NULL without an id."""
    first = stored.groupBy(F.col(stored_owner).alias("_owner"), F.col(stored_id).alias("_id")).agg(F.min(F.struct(*fields)).alias("_first"))
    joined = parsed.join(first, (F.col(owner) == F.col("_owner")) & (F.col(parsed_id) == F.col("_id")), "left")
    state = F.when(F.col(parsed_id).isNull(), None).when(F.col("_id").isNotNull(), "verified").otherwise("inspect")
    return joined.select(*parsed.columns, state.alias("state"), *[F.col(f"_first.{c}").alias(out) for c, out in fields.items()])


def verify_dimension(df: DataFrame, stored_id: str, parsed_name: str, dim: DataFrame, dim_name: str, dim_id: str) -> DataFrame:
    """The stored dimension id, else the one found by the parsed name."""
    found = lookup_nocase(df, dim, parsed_name, dim_name, dim_id, "_found")
    return found.withColumn("verified_id", F.coalesce(stored_id, "_found")).drop("_found")


def reference_exists(entities: DataFrame, key: str, samples: DataFrame, sample_key: str, is_reference: Column) -> DataFrame:
    """Whether each entity has a reference sample."""
    having = samples.filter(is_reference).select(F.col(sample_key).alias("_has")).distinct()
    return entities.join(having, F.col(key) == F.col("_has"), "left").select(*entities.columns, F.col("_has").isNotNull().alias("has_reference"))
