"""Duplicates, hashes and similarity of images and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.functions import normalise as n
from catalog_engine.functions.arrays import let
from catalog_engine.operators.filters import changed_rows
from catalog_engine.operators.numbering import spread_row_number
from catalog_engine.workspace import staged

# --- exact duplicates ------------------------------------------------------------------------------------------------


def content_hash(column: str) -> Column:
    """Digest of the raw bytes or text."""
    return F.md5(column)


def pixel_hash(image: str) -> Column:
    """Digest of size, mode and decoded pixels, so metadata does not count; NULL when the file does not decode."""
    size = F.concat_ws("x", F.col(f"{image}.width"), F.col(f"{image}.height"), F.col(f"{image}.mode"), F.lit(""))
    return F.when(F.col(f"{image}.height") > 0, F.md5(F.concat(F.encode(size, "UTF-8"), F.col(f"{image}.data"))))


def exact_duplicates(df: DataFrame, scope: str, digest: str, kind: str, size: str, name: str) -> DataFrame:
    """(scope, deleted, survivor) for equal content within a scope.

    The survivor is of kind 1, else of kind 3, else any; then the largest, then the first by name. It comes from one
    aggregate per content, so a content that a third of all rows share is reduced before it is shuffled.
    """
    rank = F.when(F.col(kind) == 1, 0).when(F.col(kind) == 3, 1).otherwise(2)
    best = F.min(F.struct(rank.alias("r"), (-F.col(size)).alias("s"), F.col(name).alias("n")))["n"].alias("survivor")
    groups = df.groupBy(F.col(scope).alias("_scope"), F.col(digest).alias("_digest")).agg(best, F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    joined = df.join(groups, F.col(scope).eqNullSafe(F.col("_scope")) & (F.col(digest) == F.col("_digest")))
    return joined.filter(F.col(name) != F.col("survivor")).select(scope, F.col(name).alias("deleted"), "survivor")


# --- difference hashes -----------------------------------------------------------------------------------------------


def dhash64(brightness: str, width: int = 9, stretch: bool = True) -> Column:
    """Bit (row, column) is set when a cell is brighter than its right neighbour.

    ``stretch`` first clips the darkest and brightest twentieth, which turns tiny differences at the ends into ties.
    """
    columns = width - 1
    cells = F.col(brightness)
    one = F.lit(1).cast("bigint")

    def clip(ordered: Column) -> Column:
        skip = F.floor(F.size(ordered) * 0.05).cast("int")
        ends = F.struct(F.get(ordered, skip).alias("low"), F.get(ordered, F.size(ordered) - 1 - skip).alias("high"))
        return let(ends, lambda e: F.transform(cells, lambda v: F.least(F.greatest(v, e["low"]), e["high"])))

    def bits(values: Column) -> Column:
        numbers = F.sequence(F.lit(0), (F.size(values) / width).cast("int") * columns - 1)
        left = lambda i: F.get(values, (F.floor(i / columns) * width + i % columns).cast("int"))
        right = lambda i: F.get(values, (F.floor(i / columns) * width + i % columns + 1).cast("int"))
        bit = lambda i: F.when(left(i) > right(i), F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("bigint"))
        return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda acc, i: acc.bitwiseOR(bit(i)))

    return let(let(F.array_sort(cells), clip) if stretch else cells, bits)


def _area_weights(source: int, target: int) -> np.ndarray:
    """How much each source cell adds to each target cell when both divide the same length."""
    edges = np.linspace(0, source, target + 1)
    cells = np.arange(source)
    overlap = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
    weights = np.clip(overlap, 0, None)
    return weights / weights.sum(axis=1, keepdims=True)


def resample(mode: str = "luma", left: float = 0.0, right: float = 1.0) -> Callable[[str], Column]:
    """Function from an image column to its 9 by 8 brightness values (area mean).

    ``luma`` weighs the channels, ``average`` does not, ``blue`` takes one; ``left`` and ``right`` cut a vertical strip,
    which gives the two halves of a combined image.
    """

    def brightness(frame: pd.DataFrame) -> pd.Series:
        out = []
        for height, width, channels, data in zip(frame["height"], frame["width"], frame["nChannels"], frame["data"], strict=True):
            if data is None or not (height > 0 and width > 0):  # no picture, or one that could not be read
                out.append(None)
                continue
            height, width, channels = int(height), int(width), int(channels)
            start, stop = int(width * left), int(width * right)
            if stop <= start:
                out.append(None)
                continue
            pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)[:, start:stop].astype(np.float64)
            if channels < 3 or mode == "blue":
                grey = pixels[:, :, 0]
            elif mode == "average":
                grey = pixels[:, :, :3].mean(axis=2)
            else:
                grey = pixels[:, :, :3] @ np.array([0.114, 0.587, 0.299])  # stored blue, green, red
            small = _area_weights(height, 8) @ grey @ _area_weights(stop - start, 9).T
            out.append(np.round(small, 6).ravel().tolist())
        return pd.Series(out)

    brightness.__annotations__ = {"frame": pd.DataFrame, "return": pd.Series}
    # marked so that the optimiser keeps it as a column of its own instead of inlining it into array expressions
    return F.pandas_udf(brightness, "array<double>").asNondeterministic()


# --- near duplicates -------------------------------------------------------------------------------------------------


def _bands(limit: int) -> tuple[int, int, int]:
    """(bands, bits per band, radius): within ``limit`` differing bits, some band differs in at most ``radius``."""
    for bands, most in ((4, 3), (8, 2), (16, 2)):
        if limit // bands <= most:
            return bands, 64 // bands, limit // bands
    raise ValueError("hashes that differ in this many bits are not similar")


#: from this distance on a scope has two leaders at most; under it similar pairs are found by bands
FEW_LEADERS = 48


def _distinct_hashes(df: DataFrame, scope: str, digest: str, order: str) -> DataFrame:
    """One row per scope and hash value: its first row and how many there are."""
    return df.filter(F.col(digest).isNotNull()).groupBy(scope, digest).agg(F.min(order).alias("first_id"), F.count(F.lit(1)).alias("copies"))


#: how many comparisons of two hashes take the time of one look-up of a band value
COMPARED = 100


def _near_hashes(hashes: DataFrame, scope: str, digest: str, limit: int, block: int = 4096) -> DataFrame:
    """Pairs of distinct hashes of a scope within ``limit`` bits, by comparing all or by bands, whichever is less work."""
    sizes = staged(hashes.groupBy(F.col(scope).alias("_sized")).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    rows, squares = sizes.agg(F.sum("_n"), F.sum(F.col("_n").cast("double") * F.col("_n"))).first()
    bands, bits, radius = _bands(limit)
    if (squares or 0) / 2 > COMPARED * (rows or 0) * bands * sum(comb(bits, k) for k in range(radius + 1)):
        return _near_by_bands(hashes, scope, digest, limit)
    return _near_by_blocks(hashes, sizes, scope, digest, limit, block)


def _near_by_blocks(hashes: DataFrame, sizes: DataFrame, scope: str, digest: str, limit: int, block: int) -> DataFrame:
    """All hashes of a scope compared: they are dealt into blocks, and every two blocks meet in one cell, which is all that a
    task holds at a time."""
    spark = hashes.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    counted = hashes.join(sizes, F.col(scope).eqNullSafe(F.col("_sized"))).withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    dealt = counted.withColumn("_own", F.pmod(F.xxhash64(digest), F.col("_blocks")).cast("int"))

    def side(name: str, low: Column, high: Column) -> DataFrame:
        met = dealt.select(scope, F.col(digest).alias(f"hash_{name}"), F.col("first_id").alias(f"id_{name}"), "_own", F.explode(F.sequence(low, high)).alias("_other"))
        least, most = F.least("_own", "_other"), F.greatest("_own", "_other")
        cell = met.withColumn("_cell", F.xxhash64(scope, least, most)).withColumn("_pair", F.struct(least.alias("low"), most.alias("high")))
        return cell.repartition(tasks, "_cell").select(F.col(scope).alias(f"_scope_{name}"), f"hash_{name}", f"id_{name}", "_cell", F.col("_pair").alias(f"_pair_{name}"))

    one, two = side("a", F.col("_own"), F.col("_blocks") - 1), side("b", F.lit(0), F.col("_own"))
    # different cells may have one hash; inside a block each two are taken once
    same = F.col("_scope_a").eqNullSafe(F.col("_scope_b")) & (F.col("_pair_a") == F.col("_pair_b"))
    once = (F.col("_pair_a.low") < F.col("_pair_a.high")) | (F.col("hash_a") < F.col("hash_b"))
    distance = F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b")))
    near = one.join(two.withColumnRenamed("_cell", "_bcell"), (F.col("_cell") == F.col("_bcell")) & F.when(distance <= limit, same & once).otherwise(False))
    return near.select(F.col("_scope_a").alias(scope), "hash_a", "id_a", "hash_b", "id_b", distance.alias("distance"))


def _near_by_bands(hashes: DataFrame, scope: str, digest: str, limit: int) -> DataFrame:
    """The same, found by equal bands instead of comparing all.

    One side is stored under each of its bands, the other looks up every band value within the radius. A pair is kept only
    in its first such band, so no pair comes twice.
    """
    bands, bits, radius = _bands(limit)
    mask = (1 << bits) - 1
    flips = [sum(1 << b for b in chosen) for size in range(radius + 1) for chosen in combinations(range(bits), size)]
    band = lambda value, i: F.call_function("shiftrightunsigned", value, i * bits).bitwiseAND(mask)
    numbers = F.sequence(F.lit(0), F.lit(bands - 1))
    stored = hashes.select(
        F.col(scope).alias("_scope"), F.col(digest).alias("hash_b"), F.col("first_id").alias("id_b"), F.explode(numbers).alias("_band")
    ).withColumn("_value", band(F.col("hash_b"), F.col("_band")))
    asked = hashes.select(scope, F.col(digest).alias("hash_a"), F.col("first_id").alias("id_a"), F.explode(numbers).alias("_aband"))
    masks = F.lit(np.array(flips, dtype=np.int64))
    asked = asked.withColumn("_own", band(F.col("hash_a"), F.col("_aband"))).withColumn("_avalue", F.explode(F.transform(masks, lambda m: F.col("_own").bitwiseXOR(m))))
    met = asked.join(stored, F.col(scope).eqNullSafe(F.col("_scope")) & (F.col("_aband") == F.col("_band")) & (F.col("_avalue") == F.col("_value")))
    differing = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    near = met.filter(F.col("hash_a") < F.col("hash_b")).withColumn("distance", F.bit_count(differing)).filter(F.col("distance") <= limit)
    earlier = F.filter(numbers, lambda i: (i < F.col("_band")) & (F.bit_count(band(differing, i)) <= radius))
    return near.filter(F.size(earlier) == 0).select(scope, "hash_a", "id_a", "hash_b", "id_b", "distance")


def hamming_pairs(df: DataFrame, scope: str, digest: str, row_id: str, limit: int = 9) -> DataFrame:
    """Similar rows of a scope as (id_a, id_b, distance).

    Rows with one and the same hash are linked to the first of them, and only the first ones are compared, so many copies
    give many links but never all their pairs.
    """
    hashes = staged(_distinct_hashes(df, scope, digest, row_id), "hashes")
    near = _near_hashes(hashes, scope, digest, limit)
    pairs = near.select(scope, F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "distance")
    first = hashes.filter("copies > 1").select(F.col(scope).alias("_scope"), F.col(digest).alias("_digest"), F.col("first_id").alias("id_a"))
    copies = df.join(first, F.col(scope).eqNullSafe(F.col("_scope")) & (F.col(digest) == F.col("_digest"))).filter(F.col(row_id) != F.col("id_a"))
    return pairs.unionByName(copies.select(scope, "id_a", F.col(row_id).alias("id_b"), F.lit(0).alias("distance")))


def leader_groups(df: DataFrame, scope: str, digest: str, order: str, limit: int = 9) -> DataFrame:
    """Greedy groups in order: the first free row leads and takes every free row within ``limit`` bits of it.

    Groups of one get NULL, the others are numbered from 1 per scope. Rows with equal hashes always share a leader, so only
    distinct hashes are grouped. They are settled in rounds over their similar pairs: a hash leads as soon as no earlier
    undecided hash is near, and takes its neighbours. Rows with a null scope are one scope; a null hash is in no group.
    """
    # as a struct a null scope is equal to itself in joins
    hashes = staged(_distinct_hashes(df, scope, digest, order).withColumn(scope, F.struct(F.col(scope).alias("s"))), "hashes")
    lead = _lead_in_rounds if limit < FEW_LEADERS else _lead_by_two
    led = staged(lead(hashes, scope, digest, limit), "leaders")
    sizes = led.groupBy(scope, "leader").agg(F.sum("copies").alias("_size")).filter("_size > 1")
    numbered = spread_row_number(sizes, [scope], [F.col("leader")], "group_id").select(F.col(scope).alias("_gscope"), F.col("leader").alias("_leader"), "group_id")
    grouped = led.join(numbered, (F.col(scope) == F.col("_gscope")) & (F.col("leader") == F.col("_leader")), "left")
    keyed = grouped.select(F.col(f"{scope}.s").alias("_scope"), F.col(digest).alias("_digest"), "group_id")
    joined = df.join(keyed, F.col(scope).eqNullSafe(F.col("_scope")) & (F.col(digest) == F.col("_digest")), "left")
    return joined.drop("_scope", "_digest")


def _lead_by_two(hashes: DataFrame, scope: str, digest: str, limit: int) -> DataFrame:
    """Leaders where a scope has two at most: no three hashes of 64 bits differ by 49 or more from each other, as of three
    bits two are always equal (Plotkin's bound). The first hash leads, and the first that is not near it leads the rest."""
    earliest = lambda rows, name: rows.groupBy(F.col(scope).alias(f"_{name}")).agg(F.min(F.struct("first_id", digest)).alias(name))
    joined = hashes.join(earliest(hashes, "one"), F.col(scope) == F.col("_one"))
    near = F.bit_count(F.col(digest).bitwiseXOR(F.col(f"one.{digest}"))) <= limit
    both = joined.withColumn("_near", near)
    rest = earliest(both.filter(~F.col("_near")), "two")
    leader = F.when(F.col("_near"), F.col("one.first_id")).otherwise(F.col("two.first_id"))
    return both.join(rest, F.col(scope) == F.col("_two"), "left").select(*hashes.columns, leader.alias("leader"))


def _lead_in_rounds(hashes: DataFrame, scope: str, digest: str, limit: int) -> DataFrame:
    near = _near_hashes(hashes, scope, digest, limit)
    pairs = staged(near.select(scope, F.least("id_a", "id_b").alias("early"), F.greatest("id_a", "id_b").alias("late")), "pairs")
    key = lambda *names: [F.col(c) for c in names]
    undecided, open_pairs, leaders = hashes.select(scope, F.col("first_id").alias("id")), pairs, None
    while True:
        blocked = open_pairs.select(*key(scope), F.col("late").alias("id")).distinct()
        found = staged(undecided.join(blocked, [scope, "id"], "left_anti"), "led")
        if found.isEmpty():
            break
        leaders = found if leaders is None else leaders.unionByName(found)
        taken = open_pairs.join(found.withColumnRenamed("id", "early"), [scope, "early"], "left_semi").select(scope, F.col("late").alias("id")).distinct()
        undecided = staged(undecided.join(found, [scope, "id"], "left_anti").join(taken, [scope, "id"], "left_anti"), "open")
        for side in ("early", "late"):
            open_pairs = open_pairs.join(undecided.withColumnRenamed("id", side), [scope, side], "left_semi")
        open_pairs = staged(open_pairs, "pairs")
    first = pairs.join(leaders.withColumnRenamed("id", "early"), [scope, "early"], "left_semi").groupBy(scope, F.col("late").alias("first_id")).agg(F.min("early").alias("_led_by"))
    own = leaders.select(scope, F.col("id").alias("first_id"), F.lit(True).alias("_leads"))
    joined = hashes.join(own, [scope, "first_id"], "left").join(first, [scope, "first_id"], "left")
    leader = F.when(F.col("_leads"), F.col("first_id")).otherwise(F.col("_led_by"))
    return joined.select(*hashes.columns, leader.alias("leader"))


def similar_components(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """Connected components of a pair table, labelled by their smallest id.

    Alternates two steps until nothing changes: every node hands its larger neighbours, then its smaller ones, to the
    smallest id it knows. The number of rounds grows with the logarithm of the data, and each minimum is combined before
    the shuffle, so a node with very many neighbours is harmless.
    """
    edges = staged(pairs.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter("u <> v").distinct(), "edges")

    def lowest(near: DataFrame) -> DataFrame:
        return near.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("_u", "_m").alias("m"))

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = both.join(lowest(both), F.col("u") == F.col("_u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = lowest(large)
        handed = large.join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = handed.unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = staged(small, "edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(roots)


# --- vectors ---------------------------------------------------------------------------------------------------------


def _unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))) + 1e-8
    return let(norm, lambda length: F.transform(vector, lambda v: v.cast("double") / length))


def _dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def detect_swaps(samples: DataFrame, group: str, is_reference: Column, row_id: str, front: str, back: str, margin: float = 0.0) -> DataFrame:
    """Samples whose faces fit their group's first reference better crosswise than straight.

    Vectors are scaled once per sample, before the join, so that each of the four similarities is a plain dot product.
    """
    scaled = samples.select(row_id, group, is_reference.alias("_ref"), _unit(F.col(front)).alias("_f"), _unit(F.col(back)).alias("_b"))
    refs = scaled.filter("_ref").groupBy(F.col(group).alias("_group")).agg(F.min(F.struct(row_id, "_f", "_b")).alias("_r"))
    pairs = scaled.filter(~F.col("_ref")).join(refs, F.col(group) == F.col("_group"))
    scored = pairs.select(
        row_id, group, F.col(f"_r.{row_id}").alias("reference_id"),
        (_dot("_f", "_r._f") + _dot("_b", "_r._b")).alias("match_score"), (_dot("_f", "_r._b") + _dot("_b", "_r._f")).alias("flip_score"),
    )
    return scored.withColumn("swapped", F.col("flip_score") > F.col("match_score") + margin)


# --- image properties ------------------------------------------------------------------------------------------------


def resolution(width: str, height: str) -> Column:
    """Number of pixels, 0 when unreadable: unless both sides are positive."""
    return F.when((F.col(width) > 0) & (F.col(height) > 0), F.col(width).cast("bigint") * F.col(height)).otherwise(0).cast("bigint")


def is_holder(width: str, height: str) -> Column:
    """A coin holder is at least half and less than 0.85 times as wide as it is high."""
    ratio = F.col(width) / F.nullif(F.col(height), F.lit(0))
    return F.coalesce((ratio >= 0.5) & (ratio < 0.85), F.lit(False)).cast("int")


def detect_holders(df: DataFrame, key: str, width: str, height: str, stored: str) -> DataFrame:
    """Rows whose holder flag must change, with the new flag."""
    found = df.select(key, is_holder(width, height).alias(stored))
    return changed_rows(df.select(key, stored), found, key, [stored])


def broken_images(images: DataFrame, image: str = "image") -> DataFrame:
    """Images that did not decode, with owner folder, slug, id and file name from their path."""
    broken = images.filter(F.col(f"{image}.height") <= 0).withColumn("_path", F.split(F.col(f"{image}.origin"), "/"))
    folder = broken.withColumn("file", F.element_at("_path", -1)).withColumn("folder", F.element_at("_path", -3)).withColumn("owner", F.try_element_at("_path", F.lit(-4)))
    return folder.select("owner", n.folder_slug("folder").alias("slug"), n.folder_id("folder").alias("entity_id"), "file")


def corner_stats(size: int = 20) -> Callable[[str], Column]:
    """Function from an image column to the mean standard deviation of its four corners."""

    def spread(frame: pd.DataFrame) -> pd.Series:
        out = []
        for height, width, channels, data in zip(frame["height"], frame["width"], frame["nChannels"], frame["data"], strict=True):
            if data is None or not (height > 0 and width > 0):
                out.append(None)
                continue
            height, width, channels = int(height), int(width), int(channels)
            p = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
            corners = (p[:size, :size], p[:size, -size:], p[-size:, :size], p[-size:, -size:])
            out.append(float(np.mean([np.std(c) for c in corners])))
        return pd.Series(out)

    spread.__annotations__ = {"frame": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(spread, "double").asNondeterministic()


def split_position(width: Column, boxes: str, peak: Callable[[Column, Column], Column]) -> Column:
    """Where to cut a combined image: between two boxes, in the middle of one, else at the centre; then snapped to a line.

    ``boxes`` holds structs (x, width) ordered from the left; ``peak(start, stop)`` gives the strongest line in a range.
    """
    first, second = F.get(boxes, F.lit(0)), F.get(boxes, F.lit(1))
    rough = (
        F.when(F.size(boxes) >= 2, F.floor((first["x"] + first["width"] + second["x"]) / 2))
        .when(F.size(boxes) == 1, first["x"] + F.floor(first["width"] / 2)).otherwise(F.floor(width / 2)).cast("int")
    )
    reach = F.floor(width * 0.05).cast("int")
    return F.coalesce(peak(F.greatest(rough - reach, F.lit(0)), F.least(rough + reach, width)), rough)


# --- model scoring ---------------------------------------------------------------------------------------------------


def score_batches(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a user's batch model over all partitions; it is loaded once per task.

    ``load`` returns a function from a batch to a frame with the schema's columns. A failing batch yields one row per input
    row with NULL results, the message in ``error`` and the row's ``keys``, which are columns of the input and of the schema.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            try:
                model = model or load()
                yield model(batch).assign(error=None)
            except Exception as problem:  # reported as data, the job goes on
                yield batch[list(keys)].assign(error=str(problem))

    names = [field.split()[0] for field in schema.split(",")]

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in score(batches):
            yield frame.reindex(columns=[*names, "error"])

    return df.mapInPandas(aligned, f"{schema}, error string")
