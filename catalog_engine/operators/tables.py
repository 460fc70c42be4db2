"""Table maintenance. Every operator returns the new state of the table; ``publish`` in the sinks module writes it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.operators.numbering import global_row_number


def _on(keys: list[str], left: str = "t", right: str = "s") -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}") == F.col(f"{right}.{k}") for k in keys])


def last_per_key(source: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One source row per key, the one with the highest ``order``; without an order the greatest by its values."""
    rest = [c for c in source.columns if c not in keys and c != order]
    if not rest:
        return source.select(*keys).distinct()
    if order is None:
        last = source.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_last"))
        return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
    last = source.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in (order, *rest)])


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str], order: str | None = None, keep_newer: bool = False) -> DataFrame:
    """Insert new keys; for known ones overwrite the listed columns. Of several source rows for a key the last one counts.

    With ``keep_newer`` a stored row stays when its ``order`` is above that of the source row, so late news change nothing.
    """
    if keep_newer and order not in target.columns:
        raise ValueError("the table must store the order column to keep newer rows")
    latest = last_per_key(source, keys, order).withColumn("_in", F.lit(True))
    joined = target.withColumn("_had", F.lit(True)).alias("t").join(latest.alias("s"), _on(keys), "full_outer")
    taken = F.col("_in")
    if keep_newer:
        taken = taken & F.coalesce(F.col(f"s.{order}") >= F.col(f"t.{order}"), F.col(f"t.{order}").isNull())

    def column(name: str) -> Column:
        if name in keys:
            return F.coalesce(f"t.{name}", f"s.{name}").alias(name)
        if name not in latest.columns:
            return F.col(f"t.{name}").alias(name)
        from_source = taken if name in update else F.col("_had").isNull()
        return F.when(from_source, F.col(f"s.{name}")).otherwise(F.col(f"t.{name}")).alias(name)

    return joined.select(*[column(c) for c in target.columns])


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Add rows with new keys only."""
    fresh = last_per_key(source, keys, None).select(*source.columns).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True).select(*target.columns)


def replace_rows(target: DataFrame, source: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Source rows replace whole target rows; columns the source lacks become NULL."""
    latest = last_per_key(source, keys, order)
    kept = target.join(latest.select(*keys), keys, "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True).select(*target.columns)


def get_or_create_ids(dim: DataFrame, key: str, columns: list[str], values: DataFrame) -> DataFrame:
    """Ids for all distinct values: the known ones, and for new ones the next numbers in value order."""
    wanted = values.select(*columns).dropna().distinct()
    known = wanted.join(dim.select(key, *columns), columns)
    fresh = global_row_number(wanted.join(dim.select(*columns), columns, "left_anti"), [F.col(c) for c in columns], "_n")
    highest = dim.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint")).scalar()
    return known.select(F.col(key).cast("bigint").alias(key), *columns).unionByName(fresh.select((highest + F.col("_n")).alias(key), *columns))


def bridge_rows(df: DataFrame, entity: str, values: Column, dim: DataFrame, dim_value: str, dim_id: str, side: Column | None = None) -> DataFrame:
    """(entity, dimension id[, side]) pairs from a list column, each once."""
    extra = [side.alias("side")] if side is not None else []
    listed = df.select(entity, *extra, F.explode(values).alias("_value")).distinct()
    return listed.join(dim.select(F.col(dim_value).alias("_value"), dim_id), "_value").drop("_value").distinct()


def replace_children(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Children of every key in the source are exchanged for those of the source."""
    touched = source.select(key).distinct()
    return target.join(touched, key, "left_anti").select(*target.columns).unionByName(source, allowMissingColumns=True)


def coalesce_update(target: DataFrame, source: DataFrame, key: str, keep: list[str], overwrite: list[str] = (), order: str | None = None) -> DataFrame:
    """For keys in the source: ``keep`` columns change only to a present value, ``overwrite`` columns always.

    Empty text is not present. Of several source rows for a key the last present value counts, by ``order`` or else the
    greatest, so the number of target rows never changes.
    """
    text = {f.name for f in source.schema if f.dataType.typeName() == "string"}
    place = [F.col(order).alias("_place")] if order else []

    def last(name: str) -> Column:
        value = F.nullif(name, F.lit("")) if name in text and name in keep else F.col(name)
        seen = F.struct(*place, value.alias("_value"))
        return F.max(F.when(value.isNotNull(), seen) if name in keep else seen)["_value"].alias(name)

    latest = source.groupBy(key).agg(F.lit(True).alias("_in"), *[last(c) for c in [*keep, *overwrite]])
    joined = target.alias("t").join(latest.alias("s"), _on([key]), "left")

    def column(name: str) -> Column:
        if name in keep:
            return F.coalesce(f"s.{name}", f"t.{name}").alias(name)
        if name in overwrite:
            return F.when(F.col("_in"), F.col(f"s.{name}")).otherwise(F.col(f"t.{name}")).alias(name)
        return F.col(f"t.{name}")

    return joined.select(*[column(c) for c in target.columns])


def append_info(target: DataFrame, source: DataFrame, key: str, column: str, separator: str = "; ") -> DataFrame:
    """Append the notes of a key, in order of their text, unless the list already holds them; running twice changes nothing."""
    notes = source.groupBy(key).agg(F.array_sort(F.collect_set(F.nullif(column, F.lit("")))).alias("_notes"))
    joined = target.alias("t").join(notes.alias("s"), _on([key]), "left")
    current = F.nullif(f"t.{column}", F.lit(""))
    fresh = F.array_except("_notes", F.coalesce(F.split(current, separator), F.array().cast("array<string>")))
    merged = F.when(F.size(fresh) > 0, F.concat_ws(separator, current, F.array_join(fresh, separator))).otherwise(F.col(f"t.{column}")).alias(column)
    return joined.select(*[merged if c == column else F.col(f"t.{c}") for c in target.columns])


def soft_delete(target: DataFrame, doomed: DataFrame, key: str, name: str, faces: tuple[str, str], removed: str) -> DataFrame:
    """Set ``removed`` where either face of the key is one of the given names."""
    marks = doomed.select(F.col(key).alias("_key"), F.col(name).alias("_name")).distinct()
    marked = target
    for number, face in enumerate(faces):
        side = marks.select(F.col("_key").alias(f"_k{number}"), F.col("_name").alias(f"_n{number}"))
        marked = marked.join(side, (F.col(key) == F.col(f"_k{number}")) & (F.col(face) == F.col(f"_n{number}")), "left")
    hit = F.col("_n0").isNotNull() | F.col("_n1").isNotNull()
    return marked.select(*[F.when(hit, F.lit(1)).otherwise(F.col(c)).alias(c) if c == removed else F.col(c) for c in target.columns])


def apply_changes(target: DataFrame, changes: DataFrame, key: str, entity: str, flags: list[str]) -> DataFrame:
    """Apply a change log (key, seq, kind, number, text_a, text_b) to samples in one pass.

    Kinds: ``delete``; ``set_type`` (number); ``promote`` (becomes type 1, the old references of its entity type 2);
    ``transfer`` (number is the new entity, type 2); ``rename`` (new face names); ``swap`` (faces change places); and every
    name in ``flags`` (number is the new value). The latest change of each aspect wins; swaps count after the last rename.
    """
    renamed = changes.filter("kind = 'rename'").groupBy(key).agg(F.max("seq").alias("_renamed_at"))
    log = changes.join(renamed, key, "left")

    def latest(kinds: list[str], value: Column) -> Column:
        return F.max(F.when(F.col("kind").isin(kinds), F.struct("seq", value.alias("v"))))["v"]

    kind, type_kinds = F.col("kind"), ["set_type", "promote", "transfer"]
    typed = F.when(kind == "promote", 1).when(kind == "transfer", 2).otherwise(F.col("number").cast("int"))
    swap = (kind == "swap") & (F.col("seq") > F.coalesce("_renamed_at", F.lit(-1)))
    summary = log.groupBy(key).agg(
        F.bool_or(kind == "delete").alias("_delete"),
        latest(type_kinds, typed).alias("_type"),
        latest(["transfer"], F.col("number")).alias("_entity"),
        latest(["rename"], F.col("text_a")).alias("_a"), latest(["rename"], F.col("text_b")).alias("_b"),
        (F.count_if(swap) % 2 == 1).alias("_swap"),
        *[latest([f], F.col("number").cast("int")).alias(f"_flag_{f}") for f in flags],
    )
    joined = target.join(summary, key, "left")
    # asked of the changes of a type alone, so the whole summary is not made a second time
    last = changes.filter(F.col("kind").isin(type_kinds)).groupBy(key).agg(F.max(F.struct("seq", "kind"))["kind"].alias("_type_kind")).filter("_type_kind = 'promote'")
    promoted = target.select(key, entity).join(last.select(key), key).select(F.col(entity).alias("_promoted")).distinct()
    joined = joined.join(promoted, F.col(entity) == F.col("_promoted"), "left")
    a, b = F.coalesce("_a", "face_a"), F.coalesce("_b", "face_b")
    demoted = F.col("_promoted").isNotNull() & (F.col("sample_type") == 1) & F.col("_type").isNull()
    new = {
        entity: F.coalesce("_entity", entity),
        "sample_type": F.when(demoted, 2).otherwise(F.coalesce("_type", "sample_type")),
        "removed": F.when(F.col("_delete"), 1).otherwise(F.col("removed")),
        "face_a": F.when(F.col("_swap"), b).otherwise(a),
        "face_b": F.when(F.col("_swap"), a).otherwise(b),
        **{f: F.coalesce(f"_flag_{f}", f) for f in flags},
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in target.columns])


def assign_owner(items: DataFrame, assignments: DataFrame, keys: list[str], owner: str = "owner_id", manual: str = "is_manual", order: str | None = None) -> DataFrame:
    """Set (or, with NULL, clear) the owner by hand, for single rows or for a whole group addressed by several keys.

    Of several assignments for the same keys the last by ``order`` counts, else the one with the greatest owner.
    """
    latest = last_per_key(assignments.select(*keys, F.col(owner).alias("_owner"), *([order] if order else [])), keys, order)
    joined = items.alias("t").join(latest.withColumn("_in", F.lit(True)).alias("s"), _on(keys), "left")
    new = {owner: F.when(F.col("_in"), F.col("_owner")).otherwise(F.col(f"t.{owner}")), manual: F.when(F.col("_in"), 1).otherwise(F.col(f"t.{manual}"))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(f"t.{c}") for c in items.columns])


def cascade_delete(parents: DataFrame, children: DataFrame, key: str, child_key: str, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the doomed parents and their children."""
    gone = doomed.select(F.col(key).alias("_gone")).distinct()
    return parents.join(gone, F.col(key) == F.col("_gone"), "left_anti"), children.join(gone, F.col(child_key) == F.col("_gone"), "left_anti")


def bulk_update(target: DataFrame, updates: DataFrame, key: str, columns: list[str], fixed: str, order: str | None = None) -> DataFrame:
    """Overwrite columns for many keys and mark as fixed the rows in which anything really changed.

    Of several updates for a key the last by ``order`` counts, else the greatest by its values.
    """
    latest = last_per_key(updates.select(key, *columns, *([order] if order else [])), [key], order)
    joined = target.alias("t").join(latest.withColumn("_in", F.lit(True)).alias("s"), _on([key]), "left")
    text = lambda side, c: F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit(""))
    changed = F.col("_in") & reduce(lambda a, b: a | b, [text("t", c) != text("s", c) for c in columns])

    def column(name: str) -> Column:
        if name in columns:
            return F.when(F.col("_in"), F.col(f"s.{name}")).otherwise(F.col(f"t.{name}")).alias(name)
        if name == fixed:
            return F.when(changed, F.lit(1)).otherwise(F.col(f"t.{fixed}")).alias(fixed)
        return F.col(f"t.{name}")

    return joined.select(*[column(c) for c in target.columns])
