"""Grouped summaries. All of them combine on the map side, so the shuffle carries one row per key and task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.operators.numbering import spread_row_number


def groups_with_many(df: DataFrame, key: str) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def conditional_having(df: DataFrame, key: str, condition: Column) -> DataFrame:
    """Keys with at least one row satisfying the condition."""
    return df.filter(condition).select(key).distinct()


def distinct_owners(df: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys."""
    return df.select(key).dropna().distinct()


def dominance(df: DataFrame, contest: str, owner: str, member: str, flag: str) -> DataFrame:
    """1 for members that strictly win against everyone they ever meet, 0 for other participants.

    Two members of one owner meet in every contest that lists both. One wins when its flag is 1 and the other's 0; anything
    else is a tie. A member therefore wins a contest with company exactly when its own flag is 1 and all the others are 0, so
    at most one does, and it wins everything when it wins as often as it has company. What a contest says fits one row: who
    is alone in it or who wins it. Nothing is joined, and neither the pairs nor the members of a contest are ever gathered.
    """
    wins = F.col(flag) == 1
    field = df.filter(F.col(contest).isNotNull()).groupBy(contest, owner).agg(
        F.count(F.lit(1)).alias("_size"), F.count_if(F.col(flag) == 0).alias("_zeros"), F.count_if(wins).alias("_ones"),
        F.max(member).alias("_any"), F.max(F.when(wins, F.col(member))).alias("_one"),
    )
    alone = F.col("_size") == 1
    won = ~alone & (F.col("_ones") == 1) & (F.col("_zeros") == F.col("_size") - 1)
    told = field.filter(alone | won).select(F.when(alone, F.col("_any")).otherwise(F.col("_one")).alias(member), F.lit(0).alias("_first"), F.lit(0).alias("_rest"), alone.cast("int").alias("_alone"), won.cast("int").alias("_won"))
    # both kinds of flags are counted, so this side reads the same columns, and with them the same shuffle, as the other
    first = F.coalesce(wins, F.lit(False)).cast("int")
    listed = df.filter(F.col(contest).isNotNull()).select(member, first.alias("_first"), (1 - first).alias("_rest"), F.lit(0).alias("_alone"), F.lit(0).alias("_won"))
    counted = listed.unionByName(told).groupBy(member).agg(*[F.sum(c).alias(c) for c in ("_first", "_rest", "_alone", "_won")])
    company = F.col("_first") + F.col("_rest") - F.col("_alone")
    return counted.filter(company > 0).select(member, (F.col("_won") == company).cast("int").alias("is_primary"))


def mark_dominance(members: DataFrame, key: str, verdicts: DataFrame, verdict_key: str) -> DataFrame:
    """Members with their verdict; NULL for those that never met anyone."""
    return members.join(verdicts.withColumnRenamed(verdict_key, "_key"), F.col(key) == F.col("_key"), "left").drop("_key")


def _period_key(period: str, row_id: str) -> Column:
    return F.when(F.trim(F.coalesce(period, F.lit(""))) != "", F.lit(None)).otherwise(F.col(row_id))


def period_members(df: DataFrame, period: str, row_id: str) -> DataFrame:
    """Rows with the id of the group they form alone (NULL for rows that share a named period)."""
    return df.withColumn("single_id", _period_key(period, row_id))


def period_groups(df: DataFrame, scope: str, period: str, order: str, row_id: str, linked: Column) -> DataFrame:
    """Groups by (period, order) inside a scope, blank periods one by one: fully or partly linked, and how many members.

    Members stay in ``period_members`` and join on (scope, period, order, single_id).
    """
    blank = _period_key(period, row_id)
    named = F.when(blank.isNull(), F.col(period)).otherwise("").alias("period")
    grouped = df.groupBy(scope, named, F.when(blank.isNull(), F.col(order)).alias("period_order"), blank.alias("single_id"))
    flag = F.coalesce(linked, F.lit(False))
    counted = grouped.agg(F.count(F.lit(1)).alias("members"), F.bool_and(flag).alias("associated"), F.bool_or(flag).alias("_some"))
    return counted.withColumn("partly_associated", F.col("_some") & ~F.col("associated")).drop("_some")


def first_seen_ids(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Number the distinct values of each key 1, 2, ... by first appearance."""
    first = df.groupBy(key, value).agg(F.min(order).alias("first_at"))
    return spread_row_number(first, [key], [F.col("first_at"), F.col(value)], "value_id")


def last_non_null(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Per key, the latest value of each column that is not NULL."""
    latest = [F.max(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(c) for c in columns]
    return df.groupBy(key).agg(*latest)


def distinct_values_across(df: DataFrame, key: str, columns: list[str], out: str) -> DataFrame:
    """Distinct non-null values that a key holds in any of the columns, one row each."""
    return df.select(key, F.explode(F.array(*columns)).alias(out)).dropna(subset=[out]).distinct()


def ambiguity_count(df: DataFrame, name: str, leaf: Column) -> DataFrame:
    """Every row with the number of leaves that share its name."""
    leaves = df.groupBy(F.col(name).alias("_name")).agg(F.count_if(leaf).alias("leaf_count"))
    return df.join(leaves, F.col(name).eqNullSafe(F.col("_name"))).drop("_name")


def summary_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row of run statistics: all rows, and rows per condition."""
    return df.agg(F.count(F.lit(1)).alias("processed"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def bbox(cells: DataFrame, key: str, x: str, y: str, mask: Column, margin: int, width: int, height: int) -> DataFrame:
    """Box around the masked cells plus a margin, kept inside the frame; the whole frame when nothing is masked."""
    found = cells.groupBy(key).agg(
        F.min(F.when(mask, F.col(x))).alias("_x0"), F.max(F.when(mask, F.col(x))).alias("_x1"),
        F.min(F.when(mask, F.col(y))).alias("_y0"), F.max(F.when(mask, F.col(y))).alias("_y1"),
    )
    return found.select(
        key,
        F.coalesce(F.greatest(F.col("_x0") - margin, F.lit(0)), F.lit(0)).alias("x_from"),
        F.coalesce(F.least(F.col("_x1") + margin, F.lit(width)), F.lit(width)).alias("x_to"),
        F.coalesce(F.greatest(F.col("_y0") - margin, F.lit(0)), F.lit(0)).alias("y_from"),
        F.coalesce(F.least(F.col("_y1") + margin, F.lit(height)), F.lit(height)).alias("y_to"),
    )


def masked_mean(cells: DataFrame, key: str, columns: list[str], mask: Column, default: float) -> DataFrame:
    """Mean of each channel over the cells outside the mask; the default when all are masked."""
    means = [F.coalesce(F.avg(F.when(~mask, F.col(c))), F.lit(default)).alias(c) for c in columns]
    return cells.groupBy(key).agg(*means)


def dice_score(df: DataFrame, key: str, predicted: str, target: str, eps: float = 1e-7) -> DataFrame:
    """Overlap score per key and one minus their mean."""
    p, t = F.col(predicted), F.col(target)
    scored = df.groupBy(key).agg(((2 * F.sum(p * t) + eps) / (F.sum(p) + F.sum(t) + eps)).alias("dice"))
    loss = scored.agg((1 - F.avg("dice"))).scalar()
    return scored.withColumn("dice_loss", loss)


def bce_loss(df: DataFrame, logit: str, target: str, dice_weight: float = 0.0, batch: str | None = None) -> DataFrame:
    """Mean binary cross-entropy from logits, plus the weighted overlap loss per batch, averaged by batch size."""
    x, t = F.col(logit), F.col(target)
    cell = F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))
    p = 1 / (1 + F.exp(-x))
    per_batch = (df if batch else df.withColumn("_all", F.lit(0))).groupBy(batch or "_all").agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(cell).alias("_bce"),
        (1 - (2 * F.sum(p * t) + 1e-7) / (F.sum(p) + F.sum(t) + 1e-7)).alias("_dice"),
    )

    def weighted(c: Column) -> Column:
        return F.sum(c * F.col("_n")) / F.sum("_n")

    return per_batch.agg(weighted(F.col("_bce")).alias("bce"), weighted(F.col("_bce") + dice_weight * F.col("_dice")).alias("combined_loss"))


def string_rollup(df: DataFrame, key: str, value: str, row_id: str, separator: str = "; ", chunk: int = 1000) -> DataFrame:
    """Values of a key joined in order; long groups come in numbered pieces of ``chunk`` values so no string is unbounded."""
    placed = spread_row_number(df.select(key, value, row_id).dropna(subset=[value]), [key], [F.col(value), F.col(row_id)], "_pos")
    pieces = placed.groupBy(key, F.floor((F.col("_pos") - 1) / chunk).alias("chunk_no")).agg(
        F.sort_array(F.collect_list(F.struct("_pos", value))).alias("_list")
    )
    joined = F.array_join(F.transform("_list", lambda r: r[value].cast("string")), separator)
    return pieces.select(key, "chunk_no", joined.alias("joined"))
