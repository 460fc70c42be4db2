"""Exact top-k inner products by distributed histogram selection.

Nothing is approximated: all scores are computed in blocks, counted in histograms per query, and the bin that holds the k-th
score becomes the range of the next histogram until a bin is one score wide. The last pass keeps what reaches that score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalog_engine.workspace import staged


def whole_vectors(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(id, v, asks) with v = floor(scale * component) as longs; vectors that are null or hold null, NaN or infinity, or have
    no id, take no part. Components must stay below 2**31 after scaling."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(good, F.lit(False)))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return kept.select(F.col(key).cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))


def _packed(rows: DataFrame, most: int, group: str | None = None) -> DataFrame:
    """Rows (id, v, further longs) as matrices of up to ``most`` vectors of one length and group, without a shuffle."""
    longs = [c for c in rows.columns if c not in ("v", group)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            ends, values = np.asarray(lists.offsets), np.asarray(lists.values)
            size = np.diff(ends)
            member = np.asarray(batch.column(group)) if group else np.zeros(len(size), dtype=np.int64)
            for dim, own in np.unique(np.stack([size, member], axis=1), axis=0):
                at = np.flatnonzero((size == dim) & (member == own))
                for start in range(0, len(at), most):
                    part = at[start : start + most]
                    matrix = values[(ends[part][:, None] + np.arange(dim)).ravel()].astype(np.int64)
                    cells = [pa.array([own], pa.int64()), pa.array([dim], pa.int32()), pa.array([len(part)], pa.int32()), pa.array([matrix.tobytes()], pa.binary())]
                    cells += [pa.array([np.asarray(batch.column(c))[part].astype(np.int64).tobytes()], pa.binary()) for c in longs]
                    yield pa.RecordBatch.from_arrays(cells, names=["block", "dim", "rows", "m", *longs])

    return rows.mapInArrow(pack, "block long, dim int, rows int, m binary, " + ", ".join(f"{c} binary" for c in longs))


def _scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point while they fit into 53 bits, else in whole numbers."""
    bound = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(left.shape[1], 1)
    if bound < 2.0**53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


def _scan(state: DataFrame, blocks: DataFrame, work: Callable, schema: str, query_rows: int, spread: int) -> DataFrame:
    """``work`` on every query block against every candidate block of the same length.

    Query blocks are copied to ``spread`` parts and candidate blocks to every query block, so that each meeting has a key.
    """
    count = max(1, -(-state.count() // query_rows))
    grouped = state.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count))).repartition(count, "block")
    queries = _packed(grouped, query_rows, "block")
    queries = queries.select("block", "dim", *[F.col(c).alias(f"q_{c}") for c in queries.columns if c not in ("block", "dim")])
    parts = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    copies = blocks.drop("block").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(spread)).cast("int"))
    copies = copies.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    met = copies.join(parts, ["block", "part", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                longs = {c: np.frombuffer(row[c], dtype=np.int64) for c in row if isinstance(row[c], bytes) and c not in ("m", "q_m")}
                left = np.frombuffer(row["q_m"], dtype=np.int64).reshape(row["q_rows"], row["dim"])
                right = np.frombuffer(row["m"], dtype=np.int64).reshape(row["rows"], row["dim"])
                yield from work(_scores(left, right), longs)

    return met.mapInArrow(run, schema)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, bins: int = 2048, query_rows: int = 256, block_rows: int = 4096, spread: int = 16) -> DataFrame:
    """The ``k`` highest inner products of every query row with all other rows: query_id, rank, vec_id, score.

    Ties go to the smaller id; fewer than ``k`` others give all of them. Rows that carry the query's own id are left out.
    Vectors of another length than the query's do not meet it.
    """
    clean = staged(whole_vectors(vectors, is_query, key, vector, scale), "vectors")
    asks = clean.filter("asks").dropDuplicates(["id"])
    blocks = staged(_packed(clean.select("id", "v"), block_rows), "blocks")
    norm = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    bound = int(clean.agg(F.max(norm)).first()[0] or 0) + 1
    rounds = 1
    while bins**rounds < 2 * bound + 1:
        rounds += 1
    state = staged(asks.select("id", "v", F.lit(-bound).cast("long").alias("low"), F.lit(k).cast("long").alias("need")), "asked")

    for turn in reversed(range(rounds)):
        width = bins**turn

        def count(scores: np.ndarray, longs: dict, width: int = width) -> Iterator[pa.RecordBatch]:
            place = (scores - longs["q_low"][:, None]) // width
            inside = (place >= 0) & (place < bins) & (longs["q_id"][:, None] != longs["id"][None, :])
            held = np.bincount((np.arange(len(scores))[:, None] * bins + place)[inside], minlength=len(scores) * bins)
            seen = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(longs["q_id"][seen // bins]), pa.array(seen % bins), pa.array(held[seen])], names=["id", "bin", "n"])

        counted = _scan(state, blocks, count, "id long, bin long, n long", query_rows, spread).groupBy("id", "bin").agg(F.sum("n").alias("n"))
        # at most ``bins`` rows per query
        above = F.coalesce(F.sum("n").over(Window.partitionBy("id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counted.withColumn("above", above).join(state.select("id", "need"), "id").filter("above < need AND above + n >= need")
        found = found.select("id", (F.col("bin") * width).alias("up"), (F.col("need") - F.col("above")).alias("left"))
        # a query with too few others has no such bin: its range stays at the low end, where everything is kept
        state = staged(state.join(found, "id", "left").select("id", "v", (F.col("low") + F.coalesce("up", F.lit(0))).alias("low"), F.coalesce("left", "need").alias("need")), "asked")

    def select(scores: np.ndarray, longs: dict) -> Iterator[pa.RecordBatch]:
        order = np.argsort(longs["id"], kind="stable")
        ids, scores = longs["id"][order], scores[:, order]
        other = longs["q_id"][:, None] != ids[None, :]
        least = longs["q_low"][:, None]
        equal = other & (scores == least)
        keep = (other & (scores > least)) | (equal & (np.cumsum(equal, axis=1) <= k))
        row, column = np.nonzero(keep)
        yield pa.RecordBatch.from_arrays([pa.array(longs["q_id"][row]), pa.array(ids[column]), pa.array(scores[row, column])], names=["query_id", "vec_id", "score"])

    found = _scan(state, blocks, select, "query_id long, vec_id long, score long", query_rows, spread)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
