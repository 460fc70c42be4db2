"""Near duplicates by SimHash: 64-bit fingerprints joined within a Hamming distance through vantage-point trees.

Two fingerprints that differ in at most three bits differ in at most one bit of their upper or of their lower half. For each
half a tree over a bounded sample divides the space: a node keeps a half word (the vantage point) and a radius, and sends
what lies within the radius left and the rest right. Of a pair within one bit, either both go the same way, or the one on the
left lies within one bit of the boundary; only such words go both ways. Every leaf is a shard that is divided further in the
same manner until a piece is small enough for comparing all pairs, so no link is lost and none is assumed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_engine.llm.texts import append, sampled
from catalog_engine.operators.similar import similar_components
from catalog_engine.workspace import staged

DISTANCE, WORDS = 3, 3


def fingerprint(text: bytes, size: int = WORDS) -> int:
    """SimHash over the XXH64 of all ``size``-word shingles, lower-cased in A-Z; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = [0, *(ends[: len(words) - size] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())]
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype=">u8")
        total += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, name: str = "fp", size: int = WORDS) -> DataFrame:
    """Columns ``keep`` and the fingerprint as a signed long; a null text has that of the empty text."""

    def kernel(texts: pa.Array):
        values = [fingerprint(t.encode() if t else b"", size) for t in texts.to_pylist()]
        return [pa.array(np.array(values, dtype=np.uint64).view(np.int64))]

    return append(docs, text, keep or ["doc_id"], [T.StructField(name, T.LongType())], kernel)


def half(words: np.ndarray, which: int) -> np.ndarray:
    return (words >> np.uint64(32 * which)).astype(np.uint32)


def divide(points: np.ndarray, tries: int = 4) -> tuple[np.uint32, int] | None:
    """Vantage point and radius that leave about half of the points on each side; None if nothing separates them."""
    best = None
    for pivot in points[np.linspace(0, len(points) - 1, tries).astype(np.int64)]:
        away = np.bitwise_count(points ^ pivot).astype(np.int64)
        held = np.cumsum(np.bincount(away, minlength=33))
        radius = int(np.abs(held[:-1] - len(points) / 2).argmin())
        worse = max(held[radius], len(points) - (held[radius - 1] if radius else 0))
        if 0 < held[radius] < len(points) and (best is None or worse < best[0]):
            best = (worse, pivot, radius)
    return None if best is None else best[1:]


def plant(sample: np.ndarray, leaf: int) -> list[tuple]:
    """The tree of a sample of half words as nodes (pivot, radius, left, right); leaves are (None, shard)."""
    nodes: list = []
    shards = 0

    def grow(points: np.ndarray) -> int:
        nonlocal shards
        place = len(nodes)
        nodes.append(None)
        cut = divide(points) if len(points) > leaf else None
        if cut is None:
            nodes[place] = (None, shards)
            shards += 1
        else:
            near = np.bitwise_count(points ^ cut[0]) <= cut[1]
            nodes[place] = (*cut, grow(points[near]), grow(points[~near]))
        return place

    grow(sample)
    return nodes


def shards_of(words: np.ndarray, nodes: list[tuple], reach: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """The positions of ``words`` (halves) in each shard they belong to or reach over the boundary of."""
    waiting = [(0, np.arange(len(words)))]
    while waiting:
        node, at = waiting.pop()
        if not len(at):
            continue
        if nodes[node][0] is None:
            yield nodes[node][1], at
            continue
        pivot, radius, left, right = nodes[node]
        away = np.bitwise_count(words[at] ^ pivot).astype(np.int64)
        waiting += [(left, at[away <= radius]), (right, at[away > radius - reach])]


def compare_all(words: np.ndarray, distance: int = DISTANCE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect exactly the words connected within ``distance``: all of them, or a spanning tree where they are dense."""
    if len(words) <= 512:
        one, two = np.nonzero(np.triu(np.bitwise_count(words[:, None] ^ words[None, :]) <= distance, 1))
        if len(one) <= 8 * len(words):
            return [(one, two)]
    rest, links = np.arange(len(words)), []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            here = front.pop()
            near = np.bitwise_count(words[rest] ^ words[here]) <= distance
            if near.any():
                found = rest[near]
                links.append((np.full(len(found), here), found))
                front.extend(found)
                rest = rest[~near]
    return links


def forest(words: np.ndarray, which: int, small: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Each word of a shard that has a link, and the least word of its local component."""
    links, waiting = [], [np.arange(len(words))]
    halves = half(words, which)
    while waiting:
        at = waiting.pop()
        cut = divide(halves[at]) if len(at) > small else None
        if cut is not None:
            away = np.bitwise_count(halves[at] ^ cut[0]).astype(np.int64)
            near, far = at[away <= cut[1]], at[away >= cut[1]]
            if max(len(near), len(far)) < 0.95 * len(at):
                waiting += [near, far]
                continue
        links += [(at[a], at[b]) for a, b in compare_all(words[at])]
    label = np.arange(len(words))
    if links:
        one, two = np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links])
        while True:
            before = label.copy()
            least = np.minimum(label[one], label[two])
            np.minimum.at(label, label[one], least)
            np.minimum.at(label, label[two], least)
            np.minimum.at(label, one, least)
            np.minimum.at(label, two, least)
            label = label[label]
            if (label == before).all():
                break
    linked = np.flatnonzero(label != np.arange(len(words)))
    return words[linked], words[label[linked]]


def linked_words(words: DataFrame, name: str = "fp", sample: int = 1 << 15, leaf: int = 24, shard_rows: int = 500_000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly those linked within the distance.

    The trees are planted from a sample of at most ``sample`` words (a sixteenth of a small table). A shard with more than
    ``shard_rows`` words is split into blocks that meet pairwise, so no task holds more than two blocks.
    """
    count = words.count()
    drawn = np.array(sorted(r[0] for r in sampled(words.select(name), name, min(1 / 16, sample / max(count, 1))).collect()), dtype=np.int64).view(np.uint64)
    trees = [plant(half(drawn, which), leaf) for which in (0, 1)]
    width = max(sum(n[0] is None for n in t) for t in trees)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(0))
            for which, tree in enumerate(trees):
                parts = list(shards_of(half(values.view(np.uint64), which), tree))
                if parts:
                    cells = np.concatenate([np.full(len(at), which * width + shard, dtype=np.int64) for shard, at in parts])
                    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(values[np.concatenate([at for _, at in parts])])], names=["cell", "word"])

    dealt = staged(words.select(name).mapInArrow(assign, "cell long, word long"), "shards")
    # at most one row per leaf, and the sample bounds the leaves
    large = {r["cell"]: -(-r["count"] // shard_rows) for r in dealt.groupBy("cell").count().filter(F.col("count") > shard_rows).collect()}
    blocks = F.lit(1)
    if large:
        sizes = F.create_map(*[F.lit(x) for pair in large.items() for x in pair])
        blocks = F.coalesce(F.try_element_at(sizes, F.col("cell")), F.lit(1))
    own = dealt.withColumn("n", blocks).withColumn("own", F.pmod(F.xxhash64("word"), F.col("n")))
    met = own.select("cell", "word", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    met = met.select("cell", "word", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def connect(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        found = forest(np.unique(shard["word"].to_numpy().view(np.uint64)), int(key[0] >= width))
        return pd.DataFrame({"a": found[0].view(np.int64), "b": found[1].view(np.int64)})

    edges = met.groupBy("cell", "low", "high").applyInPandas(connect, "a long, b long")
    return edges.distinct()


def near_classes(marked: DataFrame, key: str = "doc_id", name: str = "fp", links: DataFrame | None = None) -> DataFrame:
    """One row per distinct fingerprint: its class (``root``, one of the fingerprints), the least key of the class
    (``component_id``; null if no row of the class has a key) and the fingerprint that this key has (``first_word``).
    ``links`` (a, b) replace those of fingerprints within the distance."""
    words = staged(marked.groupBy(F.col(name).alias("fp")).agg(F.min(F.struct(F.col(key).isNull().alias("missing"), F.col(key).alias("id"))).alias("least")), "words")
    roots = similar_components(linked_words(words) if links is None else links, "a", "b")
    classes = words.join(roots, F.col("fp") == F.col("id"), "left").select("fp", F.coalesce("component", "fp").alias("root"), "least")
    first = classes.groupBy("root").agg(F.min(F.struct("least", "fp")).alias("first"))
    return classes.join(first, "root").select("fp", "root", F.col("first.least.id").alias("component_id"), F.col("first.fp").alias("first_word"))


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each class of near duplicates, that with the least key, with the columns of ``docs``.

    Rows without key stay only if no row of their class has one. Of rows that repeat a key with the same fingerprint one stays.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(key).alias("key"), F.col(text).alias("text"))
    marked = staged(fingerprints(whole, "text", ["doc", "key"]), "marked")
    classes = near_classes(marked.select("key", "fp"), "key")
    winners = classes.filter("fp = first_word").select("fp", "component_id")
    kept = marked.join(winners, "fp").filter(F.col("key").eqNullSafe(F.col("component_id")))
    return kept.dropDuplicates(["fp"]).select("doc.*")
