"""Near copies: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, found by SimHash.

Of each distinct set a fingerprint of 128 bits is taken, a majority vote of its shingles' hashes. Two sets at a similarity of 0.8
differ in about 15 % of their bits, so in one of twelve pieces of 16 bits they differ by one bit at most, with a probability of
about 0.97 (over 0.99 at 0.9). Such a piece has a byte in which they are equal, so each byte of each piece deals the fingerprints into
up to 256 shards: every fingerprint goes to 24, however many there are. In a task vantage-point trees divide a shard into leaves that overlap by
one bit; words within ``DISTANCE`` bits are tried, each two by the piece that tells them apart least. Every link is verified on the whole
texts by the exact similarity.

Only fingerprints that have a near one in a shard go on, there, with the hashes of their shingles. The task tries every two that are near
and not yet of one class, the nearest first, and gives one link for each two classes that it joins. So a group of near copies costs its size, and no
candidate is left out; only in families of texts that mostly aren't near copies those tried are as many as their pairs, but they never leave the task.
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

from catalog_engine.llm.simhash import divide, near_classes
from catalog_engine.llm.texts import append, pieces
from catalog_engine.workspace import settled, staged

#: a similarity of at least ``LEAST[0] / LEAST[1]`` between sets of shingles of ``WORDS`` words makes a near copy
WORDS, LEAST = 5, (4, 5)
#: fingerprints with more differing bits are not tried: sets at 0.8 differ in 20 bits, give or take 4
DISTANCE = 30
PIECES = 12
#: shards of a piece: one for each value of each of its bytes
WIDTH = 512
#: hashes of shingles in a block of a shard; a task holds two blocks
BLOCK_BYTES = 1 << 26
#: classes that a fingerprint tries at first; twice as many in every further round
TRIES = 3
#: near words of other classes that a word tries in one slice of the last round
SLICE = 256


def shingle_hashes(text: bytes, size: int = WORDS) -> np.ndarray:
    """128-bit hashes of the distinct shingles, lower-cased in A-Z, one a row, by the first half; a shorter text is one."""
    words = text.lower().split()
    if not words:
        return np.zeros((0, 2), dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    count = max(1, len(words) - size + 1)
    starts = [0, *(ends[: count - 1] + 1).tolist()]
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(line[a:b]) for a, b in zip(starts, ends[min(size, len(words)) - 1 :].tolist())]), dtype=np.uint64).reshape(-1, 2)
    return both[np.unique(both[:, 0], return_index=True)[1]]


def signature(text: bytes) -> tuple[int, int, int]:
    """Hash of the set of shingles, and the two halves of its fingerprint."""
    hashes = shingle_hashes(text)
    total = np.zeros(128, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        total += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8)).reshape(-1, 128).sum(axis=0, dtype=np.int64)
    one, two = np.packbits(2 * total > len(hashes)).view(np.int64).tolist()
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes[:, 0].tobytes())).view(np.int64)), one, two


def signatures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep``, ``fp`` (hash of the shingle set) and the halves ``one`` and ``two`` of the fingerprint."""

    def kernel(texts: pa.Array):
        made = np.array([signature(t.encode() if t else b"") for t in texts.to_pylist()], dtype=np.int64).reshape(-1, 3)
        return [pa.array(made[:, k]) for k in range(3)]

    return append(docs, "text", keep, [T.StructField(c, T.LongType()) for c in ("fp", "one", "two")], kernel)


def piece(words: np.ndarray, which: int) -> np.ndarray:
    """A 16-bit piece of fingerprints, which are rows of two 64-bit words: eight lie side by side, of the others each takes
    one bit of every byte."""
    if which >= 8:
        picked = np.ascontiguousarray(words).view(np.uint8) >> np.uint8(which - 8) & np.uint8(1)
        return np.packbits(picked.reshape(len(words), 16), axis=1).view(np.uint16).reshape(-1).astype(np.uint32)
    return (words[:, which // 4] >> np.uint64(16 * (which % 4)) & np.uint64(0xFFFF)).astype(np.uint32)


def distances(words: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words[:, None, 0] ^ others[None, :, 0]) + np.bitwise_count(words[:, None, 1] ^ others[None, :, 1])


def met_here(words: np.ndarray, others: np.ndarray, which: int, byte: int = 0) -> np.ndarray:
    """Which pairs belong to this piece: the first of those that differ least. At one bit or none they meet there. In shards of
    its second byte (1) only pairs that don't meet by the first."""
    here = np.stack([np.bitwise_count(piece(words, k) ^ piece(others, k)) for k in range(PIECES)]).argmin(axis=0) == which
    return here & ((piece(words, which) ^ piece(others, which)) & 0xFF > 0) if byte else here


def leaves(words: np.ndarray, which: int, small: int = 256) -> Iterator[np.ndarray]:
    """A shard's positions in groups that hold every two whose piece differs by one bit at most."""
    own, waiting = piece(words, which), [np.arange(len(words))]
    while waiting:
        at = waiting.pop()
        cut = divide(own[at]) if len(at) > small else None
        if cut is not None:
            away = np.bitwise_count(own[at] ^ cut[0]).astype(np.int64)
            near, far = at[away <= cut[1]], at[away >= cut[1]]
            if max(len(near), len(far)) < 0.95 * len(at):
                waiting += [near, far]
                continue
        yield at


def first_near(words: np.ndarray, distance: int, tree: int, byte: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word that has a near one before it that leads, and the first such; and which words have a near one at all that
    they meet here (in large leaves: any near one)."""
    rest, ones, twos, company = np.arange(len(words)), [], [], np.zeros(len(words), dtype=bool)
    if len(words) <= 512:
        near = np.tril(distances(words, words) <= distance, -1)
        at = np.flatnonzero(near.any(axis=1))
        one, two = np.nonzero(near)
        met = met_here(words[one], words[two], tree, byte)
        company[one[met]] = company[two[met]] = True
        return near[at].argmax(axis=1), at, company
    while len(rest):
        here, rest = rest[0], rest[1:]
        near = distances(words[here : here + 1], words)[0] <= distance
        if near.sum() > 1:
            company |= near
        near = near[rest]
        twos.append(rest[near])
        ones.append(np.full(len(twos[-1]), here))
        rest = rest[~near]
    return np.concatenate(ones), np.concatenate(twos), company


def nearest_of_others(words: np.ndarray, labels: np.ndarray, tree: int, distance: int, tries: int = TRIES, byte: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Each word outside of the largest class with its nearest word in each of the ``tries`` nearest other classes, of those
    that are near and that it meets in this tree."""
    kinds, number, sizes = np.unique(labels, return_inverse=True, return_counts=True)
    asking = np.flatnonzero(number != sizes.argmax())
    ones, twos = [asking[:0]], [asking[:0]]
    for start in range(0, len(asking), 256):
        block = asking[start : start + 256]
        away = distances(words[block], words).astype(np.int16)
        one, two = np.nonzero(away <= distance)
        others = ~met_here(words[block[one]], words[two], tree, byte)
        away[one[others], two[others]] = 256
        rows, passed = np.arange(len(block)), number[block]
        for _ in range(min(tries, len(kinds) - 1)):
            away[passed[:, None] == number[None, :]] = 256
            best = away.argmin(axis=1)
            found = away[rows, best] <= distance
            if not found.any():
                break
            ones.append(block[found])
            twos.append(best[found])
            passed = number[best]
    return np.concatenate(ones), np.concatenate(twos)


def rest_of_others(words: np.ndarray, labels: np.ndarray, tree: int, distance: int, start: int, take: int = SLICE, byte: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Each word outside of the largest class with its near words of other classes that it meets in this tree: ``take`` of
    them, from the ``start``-th on."""
    _, number, sizes = np.unique(labels, return_inverse=True, return_counts=True)
    asking = np.flatnonzero(number != sizes.argmax())
    ones, twos = [asking[:0]], [asking[:0]]
    for at in range(0, len(asking), 256):
        block = asking[at : at + 256]
        one, two = np.nonzero((distances(words[block], words) <= distance) & (number[block][:, None] != number[None, :]))
        met = met_here(words[block[one]], words[two], tree, byte)
        one, two = one[met], two[met]
        rank = np.arange(len(one)) - np.searchsorted(one, one)
        wanted = (rank >= start) & (rank < start + take)
        ones.append(block[one[wanted]])
        twos.append(two[wanted])
    return np.concatenate(ones), np.concatenate(twos)


def dealt(sets: DataFrame, shard: int = 4_000, shard_rows: int = 200_000) -> tuple[DataFrame, int]:
    """(cell, low, high, fp, one, two) and the number of cells of a piece: every fingerprint once for each byte of each piece. Neighbouring
    values of a byte share a shard where they are few (``shard``); one of over ``shard_rows`` is dealt into blocks that meet pairwise,
    so no task holds more than two blocks."""
    step = -(-256 // min(256, max(1, sets.count() // shard)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([np.asarray(batch.column(c)) for c in ("one", "two")], axis=1).view(np.uint64)
            for which in range(PIECES):
                own = piece(words, which)
                for byte in (0, 1):
                    cells = (which * WIDTH + 256 * byte + (own >> 8 * byte & 0xFF) // step * step).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(cells), *[batch.column(c) for c in ("fp", "one", "two")]], names=["cell", "fp", "one", "two"])

    placed = sets.select("fp", "one", "two").mapInArrow(assign, "cell int, fp long, one long, two long")
    sizes = placed.groupBy("cell").count().select("cell", F.ceil(F.col("count") / shard_rows).cast("int").alias("n"))
    own = placed.join(F.broadcast(sizes), "cell").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    met = own.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    return met.select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp", "one", "two"), WIDTH


def _words(shard: pd.DataFrame) -> np.ndarray:
    return shard[["one", "two"]].to_numpy(dtype=np.int64).view(np.uint64)


def met(shards: DataFrame, width: int, distance: int = DISTANCE) -> DataFrame:
    """Rows with ``pair`` are pairs (one, two) of near sets, each with the first one; the others are the rows of ``shards`` that
    have a near one in their shard."""

    def find(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.drop_duplicates("fp").sort_values("fp")
        words, names = _words(shard), shard["fp"].to_numpy()
        tree, byte = int(key[0]) // width, int(key[0]) % width // 256
        found, company = [(names[:0], names[:0])], np.zeros(len(words), dtype=bool)
        for at in leaves(words, tree):
            one, two, near = first_near(words[at], distance, tree, byte)
            own = met_here(words[at[one]], words[at[two]], tree, byte)
            found.append((names[at[one[own]]], names[at[two[own]]]))
            company[at[near]] = True
        ends = np.unique(np.sort(np.stack([np.concatenate(side) for side in zip(*found)], axis=1), axis=1), axis=0)
        pairs = pd.DataFrame({"pair": True, "fp": 0, "one": ends[:, 0], "two": ends[:, 1]})
        out = pd.concat([pairs, shard.loc[company, ["fp", "one", "two"]].assign(pair=False)])
        return out.assign(cell=key[0], low=key[1], high=key[2])[["cell", "low", "high", "pair", "fp", "one", "two"]]

    return shards.groupBy("cell", "low", "high").applyInPandas(find, "cell int, low int, high int, pair boolean, fp long, one long, two long")


def pairs_of(first: DataFrame) -> DataFrame:
    return first.filter("pair").select(F.col("one").alias("a"), F.col("two").alias("b")).distinct()


def tried(shards: DataFrame, labels: DataFrame | None, width: int, tries: int = TRIES, distance: int = DISTANCE, start: int | None = None) -> DataFrame:
    """Pairs (a, b) of sets that are near, for a look at what they are or for verifying them elsewhere: each with the first one, or
    by the classes (fp, label) known so far with the nearest of a few other classes; with ``start`` all of different classes, in slices."""
    if labels is None:
        return pairs_of(met(shards, width, distance))

    def pairs(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.drop_duplicates("fp").sort_values("fp")
        words, names, marks = _words(shard), shard["fp"].to_numpy(), shard["label"].to_numpy()
        tree, byte = int(key[0]) // width, int(key[0]) % width // 256
        found = [(names[:0], names[:0])]
        for at in leaves(words, tree) if (marks != marks[0]).any() else ():
            if start is None:
                one, two = nearest_of_others(words[at], marks[at], tree, distance, tries, byte)
            else:
                one, two = rest_of_others(words[at], marks[at], tree, distance, start, byte=byte)
            found.append((names[at[one]], names[at[two]]))
        ends = np.sort(np.stack([np.concatenate(side) for side in zip(*found)], axis=1), axis=1)
        return pd.DataFrame(np.unique(ends, axis=0), columns=["a", "b"])

    known = shards.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    return known.groupBy("cell", "low", "high").applyInPandas(pairs, "a long, b long").distinct()


def sets_of(texts: DataFrame) -> DataFrame:
    """(fp, hashes): the sorted hashes of the distinct shingles, from (fp, text)."""

    def kernel(column: pa.Array):
        return [pa.array([shingle_hashes(t.encode())[:, 0].tobytes() for t in column.to_pylist()], pa.binary())]

    return append(texts, "text", ["fp"], [T.StructField("hashes", T.BinaryType())], kernel)


def similar_to(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the sets are near copies of ``one``; all are sorted and not empty."""
    sizes = np.array([len(o) for o in others])
    every = np.concatenate(others)
    held = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    common = np.add.reduceat(held, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
    return LEAST[1] * common >= LEAST[0] * (len(one) + sizes - common)


def shard_links(words: np.ndarray, sets: list[np.ndarray], tree: int, byte: int, distance: int = DISTANCE, take: int = SLICE) -> list[tuple[int, int]]:
    """Links that connect exactly the words of a shard connected by near copies, of those that are near and meet here."""
    label, links = np.arange(len(words)), []
    parts = np.stack([piece(words, k) for k in range(PIECES)])
    sizes = np.array([len(s) for s in sets])
    for at in leaves(words, tree):
        for start in range(0, len(at), 256):
            away = distances(words[at[start : start + 256]], words[at])
            for k, here in enumerate(at[start : start + 256]):
                near = np.flatnonzero(away[k, start + k + 1 :] <= distance) + start + k + 1
                near = near[np.argsort(away[k, near], kind="stable")]
                others = at[near]
                # sets of too different sizes cannot be as similar as asked for
                others = others[LEAST[1] * np.minimum(sizes[here], sizes[others]) >= LEAST[0] * np.maximum(sizes[here], sizes[others])]
                while len(others):
                    others = others[label[others] != label[here]]
                    some, others = others[:take], others[take:]
                    met = np.bitwise_count(parts[:, [here]] ^ parts[:, some]).argmin(axis=0) == tree
                    if byte:
                        met &= (parts[tree, here] ^ parts[tree, some]) & 0xFF > 0
                    some = some[met]
                    if not len(some):
                        continue
                    for other in some[similar_to(sets[here], [sets[o] for o in some])]:
                        if label[other] != label[here]:
                            links.append((int(here), int(other)))
                            label[label == label[other]] = label[here]
    return links


def near_links(sets: DataFrame, texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Verified links (a, b) between distinct sets (fp, one, two), whose texts are (fp, text)."""
    shards, width = dealt(sets)
    near = staged(met(shards, width).filter("NOT pair").select("cell", "fp", "one", "two").distinct(), "near")
    # the only shuffle of all texts: what has no near one is never read again
    known = staged(sets_of(texts.join(near.select("fp").distinct(), "fp", "left_semi").dropDuplicates(["fp"])), "known")
    placed = near.join(known, "fp")
    sizes = near.join(known.select("fp", F.octet_length("hashes").alias("n")), "fp").groupBy("cell").agg(F.ceil(F.sum("n") / block_bytes).cast("int").alias("n"))
    own = placed.join(F.broadcast(sizes), "cell").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    every = own.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    blocks = every.select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp", "one", "two", "hashes")

    def link(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("fp")
        names, held = shard["fp"].to_numpy(), [np.frombuffer(h, dtype=np.uint64) for h in shard["hashes"]]
        links = shard_links(_words(shard), held, int(key[0]) // width, int(key[0]) % width // 256)
        ends = np.array(links, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": names[ends[:, 0]], "b": names[ends[:, 1]]})

    return blocks.groupBy("cell", "low", "high").applyInPandas(link, "a long, b long").distinct()


def keep_first_near(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each class of near copies, that with the least key, with the columns of ``docs``.

    Near copies of near copies are in one class. Rows without key stay only if no row of their class has one. Of rows that
    repeat a key with the same shingles one stays. Null, empty and blank texts have no shingles and are one class. A long text
    is compared as a whole. An empty table gives an empty one, and columns of any other names are carried along.
    """
    spark = docs.sparkSession
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    marked = staged(signatures(whole, ["doc", "key"]), "marked")
    blank = signature(b"")[0]

    def links() -> DataFrame:
        sets = staged(marked.filter(F.col("fp") != blank).groupBy("fp").agg(F.min(F.struct("one", "two")).alias("bits")).select("fp", "bits.*"), "sets")
        return near_links(sets, marked.select("fp", F.col("doc").getField(text).alias("text")))

    known = settled(spark, "links", links)
    classes = settled(spark, "classes", lambda: near_classes(marked.select("key", "fp"), "key", links=known))
    winners = classes.filter("fp = first_word").select("fp", "component_id")
    kept = marked.join(winners, "fp").filter(F.col("key").eqNullSafe(F.col("component_id")))
    return kept.dropDuplicates(["fp"]).select("doc.*")
