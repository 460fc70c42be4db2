"""Exact removal of repeated byte strings with suffixes sorted in buckets.

A string of ``size`` bytes is a window. Among the 8-byte grams in the middle of a window the one of least hash is its anchor,
so equal windows have equal anchors at equal places, and neighbouring windows share theirs. All windows of an anchor form a
run; the bytes around the anchor that every window of the run holds are its core. Only runs whose core occurs more than once
can hold repeated windows, and only their suffixes, which begin at the core, have to be sorted:

1. every task finds the runs of its texts, and settles those that repeat within it;
2. cores and runs are counted over the whole table; a core with one kind of run is settled by that count;
3. of the others one text per kind is read; its suffix and the bytes before the core go to a bucket by their leading bytes,
   between splitters that Spark samples; equal leading bytes never straddle a boundary, so nothing has to be compared over it;
4. a bucket sorts its suffixes by multikey quicksort and gets common lengths from neighbours, to the right and, with the
   bytes before the core reversed, to the left; a window repeats if both lengths together cover it.

Strings of words are found in the same manner in texts whose words have become hashes of eight bytes.

A core with very many kinds of runs would make one bucket too large: there every window is counted by a 128-bit hash instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_engine.llm.texts import flat, pieces
from catalog_engine.workspace import settled, staged

SIZE, GRAM, WORD_BYTES = 400, 8, 8
SPANS = "array<struct<start: int, end: int>>"
PLACE = np.uint64((1 << 30) - 1)


def edge_of(size: int) -> int:
    """Bytes of the core on each side of the anchor; anchors keep that far from both ends of a window."""
    return max(GRAM, size // 8)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value in every window of ``width`` neighbours, from least values of blocks in both directions."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def runs_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window, last window and anchor of every run, as places in ``data``."""
    edge = edge_of(size)
    none = np.zeros(0, dtype=np.int64)
    if len(data) < size:
        return none, none, none, none
    grams = data[: len(data) - GRAM + 1].astype(np.uint64)
    for k in range(1, GRAM):
        grams = (grams << np.uint64(8)) | data[k : len(data) - GRAM + 1 + k]
    grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    marks = (((grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    # anchor places from ``edge`` to ``size - edge`` inside the window
    least = sliding_least(marks[edge:], size - 2 * edge + 1)
    anchors = (least & PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - size + 1, 0))
    windows = np.concatenate([np.arange(a, b - size + 1) for a, b in zip(offsets, offsets[1:]) if b - a >= size] or [none])
    if not len(windows):
        return none, none, none, none
    anchor = anchors[windows]
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(windows)) - 1
    return row[first], windows[first], windows[last], anchor[first]


def signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


RUN = "k1 long, k2 int, first int, windows int, before int, core long, kind long, times int"


def find_runs(docs: DataFrame, size: int) -> DataFrame:
    """Runs of all texts; ``times`` tells how often its task met this kind in one piece, in the row of its first occurrence.

    Later occurrences in the piece are settled already: they have ``core`` null and stand only for the bytes they cover.
    """
    edge = edge_of(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for piece in pieces(batch, "text", most_rows=4096):
                data, offsets = flat(piece.column("text"))
                row, first, last, anchor = runs_of(data, offsets, size)
                if not len(row):
                    continue
                body = data.tobytes()
                core = signed([digest(body[a - edge : a + edge]) for a in anchor.tolist()])
                kind = signed([digest(body[a : b + size]) for a, b in zip(first.tolist(), last.tolist())])
                _, place, back, times = np.unique(np.stack([core, kind], axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
                lead = np.zeros(len(row), dtype=bool)
                lead[place] = True
                k1, k2 = np.asarray(piece.column("k1"))[row], np.asarray(piece.column("k2"))[row]
                made = [k1, k2, (first - offsets[row]).astype(np.int32), (last - first + 1).astype(np.int32), (anchor - first).astype(np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, made), pa.array(core, mask=~lead), pa.array(kind, mask=~lead), pa.array(times[back.ravel()].astype(np.int32))],
                    names=["k1", "k2", "first", "windows", "before", "core", "kind", "times"],
                )

    return docs.mapInArrow(run, RUN)


def multikey(words: np.ndarray) -> np.ndarray:
    """Order of rows of big-endian words: three-way quicksort on one word at a time, going on to the next where it is equal."""
    order, waiting = np.arange(len(words)), [(0, len(words), 0)]
    while waiting:
        start, end, depth = waiting.pop()
        if end - start < 2 or depth == words.shape[1]:
            continue
        part = order[start:end]
        token = words[part, depth]
        pivot = np.sort(token[:: max(1, len(token) // 9)])[len(token[:: max(1, len(token) // 9)]) // 2]
        below, equal, above = part[token < pivot], part[token == pivot], part[token > pivot]
        order[start:end] = np.concatenate([below, equal, above])
        one, two = start + len(below), start + len(below) + len(equal)
        waiting += [(start, one, depth), (one, two, depth + 1), (two, end, depth)]
    return order


def ordered(strings: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the strings and the common length of each with the one before it."""
    width = -(-most // 8) * 8
    table = np.frombuffer(b"".join(s[:most].ljust(width, b"\0") for s in strings), dtype=np.uint8).reshape(len(strings), width)
    order = multikey(table.view(">u8").astype(np.uint64))
    sizes = np.array([min(len(s), most) for s in strings])[order]
    same = table[order[1:]] == table[order[:-1]]
    common = np.where(same.all(axis=1), width, same.argmin(axis=1))
    return order, np.concatenate([[0], np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))])


def classes(order: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """A number per string, equal for those that share their first ``length`` bytes."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(common < length)
    return out


def repeated_windows(contents: list[bytes], before: np.ndarray, windows: np.ndarray, times: np.ndarray, size: int) -> list[list[tuple[int, int]]]:
    """For each run of one core, the ranges [from, to] of distances between window start and anchor at which its window
    occurs elsewhere."""
    edge, count = edge_of(size), len(contents)
    low, high = before - windows + 1, before
    lefts = [c[: b - edge][::-1] for c, b in zip(contents, before.tolist())]
    rights = [c[b - edge :] for c, b in zip(contents, before.tolist())]
    right, left = ordered(rights, size), ordered(lefts, size)
    held = np.zeros((count, size + 1), dtype=bool)
    # between these distances neither the members nor the classes change
    turns = np.unique(np.concatenate([low, high + 1, size + edge - right[1][1:], left[1][1:] + edge + 1]))
    turns = turns[(turns >= low.min()) & (turns <= high.max() + 1)]
    for away, until in zip(turns.tolist(), turns[1:].tolist()):
        own = np.flatnonzero((low <= away) & (away <= high))
        if len(own) > 1:
            both = classes(*right, size - away + edge)[own] * (count + 1) + classes(*left, away - edge)[own]
            _, back, met = np.unique(both, return_inverse=True, return_counts=True)
            held[own, away:until] = (met[back] > 1)[:, None]
    out = []
    for k in range(count):
        if times[k] > 1:
            out.append([(int(low[k]), int(high[k]))])
            continue
        turn = np.flatnonzero(np.diff(np.concatenate([[0], held[k].astype(np.int8), [0]])))
        out.append([(int(a), int(b) - 1) for a, b in zip(turn[::2], turn[1::2])])
    return out


SPAN = "core long, kind long, low int, high int"


def sort_buckets(suffixes: DataFrame, size: int) -> DataFrame:
    """Settled distances of every kind of run; rows of one core come one after another in their bucket."""

    def settle(core: int, rows: list[tuple]) -> tuple[list, list, list, list]:
        found = repeated_windows([r[1] for r in rows], *(np.array([r[k] for r in rows], dtype=np.int64) for k in (2, 3, 4)), size)
        flat_rows = [(core, r[0], a, b) for r, ranges in zip(rows, found) for a, b in ranges]
        return tuple(zip(*flat_rows)) if flat_rows else ([], [], [], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, rows, out = None, [], ([], [], [], [])
        for batch in batches:
            for own, *rest in zip(*(batch.column(n).to_pylist() for n in ("core", "kind", "content", "before", "windows", "times"))):
                if own != core:
                    if rows:
                        for held, new in zip(out, settle(core, rows)):
                            held.extend(new)
                    core, rows = own, []
                if not rows or rows[-1][0] != rest[0]:
                    rows.append(rest)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["core", "kind", "low", "high"])
            out = ([], [], [], [])
        if rows:
            out = settle(core, rows)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["core", "kind", "low", "high"])

    return suffixes.mapInArrow(run, SPAN)


def count_windows(suffixes: DataFrame, size: int) -> DataFrame:
    """The same for cores with too many kinds for a bucket: every window is counted, and counts add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for core, kind, content, before, windows, times in zip(*(batch.column(n).to_pylist() for n in ("core", "kind", "content", "before", "windows", "times"))):
                values = [xxhash.xxh3_128_intdigest(content[k : k + size]) for k in range(windows)]
                halves = [signed([v >> 64 for v in values]), signed([v & (1 << 64) - 1 for v in values])]
                same = [np.full(windows, x, dtype=np.int64) for x in (core, kind, times)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, [*same, *halves, (before - np.arange(windows)).astype(np.int32)])], names=["core", "kind", "times", "w1", "w2", "away"])

    each = staged(suffixes.mapInArrow(run, "core long, kind long, times long, w1 long, w2 long, away int"), "windows")
    met = each.groupBy("core", "w1", "w2").agg(F.sum("times").alias("met")).filter("met > 1")
    return each.join(met, ["core", "w1", "w2"]).select("core", "kind", F.col("away").alias("low"), F.col("away").alias("high"))


def repeats(docs: DataFrame, size: int = SIZE, bucket_kinds: int = 100_000) -> DataFrame:
    """(k1, k2, spans): the ranges of bytes to remove from each distinct text (k1, k2, text) that has any."""
    runs = staged(find_runs(docs, size), "runs")
    counted = runs.filter("core IS NOT NULL").groupBy("core").agg(F.sum("times").alias("met"), F.min("kind").alias("a"), F.max("kind").alias("b"))
    open_cores = counted.filter("met > 1").select("core", (F.col("a") != F.col("b")).alias("several"))
    marked = staged(runs.filter("core IS NOT NULL").join(open_cores, "core"), "marked")
    where = F.struct("k1", "k2", "first")
    kinds = marked.filter("several").groupBy("core", "kind").agg(F.sum("times").alias("times"), F.min(where).alias("at"), F.first("before").alias("before"), F.first("windows").alias("windows"))
    wanted = staged(kinds.select("core", "kind", "times", "at.*", "before", "windows"), "kinds")

    listed = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("core", "kind", "times", "first", "before", "windows")).alias("wanted"))
    texts = docs.join(listed, ["k1", "k2"]).select(F.col("text").cast("binary").alias("text"), F.explode("wanted").alias("w")).select("text", "w.*")
    cut = texts.select("core", "kind", "before", "windows", "times", F.substring("text", F.col("first") + 1, F.col("windows") + (size - 1)).alias("content"))
    large = wanted.groupBy("core").count().filter(F.col("count") > bucket_kinds).select("core", F.lit(True).alias("large"))
    cut = staged(cut.join(large, "core", "left"), "suffixes")

    edge = edge_of(size)
    leading = F.substring("content", F.col("before") - (edge - 1), 2 * edge)
    dealt = cut.filter("large IS NULL").withColumn("leading", leading).repartitionByRange("leading").sortWithinPartitions("leading", "core", "kind").drop("leading")
    settled = sort_buckets(dealt, size).unionByName(count_windows(cut.filter("large"), size))

    span = lambda start, end: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    whole = span(F.col("first"), F.col("first") + F.col("windows") + (size - 1))
    local = runs.filter("core IS NULL OR times > 1").select("k1", "k2", whole.alias("span"))
    single = marked.filter("NOT several").select("k1", "k2", whole.alias("span"))
    start = F.col("first") + F.col("before") - F.col("high")
    several = marked.filter("several").join(settled, ["core", "kind"]).select("k1", "k2", span(start, F.col("first") + F.col("before") - F.col("low") + size).alias("span"))
    spans = local.unionByName(single).unionByName(several).distinct()
    return spans.groupBy("k1", "k2").agg(F.collect_list("span").alias("spans"))


def text_key(text: Column) -> dict[str, Column]:
    """What tells texts apart; equal texts share it and all that is found out about them."""
    return {"k1": F.xxhash64(text, F.length(text)), "k2": F.hash(text)}


def merged_ranges(ranges: list | None) -> list[dict[str, int]]:
    """Ascending ranges that do not touch."""
    merged: list = []
    for r in sorted(ranges or [], key=lambda r: r["start"]):
        if merged and r["start"] <= merged[-1]["end"]:
            merged[-1]["end"] = max(merged[-1]["end"], r["end"])
        else:
            merged.append({"start": r["start"], "end": r["end"]})
    return merged


def word_repeats(docs: DataFrame, words: int) -> DataFrame:
    """(k1, k2, word_spans) like ``repeats`` for strings of so many words: the texts as 64-bit hashes of their words, in which a
    word has ``WORD_BYTES`` bytes. The ranges are those of the hashes."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for piece in pieces(batch, "text"):
                split = [t.encode().split() for t in piece.column("text").to_pylist()]
                coded = [np.array([digest(w) for w in s], dtype=np.uint64).tobytes() if len(s) >= words else None for s in split]
                table = pa.RecordBatch.from_arrays([pa.array(coded, pa.binary()), piece.column("k1"), piece.column("k2")], names=["text", "k1", "k2"])
                yield table.filter(table.column("text").is_valid())

    coded = docs.select("text", "k1", "k2").mapInArrow(code, "text binary, k1 long, k2 int")
    return repeats(staged(coded, "coded"), WORD_BYTES * words).withColumnRenamed("spans", "word_spans")


def ranges_of_words(raw: bytes, ranges: list | None, words: int) -> list[dict[str, int]]:
    """Ranges of hashes as ranges of bytes from the first whole word to the last; parts of a word at the ends do not count."""
    if not ranges:
        return []
    whole = [(-(-r["start"] // WORD_BYTES), r["end"] // WORD_BYTES) for r in ranges]
    places = [m.span() for m in re.finditer(rb"\S+", raw)]
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in whole if b - a >= words]


def remove_repeats(docs: DataFrame, text: str = "text", keep: list[str] | None = None, size: int = SIZE, as_text: bool = False, words: int | None = None) -> DataFrame:
    """Columns ``keep`` with n_bytes, spans (ascending maximal removed ranges) and kept_text, the remaining bytes.

    Every byte goes that is covered by a string of ``size`` bytes (at least 32) starting at another place too, in the same or
    another text, equal rows included. Null counts as empty; a text shorter than ``size`` is never touched. With ``as_text``
    the result is a string, without the remains of characters that lost a part of their bytes. With ``words`` every string of
    so many words (at least 4, whatever white space is between them) that starts elsewhere too goes as well, however short it
    is. Columns of the names added must not be among ``keep``.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(body.alias("text")).withColumns(text_key(F.col("text")))
    keyed = texts.filter(F.octet_length("text") >= size)
    # only the ranges stay: what is staged on the way to them goes before the words begin, and before the texts are cut
    found = settled(docs.sparkSession, "spans", lambda: repeats(keyed, size)).withColumn("word_spans", F.lit(None).cast(SPANS))
    if words:
        found = found.drop("word_spans").join(settled(docs.sparkSession, "word-spans", lambda: word_repeats(texts, words)), ["k1", "k2"], "full")
    keep = keep or ["doc_id"]
    marked = docs.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(keep)], body.alias("_text")).withColumns({f"_{n}": c for n, c in text_key(F.col("_text")).items()})
    joined = marked.join(found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "spans", "word_spans"), ["_k1", "_k2"], "left")

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        sizes, spans, rest = [], [], []
        for body, ranges, coded in zip(*(batch.column(n).to_pylist() for n in ("_text", "spans", "word_spans"))):
            raw = body.encode()
            merged = merged_ranges([*(ranges or []), *ranges_of_words(raw, coded, words)])
            cuts = [0, *[x for r in merged for x in (r["start"], r["end"])], len(raw)]
            sizes.append(len(raw))
            spans.append(merged)
            left = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
            rest.append(left.decode(errors="ignore") if as_text else left)
        return [pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(rest, pa.string() if as_text else pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                yield pa.RecordBatch.from_arrays([piece.column(f"_{k}") for k in range(len(keep))] + kernel(piece), names=schema.names)

    ranges = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("spans", ranges), T.StructField("kept_text", T.StringType() if as_text else T.BinaryType())])
    return joined.mapInArrow(run, schema)
