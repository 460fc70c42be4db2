"""Periodic runs of words: maximal stretches that repeat with a small period.

The first word of a run's period can be chosen so that the period is a Lyndon word under one of the two orders of the words.
So runs are found from Lyndon words: Baier's grouping, the first phase of a suffix sorter, puts all suffixes into groups by the
longest Lyndon word that they begin with. Under the plain and under the reversed order this gives, for each word, one root;
roots are extended to both sides by longest common extensions, and those that repeat often enough are runs.

A run with at least ``LEAST_WORDS`` words and ``LEAST_TIMES`` periods holds every three words that it is made of at least three
times. So only stretches are sorted whose three-word strings all occur three times in their text; no run is lost by that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_engine.llm.texts import append

#: a run has so many words and so many periods at least
LEAST_WORDS, LEAST_TIMES = 6, 4

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
RUNS = T.StructField("runs", T.ArrayType(RUN))


def lyndon_lengths(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that begins at each place.

    Symbols are positive; 0 separates strings and is the first symbol. Places with equal first symbols form the first groups.
    From the highest group down, each place of a group hands its Lyndon word to the nearest place on its left that is in a
    lower group; those places leave their group upwards, further the more copies they take, and their words grow by them.
    """
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    first_of = np.searchsorted(sorted_symbols, sorted_symbols)
    place_of = np.empty(len(symbols), dtype=np.int64)
    place_of[order] = np.arange(len(symbols))
    lowest = int(np.searchsorted(sorted_symbols, 1))
    counts = np.bincount(first_of, minlength=len(symbols))
    at_place, where, group, size = order.tolist(), place_of.tolist(), first_of[place_of].tolist(), counts.tolist()
    length, before = [1] * len(at_place), [0] * len(at_place)
    end = len(at_place)
    while end > lowest:
        start = group[at_place[end - 1]]
        members = at_place[start:end] if end - start == 1 else sorted(at_place[start:end])
        width = length[members[0]]
        taken: dict[int, int] = {}
        for i in members:
            j = i - 1
            while group[j] > start:
                j = before[j]
            if group[j] == start:
                j = before[j]
            before[i] = j
            if group[j] >= lowest:
                taken[j] = taken.get(j, 0) + 1
        by_copies: dict[int, list[int]] = {}
        for j, copies in taken.items():
            by_copies.setdefault(copies, []).append(j)
        for copies in sorted(by_copies, reverse=True):
            leaving = by_copies[copies]
            for j in leaving:
                own = group[j]
                size[own] -= 1
                last, hole = own + size[own], where[j]
                other = at_place[last]
                at_place[hole], where[other], at_place[last], where[j] = other, hole, j, last
                length[j] += copies * width
            entered = [group[j] + size[group[j]] for j in leaving]
            for j, new in zip(leaving, entered):
                group[j] = new
            for new in entered:
                size[new] += 1
        end = start
    return np.array(length, dtype=np.int64)


def extension_names(symbols: np.ndarray, longest: int) -> list[np.ndarray]:
    """For k = 0, 1, ... the number of the string of 2^k symbols from each place: equal numbers are equal strings."""
    names, width = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)], 1
    while 2 * width <= longest:
        last = names[-1]
        names.append(np.unique(last[:-width] * len(symbols) + last[width:], return_inverse=True)[1].astype(np.int64))
        width *= 2
    return names


def common_ahead(names: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many symbols from ``one`` and from ``two`` on are equal (one < two)."""
    a, b = one.copy(), two.copy()
    for k in range(len(names) - 1, -1, -1):
        for _ in range(2 if k == len(names) - 1 else 1):
            inside = b < len(names[k])
            same = np.zeros(len(a), dtype=bool)
            same[inside] = names[k][a[inside]] == names[k][b[inside]]
            a, b = a + (same << k), b + (same << k)
    return a - one


def common_behind(names: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many symbols before ``one`` and before ``two`` are equal (one < two)."""
    a, b = one.copy(), two.copy()
    for k in range(len(names) - 1, -1, -1):
        for _ in range(2 if k == len(names) - 1 else 1):
            inside = a >= 1 << k
            same = np.zeros(len(a), dtype=bool)
            same[inside] = names[k][a[inside] - (1 << k)] == names[k][b[inside] - (1 << k)]
            a, b = a - (same << k), b - (same << k)
    return one - a


def runs_of(symbols: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period.

    ``symbols`` are positive numbers; strings are separated by zeros, one at the beginning and one at the end too.
    """
    nothing = np.zeros((0, 3), dtype=np.int64)
    if len(symbols) < least + 2:
        return nothing
    walls = np.flatnonzero(symbols == 0)
    room = np.diff(walls).max(initial=1) - 1
    top = int(symbols.max()) + 1
    # a separator is the same as no other, so that no extension crosses one
    told = symbols.copy()
    told[walls] = top + np.arange(len(walls))
    names = extension_names(told, int(room))
    found = []
    for ordered in (symbols, np.where(symbols > 0, top - symbols, 0)):
        period = lyndon_lengths(ordered)
        at = np.flatnonzero((symbols > 0) & (period * times <= room))
        period = period[at]
        ahead, behind = common_ahead(names, at, at + period), common_behind(names, at, at + period)
        length = behind + period + ahead
        enough = length >= np.maximum(least, times * period)
        found.append(np.stack([at - behind, length, period], axis=1)[enough])
    return np.unique(np.concatenate([nothing, *found]), axis=0)


def stretches(words: np.ndarray, text_of: np.ndarray, least: int = LEAST_WORDS) -> np.ndarray:
    """Which words lie in a stretch of at least ``least`` whose three-word strings occur three times in their text.

    Strings are counted in hashed cells, so a few more stretches may pass; none that holds a run is left out.
    """
    covered = np.zeros(len(words), dtype=bool)
    if len(words) < least:
        return covered
    mix = words.astype(np.uint64)
    key = mix[:-2] * np.uint64(0x9E3779B97F4A7C15) + mix[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + mix[2:] * np.uint64(0x165667B19E3779F9)
    key += text_of[:-2].astype(np.uint64) * np.uint64(0x27D4EB2F165667C5)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    cells = max(16, int(len(words)).bit_length() + 3)
    cell = (key >> np.uint64(64 - cells)).astype(np.int64)
    often = (np.bincount(cell, minlength=1 << cells)[cell] >= 3) & (text_of[:-2] == text_of[2:])
    # stretches of such strings begin and end where the flag, or the text, changes
    begin = np.flatnonzero(often & ~np.concatenate([[False], often[:-1] & (text_of[:-3] == text_of[1:-2])]))
    stop = np.flatnonzero(often & ~np.concatenate([often[1:] & (text_of[1:-2] == text_of[:-3]), [False]])) + 3
    long_enough = stop - begin >= least
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(marks, begin[long_enough], 1)
    np.add.at(marks, stop[long_enough], -1)
    return np.cumsum(marks[:-1]) > 0


def find_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each text, as rows (start, length, period) by start and period."""
    number: dict[bytes, int] = {}
    words = np.array([number.setdefault(w, len(number) + 1) for t in texts for w in t], dtype=np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    text_of = np.repeat(np.arange(len(texts)), sizes)
    inside = stretches(words, text_of)
    places = np.flatnonzero(inside)
    empty = np.zeros((0, 3), dtype=np.int64)
    if not len(places):
        return [empty] * len(texts)
    # the stretches one after the other with a separator around each
    opens = np.concatenate([[True], (np.diff(places) > 1) | (np.diff(text_of[places]) > 0)])
    shifted = np.arange(len(places)) + np.cumsum(opens)
    symbols = np.zeros(shifted[-1] + 2, dtype=np.int64)
    symbols[shifted] = words[places]
    origin = np.zeros(len(symbols), dtype=np.int64)
    origin[shifted] = places
    runs = runs_of(symbols)
    starts = origin[runs[:, 0]]
    owner = text_of[starts]
    runs = np.stack([starts - first[owner], runs[:, 1], runs[:, 2]], axis=1)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [runs[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not len(runs):
        return words
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(marks[:-1]) == 0)]


def collapse_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep``, the runs of words in each text by start and period, and ``collapsed``: the words that no run repeats,
    joined by one space.

    Words are what lies between spaces and ASCII control blanks. Rows are judged alone, without a shuffle: a null text has no
    runs and the empty text as ``collapsed``, repeated rows give repeated results, and a long text is one piece of work in
    linear memory. Other columns are not looked at, whatever their names are.
    """

    def kernel(texts: pa.Array):
        split = [t.encode().split() if t else [] for t in texts.to_pylist()]
        runs = find_runs(split)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        flat = np.concatenate([np.zeros((0, 3), dtype=np.int64), *runs])
        rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=RUN.names)
        collapsed = [b" ".join(kept_words(w, r)).decode() for w, r in zip(split, runs)]
        return [pa.ListArray.from_arrays(pa.array(offsets), rows), pa.array(collapsed, type=pa.string())]

    return append(docs, text, keep or ["doc_id"], [RUNS, T.StructField("collapsed", T.StringType())], kernel)


def strongest(runs: Column) -> Column:
    """The run with the most periods; ties go to the smaller start, then to the smaller period. Null without a run."""

    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)
