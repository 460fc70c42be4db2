"""Byte-level BPE encoding and decoding with numpy.

The words of a batch are sorted by length into padded matrices of token ids. In each round every row merges its leftmost pair
of least rank; ranks come from a hash table of pairs, and the row closes up behind the merge.
"""

from __future__ import annotations

import base64
import re
import zlib
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from catalog_engine.llm.texts import append, kept

NONE = np.int32(2**31 - 1)
LONG_WORD = 192
MOST_WORDS = 100_000
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
DOUBLE_SPACE = re.compile(r"\s\s")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairTable:
    """Rank (which is also the id) of the token that two adjacent tokens make, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        found = [(ranks[t[:k]], ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs = np.array(found, dtype=np.int64).reshape(-1, 3)
        self.bits = max(4, int(np.ceil(np.log2(max(len(pairs), 1) * 2.5))))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int32)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        slots, waiting = self._slot(keys), np.arange(len(keys))
        while len(waiting):
            free = waiting[self.keys[slots[waiting]] == -1]
            self.keys[slots[free]] = keys[free]  # of several in one slot the last one wins; the others move on
            won = self.keys[slots[waiting]] == keys[waiting]
            self.ranks[slots[waiting[won]]] = pairs[waiting[won], 2]
            waiting = waiting[~won]
            slots[waiting] = (slots[waiting] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``NONE`` where no token results or one of the two is padding (-1)."""
        shape = left.shape
        keys = (left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)).ravel()
        out = np.full(len(keys), NONE, dtype=np.int32)
        at = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slots = self._slot(keys[at])
        while len(at):
            held = self.keys[slots]
            same = held == keys[at]
            out[at[same]] = self.ranks[slots[same]]
            on = ~same & (held != -1)
            at, slots = at[on], (slots[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


def merge_rows(ids: np.ndarray, table: PairTable) -> list[np.ndarray]:
    """Merges each row of a matrix padded with -1 until no pair is left."""
    out: list = [None] * len(ids)
    rows, ranks = np.arange(len(ids)), table(ids[:, :-1], ids[:, 1:])
    while len(rows):
        best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), dtype=np.int64)
        least = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), NONE)
        done = least == NONE
        for k in np.flatnonzero(done):
            out[rows[k]] = ids[k][ids[k] >= 0]
        going = ~done
        rows, ids, ranks, best, least = rows[going], ids[going], ranks[going], best[going], least[going]
        if not len(rows):
            break
        each, column = np.arange(len(rows)), np.arange(ids.shape[1] - 1)[None, :]
        ids[each, best] = least
        ids = np.take_along_axis(ids, column + (column > best[:, None]), axis=1)
        ranks = np.take_along_axis(ranks, column[:, :-1] + (column[:, :-1] >= best[:, None]), axis=1)
        inner = best < ids.shape[1] - 1
        ranks[each[inner], best[inner]] = table(ids[each[inner], best[inner]], ids[each[inner], best[inner] + 1])
        left = best > 0
        ranks[each[left], best[left] - 1] = table(ids[each[left], best[left] - 1], ids[each[left], best[left]])
    return out


def merge_long(ids: np.ndarray, table: PairTable) -> np.ndarray:
    """One long word. All places of the least pair merge in one round if no pair that the merges create is of lower rank,
    which makes no difference to merging them one by one; else only the leftmost does."""
    while len(ids) > 1:
        ranks = table(ids[:-1], ids[1:])
        least = ranks.min()
        if least == NONE:
            break
        at = np.flatnonzero(ranks == least)
        if len(at) > 1:
            run = np.concatenate([[0], np.cumsum(np.diff(at) > 1)])
            first = at[np.searchsorted(run, run, side="left")]
            at = at[(at - first) % 2 == 0]
        new = np.full(len(at), least, dtype=np.int32)
        after = ids[np.minimum(at + 2, len(ids) - 1)]
        after = np.where(at + 2 < len(ids), after, -1).astype(np.int32)
        before = np.where(at > 0, ids[np.maximum(at - 1, 0)], -1).astype(np.int32)
        joined = np.zeros(len(at), dtype=bool)
        joined[1:] = at[1:] == at[:-1] + 2
        lower = (table(new, after) < least) | (table(before, new) < least) | (joined & (table(new, new) < least))
        if lower.any():
            at = at[:1]
        ids = ids.copy()
        ids[at] = least
        ids = np.delete(ids, at + 1)
    return ids


def encode_words(words: list[bytes], table: PairTable) -> list[bytes]:
    """Ids of each word, little-endian unsigned 32-bit."""
    out: list = [b""] * len(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    width = np.where(sizes <= 32, -(-sizes // 4) * 4, -(-sizes // 32) * 32)
    for bucket in np.unique(width[(sizes > 0) & (sizes <= LONG_WORD)]):
        members = np.flatnonzero(width == bucket)
        for start in range(0, len(members), 20_000):
            part = members[start : start + 20_000]
            flat = np.frombuffer(b"".join(words[k] for k in part), dtype=np.uint8)
            inside = np.arange(bucket)[None, :] < sizes[part][:, None]
            ids = np.full((len(part), bucket), -1, dtype=np.int32)
            ids[inside] = table.single[flat]
            for k, row in zip(part, merge_rows(ids, table)):
                out[k] = row.astype("<u4").tobytes()
    for k in np.flatnonzero(sizes > LONG_WORD):
        out[k] = merge_long(table.single[np.frombuffer(words[k], dtype=np.uint8)], table).astype("<u4").tobytes()
    return out


class Encoder:
    """Texts to ids. A single space between two other characters always starts a word, so a text is looked up in parts cut
    there; parts and words that were met before are kept, up to ``MOST_WORDS`` of each."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.table, self.pattern = PairTable(ranks), regex.compile(pattern)
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn(self, parts: list[str]) -> None:
        flat: list[str] = []
        ends = [0]
        for part in parts:
            flat += self.pattern.findall(part)
            ends.append(len(flat))
        if len(self.words) > MOST_WORDS:
            self.words = {}
        fresh = list(set(flat) - self.words.keys())
        self.words.update(zip(fresh, encode_words([w.encode() for w in fresh], self.table)))
        codes = list(map(self.words.__getitem__, flat))
        for part, start, end in zip(parts, ends, ends[1:]):
            self.parts[part] = codes[start] if end - start == 1 else b"".join(codes[start:end])

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = []
        for text in texts:
            first, *rest = SINGLE_SPACE.split(text) if DOUBLE_SPACE.search(text) else text.split(" ")
            cut.append([first, *[" " + r for r in rest]])
        if len(self.parts) > MOST_WORDS:
            self.parts = {}
        self._learn(list(set().union(*cut) - self.parts.keys()))
        return [b"".join(map(self.parts.__getitem__, parts)) for parts in cut]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: list[str] | None = None, name: str = "ids") -> DataFrame:
    """Columns ``keep`` and the ids of the text, little-endian unsigned 32-bit; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary, of fixed size
    known = f"pairs {zlib.crc32(repr(sorted(ranks.items())).encode())} {pattern}"

    def kernel(texts: pa.Array):
        encoder = kept(known, lambda: Encoder(shared.value, pattern))
        return [pa.array(encoder([t or "" for t in texts.to_pylist()]), pa.binary())]

    return append(docs, text, keep or ["doc_id"], [T.StructField(name, T.BinaryType())], kernel)


def decode(coded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``coded`` with the bytes that the ids stand for; null ids give no bytes."""
    shared = coded.sparkSession.sparkContext.broadcast(ranks)
    held: list = []

    def kernel(lists: pa.Array):
        if not held:
            tokens = sorted(shared.value, key=shared.value.get)
            place = np.zeros(max(shared.value.values(), default=0) + 2, dtype=np.int64)
            place[np.array([shared.value[t] for t in tokens], dtype=np.int64) + 1] = [len(t) for t in tokens]
            held.extend([np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(place)])
        flat, place = held
        out = []
        for value in lists.to_pylist():
            codes = np.frombuffer(value or b"", dtype="<u4").astype(np.int64)
            sizes = place[codes + 1] - place[codes]
            shift = np.repeat(place[codes] - np.concatenate([[0], np.cumsum(sizes)[:-1]])[: len(codes)], sizes)
            out.append(flat[shift + np.arange(len(shift))].tobytes())
        return [pa.array(out, pa.binary())]

    return append(coded, ids, coded.columns, [T.StructField(name, T.BinaryType())], kernel)
