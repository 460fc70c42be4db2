"""Sum-of-squares online packing of token sequences, each task on its own part of the documents.

A task keeps an array of how many open windows have each fill level. A document (what is left of it after whole windows) goes
to the level that makes the sum of the squared counts least; level 0 opens a window. What is open at the end of the task is
cut and joined to full windows, and the very last remainder into windows whose lengths are powers of two, which need no
padding.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_engine.llm.texts import kept, pieces

WINDOW = 4096
MOST_WORDS = 250_000
#: letters, then signs of ASCII without the apostrophe: the tokenizer always parts the two
LETTERS_THEN_SIGNS = re.compile(r"([^\W\d_]*)([!-&(-/:-@\[-`{-~]*)")


class WordIds:
    """Token ids of texts as the tokenizer gives them, each distinct word encoded once.

    The tokenizer drops white space and never merges over it, so a text's ids are those of its words. A word of letters and
    closing signs is put together from the two; its letters are lower-cased and go to the tokenizer's merges directly. Any
    other word goes through the whole tokenizer. At most ``MOST_WORDS`` words and as many parts are kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs: dict[int, str] = {k: chr(k) for k in range(97, 123)}
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, part: str) -> bytes:
        for sign in part:
            if ord(sign) not in self.signs:
                self.signs[ord(sign)] = self.bytes.pre_tokenize_str(sign)[0][0]
        return np.array([t.id for t in self.model.tokenize(part.translate(self.signs))], dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        letters, signs = LETTERS_THEN_SIGNS.match(word).groups()
        low = letters.lower()
        plain = low.isascii() or (low.isalpha() and "\u03a3" not in letters and unicodedata.is_normalized("NFC", letters) and unicodedata.is_normalized("NFC", low))
        if len(letters) + len(signs) != len(word) or not plain or "<|" in signs:
            return self._whole(word)
        if low not in self.parts:
            self.parts[low] = self._letters(low)
        if signs not in self.parts:
            self.parts[signs] = self._whole(signs)
        return self.parts[low] + self.parts[signs]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        if len(self.words) > MOST_WORDS:
            self.words = {}
        if len(self.parts) > MOST_WORDS:
            self.parts = {"": b""}
        for word in set().union(*split) - self.words.keys():
            self.words[word] = self._word(word.decode())
        return [b"".join(map(self.words.__getitem__, words)) for words in split]


class Windows:
    """Open windows by fill level; a closed window comes out as its pieces (document, start, ids)."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}

    def level_for(self, length: int) -> int:
        """The level whose use leaves the least sum of squares; of equal ones the fullest."""
        before, after = self.count[: self.size - length + 1], self.count[length:]
        change = 2 * (after - before) + 2
        change[-1] = 1 - 2 * before[-1]  # a full window is no longer counted
        change[before == 0] = np.iinfo(np.int64).max
        change[0] = 2 * after[0] + 1
        return len(change) - 1 - int(change[::-1].argmin())

    def place(self, piece: tuple) -> list | None:
        length = len(piece[2]) // 4
        level = self.level_for(length)
        if level:
            held = self.open[level].pop()
            self.count[level] -= 1
        else:
            held = []
        held.append(piece)
        if level + length == self.size:
            return held
        self.open.setdefault(level + length, []).append(held)
        self.count[level + length] += 1
        return None

    def rest(self) -> Iterator[list]:
        """What is open, joined from the fullest window down and cut at whole windows; then powers of two."""
        left = [p for level in sorted(self.open, reverse=True) for held in self.open[level] for p in held]
        held, room, total = [], self.size, sum(len(p[2]) // 4 for p in left)
        if total < room:
            room = 1 << (total.bit_length() - 1) if total else 0
        for doc, start, ids, size in left:
            while ids:
                part, ids = ids[: 4 * room], ids[4 * room :]
                held.append((doc, start, part, size))
                start += len(part) // 4
                room -= len(part) // 4
                total -= len(part) // 4
                if not room:
                    yield held
                    held, room = [], self.size if total >= self.size else 1 << (total.bit_length() - 1) if total else 0
        self.open, self.count[:] = {}, 0


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2, size: int = WINDOW) -> DataFrame:
    """One row per piece: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id and offset.

    ``tokenizer`` is the path of the tokenizer's file, the same on every machine. Every document ends with ``end_id``; a null
    text counts as empty and has that id only. Sequences do not depend on other tasks; their ids hold the task's number, so a
    task that runs again gives the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows, number, rows = kept(f"words {tokenizer}", lambda: WordIds(tokenizer)), Windows(size), TaskContext.get().partitionId() << 32, []
        end = np.array([end_id], dtype="<u4").tobytes()

        def close(held: list) -> None:
            nonlocal number
            offset = 0
            for doc, start, ids, tokens in held:
                rows.append((doc, start, len(ids) // 4, ids, tokens, number, offset))
                offset += len(ids) // 4
            number += 1

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)
            rows.clear()
            return made

        for batch in batches:
            kinds[0] = batch.schema.field("key").type
            for piece in pieces(batch, "text"):
                bodies = [t.encode() if t else b"" for t in piece.column("text").to_pylist()]
                for doc, ids in zip(piece.column("key").to_pylist(), encode(bodies)):
                    ids += end
                    tokens = len(ids) // 4
                    whole = tokens - tokens % size
                    for start in range(0, whole, size):
                        close([(doc, start, ids[4 * start : 4 * (start + size)], tokens)])
                    if tokens > whole and (held := windows.place((doc, whole, ids[4 * whole :], tokens))):
                        close(held)
                if rows:
                    yield flush()
        for held in windows.rest():
            close(held)
        if rows:
            yield flush()

    names = [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    longs = [T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in names[1:]]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, T.StructType([T.StructField(key, docs.schema[key].dataType), *longs]))
