"""Document quality: random-indexing word vectors, pooled per document, through a two-layer network.

Words are runs of letters, digits or signs, hashed into buckets. Each bucket has a fixed sparse ternary index vector; the
vector of a word is the sum of the index vectors around all its occurrences in the corpus. These sums are integers, so
they do not depend on the order in which tasks end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_engine.llm.texts import append, flat, pieces, sampled

BUCKETS, DIM = 1 << 14, 24
INPUTS = 4 * DIM + 1
#: 0 separates words; letters and bytes of other scripts, digits, and signs form words of their own
KIND = np.array([0 if b <= 32 else 1 if b >= 128 or chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], dtype=np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint64)
CAPITAL = np.array([65 <= b <= 90 for b in range(256)], dtype=np.int8)
BASE = 0x100000001B3
#: bytes and words of a text that are worked on at a time, so that a long text needs little more memory than a short one
BLOCK_BYTES, BLOCK_WORDS = 1 << 16, 1 << 15


def index_vectors(seed: int = 11) -> np.ndarray:
    """Four signs per bucket, the rest zero."""
    random = np.random.default_rng(seed)
    table = np.zeros((BUCKETS, DIM), dtype=np.int16)
    for _ in range(2):
        for sign in (1, -1):
            table[np.arange(BUCKETS), random.integers(0, DIM, BUCKETS)] += sign
    return table


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sum of the lower-cased bytes before each place, weighted by powers of ``BASE``, modulo 2^64."""
    sums, powers = np.zeros(len(data) + 1, dtype=np.uint64), _powers(BASE, BLOCK_BYTES)
    for at in range(0, len(data), BLOCK_BYTES):
        part = LOWER[data[at : at + BLOCK_BYTES]]
        part *= powers[: len(part)] * np.uint64(pow(BASE, at, 1 << 64))
        np.cumsum(part, out=sums[at + 1 : at + 1 + len(part)])
        sums[at + 1 : at + 1 + len(part)] += sums[at]
    return sums


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket of every word, the row it stands in, and the number of rows."""
    data, offsets = flat(texts)
    rows, size = len(offsets) - 1, len(data)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), rows
    kind = KIND[data]
    edge = np.ones(size + 1, dtype=bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    starts, ends = cut[:-1], cut[1:]
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    sums, back = _prefix_hashes(data), pow(BASE, -1, 1 << 64)
    value = (sums[ends] - sums[starts]) * _powers(back, BLOCK_BYTES)[starts % BLOCK_BYTES]
    value *= _powers(pow(back, BLOCK_BYTES, 1 << 64), size // BLOCK_BYTES + 1)[starts // BLOCK_BYTES]
    capitals = np.zeros(size + 1, dtype=np.int32)
    np.cumsum(CAPITAL[data], out=capitals[1:])
    shout = (capitals[ends] - capitals[starts]) * 2 > ends - starts
    value = (value + shout.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    bucket = ((value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(50)).astype(np.int64)
    return bucket, np.searchsorted(offsets, starts, side="right") - 1, rows


def word_vectors(docs: DataFrame, text: str = "text", reach: int = 2) -> np.ndarray:
    """Context sums of all words of all documents, one row per bucket.

    Each task adds up its own table of fixed size (``BUCKETS`` x ``DIM``) and Spark adds the tables; the driver sees only
    the sum, which has the same size for any corpus.
    """
    names = [f"v{k}" for k in range(DIM)]
    schema = T.StructType([T.StructField("bucket", T.IntegerType())] + [T.StructField(n, T.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros((DIM, BUCKETS), dtype=np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                word, row, _ = words_of(piece.column("text"))
                for at in range(0, len(word), BLOCK_WORDS):
                    low, high = max(at - reach, 0), at + BLOCK_WORDS + reach
                    near, rows = word[low:high], row[low:high]
                    around = np.zeros((len(near), DIM), dtype=np.int16)
                    for away in range(1, min(reach, len(near) - 1) + 1):
                        same = (rows[away:] == rows[:-away])[:, None]
                        around[away:] += index[near[:-away]] * same
                        around[:-away] += index[near[away:]] * same
                    own = slice(at - low, at - low + BLOCK_WORDS)
                    for k in range(DIM):
                        total[k] += np.bincount(near[own], weights=around[own, k], minlength=BUCKETS).astype(np.int64)
        seen = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32))] + [pa.array(total[k, seen]) for k in range(DIM)], names=["bucket", *names])

    partial = docs.select(F.col(text).alias("text")).mapInArrow(run, schema)
    table = np.zeros((BUCKETS, DIM), dtype=np.float64)
    for r in partial.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).collect():
        table[r[0]] = r[1:]
    return table


def lexicon(table: np.ndarray) -> np.ndarray:
    """Direction of every word vector beside its own index vector: what is averaged over a document."""
    length = np.sqrt((table * table).sum(axis=1, keepdims=True))
    return np.hstack([table / np.maximum(length, 1e-9), index_vectors() / 2.0]).astype(np.float32)


def pooled(texts: pa.Array, words: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and the logarithm of its length."""
    word, row, rows = words_of(texts)
    out = np.zeros((rows, INPUTS), dtype=np.float32)
    total, square = np.zeros((rows, 2 * DIM)), np.zeros((rows, 2 * DIM))
    for at in range(0, len(word), BLOCK_WORDS):
        own, vectors = row[at : at + BLOCK_WORDS], words[word[at : at + BLOCK_WORDS]].astype(np.float64)
        first = np.flatnonzero(np.diff(own, prepend=-1))
        total[own[first]] += np.add.reduceat(vectors, first, axis=0)
        square[own[first]] += np.add.reduceat(vectors * vectors, first, axis=0)
    count = np.bincount(row, minlength=rows)[:, None]
    mean = total / np.maximum(count, 1)
    out[:, : 2 * DIM], out[:, 2 * DIM : 4 * DIM] = mean, np.sqrt(np.maximum(square / np.maximum(count, 1) - mean * mean, 0))
    out[:, -1] = np.log1p(count[:, 0])
    return out


def train_network(inputs: np.ndarray, labels: np.ndarray, hidden: int = 24, rounds: int = 400, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam on the whole sample; every fifth row is kept aside to fit the temperature that the logits are divided by."""
    random = np.random.default_rng(seed)
    center, scale = inputs.mean(axis=0), inputs.std(axis=0) + 1e-3
    x, y = ((inputs - center) / scale).astype(np.float64), labels.astype(np.float64)
    aside = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), dtype=bool)
    model = {"w1": random.normal(0, 1 / np.sqrt(INPUTS), (INPUTS, hidden)), "b1": np.zeros(hidden), "w2": random.normal(0, 1 / np.sqrt(hidden), hidden), "b2": np.zeros(1)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    fit_x, fit_y = x[~aside], y[~aside]
    for step in range(1, rounds + 1):
        layer = np.tanh(fit_x @ model["w1"] + model["b1"])
        error = (1 / (1 + np.exp(-(layer @ model["w2"] + model["b2"]))) - fit_y) / len(fit_y)
        back = np.outer(error, model["w2"]) * (1 - layer * layer)
        slopes = {"w1": fit_x.T @ back + 1e-3 * model["w1"], "b1": back.sum(axis=0), "w2": layer.T @ error + 1e-3 * model["w2"], "b2": np.array([error.sum()])}
        for k, slope in slopes.items():
            one, two = moments[k]
            one[:] = 0.9 * one + 0.1 * slope
            two[:] = 0.999 * two + 0.001 * slope * slope
            model[k] = model[k] - 0.01 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    logits = np.tanh(x[aside] @ model["w1"] + model["b1"]) @ model["w2"] + model["b2"]
    heats = np.exp(np.linspace(np.log(0.5), np.log(16), 41))
    # smoothed targets, so that a sample without errors doesn't ask for endless confidence
    goal = (y[aside].sum() + 1) / (aside.sum() + 2)
    goal = np.where(y[aside] > 0, 1 - (1 - goal) * 0.02, goal * 0.02)
    loss = [(np.logaddexp(0, logits / t) - goal * logits / t).mean() if aside.any() else abs(np.log(t)) for t in heats]
    return model | {"center": center, "scale": scale, "heat": np.array([heats[int(np.argmin(loss))]])}


def probability(inputs: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    layer = np.tanh((inputs - model["center"]) / model["scale"] @ model["w1"] + model["b1"])
    return 1 / (1 + np.exp(-np.clip((layer @ model["w2"] + model["b2"]) / model["heat"], -40, 40)))


def fit_quality(docs: DataFrame, labels: DataFrame, train: object, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = 6000) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Word vectors of the whole corpus and the network.

    Labels come only from rows with the condition ``train``; about ``rows`` of them, taken by a hash of the key, are enough
    for the network. A key with several labels counts by their mean, one with several texts by one of them. Without both classes
    the score is the same everywhere.
    """
    words = lexicon(word_vectors(docs, text))
    marked = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).filter(F.col("key").isNotNull() & F.col("label").isNotNull())
    marked = marked.groupBy("key").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    total = marked.count()
    chosen = sampled(marked, "key", rows / total if total else 1.0)
    # the sample is bounded by ``rows``, so it may be sent to every task
    known = docs.filter(train).select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    inputs = append(known, "text", ["key", "label"], [T.StructField("pool", T.BinaryType())], lambda texts: [pa.array([r.tobytes() for r in pooled(texts, words)], pa.binary())])
    # one row per key, so that rows that repeat a key don't lengthen the sample
    found = inputs.groupBy("key", "label").agg(F.min("pool").alias("pool")).collect()
    found.sort(key=lambda r: (r["key"], bytes(r["pool"])))
    truth = np.array([r["label"] for r in found], dtype=np.int64)
    if not len(truth) or truth.min() == truth.max():
        sure = 2.0 * (truth.mean() if len(truth) else 0.5) - 1
        flat_model = {"w1": np.zeros((INPUTS, 1)), "b1": np.zeros(1), "w2": np.zeros(1), "b2": np.array([3 * sure]), "center": np.zeros(INPUTS), "scale": np.ones(INPUTS), "heat": np.ones(1)}
        return words, flat_model
    return words, train_network(np.stack([np.frombuffer(r["pool"], dtype=np.float32) for r in found]), truth)


def score_quality(docs: DataFrame, model: tuple[np.ndarray, dict[str, np.ndarray]], text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Columns ``keep`` and the probability of label 1; an empty or null text is scored like any other, as the empty text.
    Scores are rounded, so that the same text has the same score in any batch."""
    words, network = model
    return append(docs, text, keep or ["doc_id"], [T.StructField(name, T.DoubleType())], lambda texts: [pa.array(np.round(probability(pooled(texts, words), network), 9))])
