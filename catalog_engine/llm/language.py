"""Language identification with error-correcting output codes.

Every language owns a codeword of bits. One linear classifier per bit looks at hashed byte 2- and 3-grams of the lower-cased
text; the loss of all bits against a codeword decides, and the runner-up tells whether the decision is ambiguous.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_engine.llm.texts import append, flat, sampled

PAIRS, TRIPLES = 1024, 3072
WIDTH = PAIRS + TRIPLES
BLOCK = 1 << 20  # bytes of text worked on at once
#: ASCII letters and bytes of other scripts stay, everything else separates words
LETTER = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint64)


def ngram_rows(texts: pa.Array, block: int = BLOCK) -> np.ndarray:
    """One row of hashed n-gram weights per text, of length 1 (0 without letters); bytes are counted in blocks."""
    data, offsets = flat(pc.utf8_lower(texts))
    rows, size = len(offsets) - 1, len(data)
    counts = np.zeros(rows * WIDTH, dtype=np.float32)
    for begin in range(0, size, block):
        end = min(begin + block + 2, size)
        letters = LETTER[data[begin:end]]
        row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(np.clip(offsets, begin, end))) * WIDTH
        for n, base, buckets in ((2, 0, PAIRS), (3, PAIRS, TRIPLES)):
            grams = min(block, end - begin - n + 1)
            if grams < 1:
                continue
            gram = letters[:grams].copy()
            for k in range(1, n):
                gram = (gram << np.uint64(8)) | letters[k : grams + k]
            blank = np.uint64(0x202020 & ((1 << 8 * n) - 1))
            inside = (row[:grams] == row[n - 1 : grams + n - 1]) & (gram != blank)
            mixed = (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            cell = row[:grams] + base + (mixed % np.uint64(buckets)).astype(np.int64)
            counts += np.bincount(cell[inside], minlength=rows * WIDTH).astype(np.float32)
    weights = np.sqrt(counts, out=counts).reshape(rows, WIDTH)
    return weights / np.maximum(np.sqrt((weights * weights).sum(axis=1, keepdims=True)), 1e-9)


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """A row of -1/+1 bits per class: the exhaustive code for few classes, else the best of many random codes."""
    if classes < 2:
        return np.ones((classes, 1), dtype=np.float32)
    if classes <= 5:
        columns = [(1, *bits) for bits in product((-1, 1), repeat=classes - 1) if min(bits) < 0]
        return np.array(columns, dtype=np.float32).T
    length, random, best, apart = max(15, int(np.ceil(10 * np.log2(classes)))), np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = random.choice(np.array([-1, 1], dtype=np.float32), size=(classes, length))
        nearest = ((length - code @ code.T) / 2 + length * np.eye(classes)).min()
        if nearest > apart and (np.abs(code.sum(axis=0)) < classes).all():
            best, apart = code, nearest
    return best if best is not None else code


def train_bits(rows: np.ndarray, targets: np.ndarray, rounds: int = 150, rate: float = 40.0, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression of all bits at once (momentum on the full sample); the last row holds the offsets."""
    inputs = np.hstack([rows, np.ones((len(rows), 1), dtype=np.float32)])
    weights = np.zeros((inputs.shape[1], targets.shape[1]), dtype=np.float32)
    speed = np.zeros_like(weights)
    for _ in range(rounds):
        margin = np.clip(targets * (inputs @ weights), -30, 30)
        slope = inputs.T @ (-targets / (1 + np.exp(margin))) / len(inputs) + decay * weights
        speed = 0.9 * speed - 0.1 * rate * slope
        weights += speed
    return weights


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codeword of least logistic loss, its share against the others, and the share of the runner-up."""
    loss = np.logaddexp(0, -margins) @ (code > 0).T + np.logaddexp(0, margins) @ (code < 0).T
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    share /= share.sum(axis=1, keepdims=True)
    order = np.sort(share, axis=1)
    return loss.argmin(axis=1), order[:, -1], order[:, -2] if code.shape[0] > 1 else np.zeros(len(order))


def fit_languages(train: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_language: int = 400, most_rows: int = 25_600) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their codewords and the bit classifiers; every label with a text that has a letter is learned.

    Learns from about ``per_language`` keys of each label, fewer if all labels together would exceed ``most_rows``, and from at least
    one key of each; they are taken by a hash of the key, one row per key and label however often the table repeats it (of
    different texts the least). Rows without label are left out; no labels give no language.
    """
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    known = train.filter(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(text).alias("text"), F.col(label).alias("label"), F.col(key).alias("key"), draw.alias("draw"))
    sizes = known.groupBy("label").agg(F.approx_count_distinct("draw").alias("keys"), F.min("draw").alias("least")).collect()
    names = sorted(r["label"] for r in sizes)
    code = codewords(len(names))
    if len(names) < 2:
        return names, code, np.zeros((WIDTH + 1, code.shape[1] if len(names) else 1), dtype=np.float32)
    wanted = max(1, min(per_language, most_rows // len(names)))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["label"], max(min(1.0, wanted / max(r["keys"], 1)), r["least"]))])
    chosen = known.filter(F.col("draw") <= F.try_element_at(share, F.col("label"))).groupBy("label", "key").agg(F.min("text").alias("text"))
    rows = append(chosen, "text", ["label"], [T.StructField("grams", T.BinaryType())], lambda texts: [pa.array([r.astype(np.float16).tobytes() for r in ngram_rows(texts)], pa.binary())]).collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["grams"])))
    grams = np.stack([np.frombuffer(r["grams"], dtype=np.float16) for r in rows]).astype(np.float32)
    place = {name: k for k, name in enumerate(names)}
    return names, code, train_bits(grams, code[[place[r["label"]] for r in rows]])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text", keep: list[str] | None = None, margin: float = 0.2) -> DataFrame:
    """Columns ``keep`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` (the runner-up is closer than ``margin``).

    A text that is null or has no letter is ``und`` with score 0; with no language learned every text is.
    """
    names, code, weights = model
    texts = docs.select(*(keep or ["doc_id"]), F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("_text"))

    def kernel(part: pa.Array):
        spoken = np.asarray(pc.is_valid(part)) & bool(names)
        if not names:
            best, first, second = (np.zeros(len(part)) for _ in range(3))
        else:
            best, first, second = decode(ngram_rows(part) @ weights[:-1] + weights[-1], code)
        label = [names[int(b)] if s else "und" for b, s in zip(best, spoken)]
        return [pa.array(label, pa.string()), pa.array(np.round(np.where(spoken, first, 0.0).astype(np.float64), 9)), pa.array(~spoken | (first - second < margin))]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return append(texts, "_text", keep or ["doc_id"], fields, kernel)
