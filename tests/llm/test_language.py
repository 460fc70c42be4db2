"""Language identification against plain counting and decoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from catalog_engine.llm import language


def plain_row(text: str) -> np.ndarray:
    counts = np.zeros(language.WIDTH)
    letters = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode())
    for n, base, buckets in ((2, 0, language.PAIRS), (3, language.PAIRS, language.TRIPLES)):
        for k in range(len(letters) - n + 1):
            if letters[k : k + n].strip(b" "):
                counts[base + (int.from_bytes(letters[k : k + n], "big") * 0x9E3779B97F4A7C15 % (1 << 64) >> 40) % buckets] += 1
    return np.sqrt(counts) / max(np.sqrt(counts.sum()), 1e-9)


def test_rows_agree_with_plain_counting_in_blocks_of_any_size():
    texts = ["", "a", "Ab", "señor Ñandú 12 x", None, "the cat sat on the mat, " * 40, "é" * 33]
    want = np.stack([plain_row(t or "") for t in texts])
    for block in (1, 2, 3, 7, 64, 1 << 20):
        assert np.allclose(language.ngram_rows(pa.array(texts, pa.string()), block), want, atol=1e-5)


def test_predictions_agree_with_plain_decoding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, code, weights = model = language.fit_languages(docs, per_language=30)
    found = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    for r in docs.collect():
        margins = plain_row(r["text"] or "") @ weights[:-1] + weights[-1]
        loss = [sum(np.logaddexp(0, -m * bit) for m, bit in zip(margins, word, strict=True)) for word in code]
        share = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        if any(c.isalpha() for c in r["text"] or ""):
            assert found[r["doc_id"]]["lang_pred"] == names[int(np.argmin(loss))] and abs(found[r["doc_id"]]["score"] - share.max()) < 1e-3
        else:
            assert (found[r["doc_id"]]["lang_pred"], found[r["doc_id"]]["score"]) == ("und", 0.0)


def test_every_label_is_learned_and_repeated_keys_count_once(spark):
    labels = 150
    word = F.concat(*[F.char(97 + F.pmod(F.xxhash64("label", F.lit(k)), F.lit(26))) for k in range(8)])
    docs = spark.range(labels * 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.lpad((F.col("id") % labels).cast("string"), 3, "0")).alias("label"))
    docs = docs.select("doc_id", F.col("label").alias("lang"), F.repeat(F.concat(word, F.lit(" ")), 30).alias("text"))
    hot = docs.filter("doc_id = 0").join(spark.range(3000).select(F.lit(0).cast("long").alias("doc_id")), "doc_id")
    model = language.fit_languages(docs.unionByName(hot), most_rows=labels * 2)
    assert len(model[0]) == labels
    found = language.identify(docs, model, keep=["doc_id", "lang"])
    assert found.filter("lang_pred = lang").count() >= 0.95 * labels * 4
