"""Repeated strings of words against brute force."""

from __future__ import annotations

import os
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from catalog_engine.llm import substrings
from catalog_engine.workspace import shared_root


def plain_cuts(texts: list[str], size: int, words: int) -> list[str]:
    """The texts without the bytes of windows of ``size`` bytes or ``words`` words that start at another place too."""
    raws = [t.encode() for t in texts]
    places = [[m.span() for m in re.finditer(rb"\S+", r)] for r in raws]
    runs = [[(p[k][0], p[k + words - 1][1], tuple(r[a:b] for a, b in p[k : k + words])) for k in range(len(p) - words + 1)] for r, p in zip(raws, places)]
    runs = [own + [(k, k + size, r[k : k + size]) for k in range(len(r) - size + 1)] for own, r in zip(runs, raws)]
    met = Counter(what for own in runs for _, _, what in own)
    out = []
    for raw, own in zip(raws, runs):
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for a, b, what in own:
            if met[what] > 1:
                gone[a:b] = True
        out.append(bytes(x for x, g in zip(raw, gone) if not g).decode(errors="ignore"))
    return out


def test_short_passages_of_many_words_are_cut(spark):
    random = np.random.default_rng(13)
    write = lambda n: ["".join(random.choice(list("abcdefé"), 3)) for _ in range(n)]
    passages = [write(n) for n in (49, 50, 51, 70, 130)]
    texts = []
    for k in range(60):
        words = write(int(random.integers(0, 40))) + passages[k % 5][: 130 - k] + write(int(random.integers(0, 40)))
        texts.append((" ", "\n", "  ")[k % 3].join(words))
    texts += ["x" * 450 + " a", "b " + "x" * 450, "und " * 120, "", "one"]
    frame = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts)], "doc_id long, text string, n_chars int").repartition(4)
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_strings(spark, frame, "").collect()}
    assert [cut[k] for k in range(len(texts))] == plain_cuts(texts, 400, 50)
    old = {r["doc_id"]: bytes(r["kept_text"]).decode(errors="ignore") for r in substrings.remove_repeats(frame).collect()}
    assert sum(len(cut[k]) < len(old[k]) for k in old) > 20


def test_repeated_passages_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_strings(spark, docs, "").collect()}
    assert [cut[r["doc_id"]] for r in rows] == plain_cuts([r["text"] for r in rows], 400, 50)


def test_only_the_ranges_stay_in_the_shared_folder(spark):
    folder = shared_root(spark)
    before = set(os.listdir(folder))
    frame = spark.createDataFrame([(k, "a b c d e f g h " * 60, 0) for k in range(4)], "doc_id long, text string, n_chars int")
    assert all(r["text"] == "" for r in corpus_pipeline.repeated_strings(spark, frame, "").collect())
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert left == {"spans", "word-spans"}
