"""Runs of words against brute force: every period, every stretch, every word."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog_engine.llm import periodic
from catalog_engine.llm.queries import QUERIES

ROOT = "/root/testdata/sf0.001"


def plain_lyndon(symbols: list[int]) -> list[int]:
    """For each place the words up to the next smaller suffix."""
    out = []
    for i in range(len(symbols)):
        j = i + 1
        while j < len(symbols) and symbols[j:] > symbols[i:]:
            j += 1
        out.append(j - i)
    return out


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every stretch that agrees with itself a period on, if no smaller period holds for it."""
    found = []
    for period in range(1, len(words) // 4 + 1):
        same = [a == b for a, b in zip(words, words[period:])] + [False]
        start = 0
        for i, equal in enumerate(same):
            if equal:
                continue
            length = i - start + period
            part = words[start : start + length]
            if length >= max(6, 4 * period) and not any(part[p:] == part[:-p] for p in range(1, period)):
                found.append((start, length, period))
            start = i + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_words(random, k: int) -> list[int]:
    kinds = int(random.integers(1, 5))
    words = random.integers(1, kinds + 1, int(random.integers(0, 60))).tolist()
    if k % 2 and words:
        unit = words[: int(random.integers(1, 9))]
        words = (unit * 30)[: int(random.integers(1, 70))] + words[: int(random.integers(0, 9))] + (unit[::-1] * 9)[: int(random.integers(0, 30))]
    return words


def test_lyndon_lengths_and_runs_of_random_words():
    random = np.random.default_rng(4)
    texts = [some_words(random, k) for k in range(900)]
    for words in texts:
        assert periodic.lyndon_lengths(np.array([0, *words, 0]))[1:-1].tolist() == plain_lyndon(words)
    # all at once: a run never reaches into the next text
    as_bytes = [[b"%d" % w for w in words] for words in texts]
    for words, runs in zip(as_bytes, periodic.find_runs(as_bytes)):
        assert [tuple(r) for r in runs.tolist()] == plain_runs(words)


def test_runs_inside_runs():
    inner = ["a"] * 6 + ["b"]
    (runs,) = periodic.find_runs([[w.encode() for w in inner * 5]])
    assert [tuple(r) for r in runs.tolist()] == [*sorted([(0, 35, 7), *[(7 * k, 6, 1) for k in range(5)]], key=lambda r: (r[0], r[2]))]


@pytest.mark.parametrize("unit", [1, 2, 999])
def test_long_texts_take_linear_work(unit):
    words = [b"%d" % k for k in range(unit)] * (120_000 // unit)
    (runs,) = periodic.find_runs([words])
    assert runs.tolist() == [[0, len(words), unit]]


def expected(doc_id: int | None, text: str | None) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    checksum = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if words and checksum is not None and checksum % 10 == 0:
        part, count = checksum // 10, len(words)
        start = part % count
        period = 1 + (count - start) // (3 + part % 8)
        words = [w if i < start else words[start + (i - start) % period] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    shown = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), shown[0], shown[1], shown[2], shown[3], digest(listed), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_agrees_with_brute_force(spark):
    found = {tuple(r) for r in QUERIES["op12_periodic_runs"](spark, ROOT).collect()}
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").collect()
    wanted = {expected(r["doc_id"], r["text"]) for r in docs if len(r["text"]) < 12_000}
    assert len(wanted) > 150 and wanted <= found and len(found) == len(docs)
    assert sum(r[1] > 0 for r in wanted) >= 10


def test_odd_documents(spark, odd_docs, empty_docs):
    rows = periodic.collapse_runs(odd_docs, keep=["doc_id", "text", "score"]).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        if len(words) < 2_000:
            assert [tuple(x) for x in r["runs"]] == plain_runs(words)
        if not r["runs"]:
            assert r["collapsed"] == " ".join(words)
    assert periodic.collapse_runs(empty_docs).count() == 0
    assert {r["collapsed"] for r in rows if r["text"] == "und " * 400} == {"und"}
    none = spark.createDataFrame([(None,)], "runs array<struct<start:long,length:long,period:long>>").select(periodic.strongest(F.col("runs")).alias("r"))
    assert none.first()["r"] is None
