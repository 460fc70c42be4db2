"""The pipeline stage by stage against plain versions, and on odd and empty tables."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from catalog_engine.workspace import staged
from tests.llm.test_nearcopies import plain_classes
from tests.llm.test_word_repeats import plain_cuts

ROOT = "/root/testdata/sf0.001"


def through(spark, docs):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, ROOT), "stage")
        out.append((name, docs))
    return out


def test_stages_agree_with_plain_versions(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    scored, ruled, single, cut, packed = (df for _, df in through(spark, docs))
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    held = {r["doc_id"] for r in docs.collect()}
    for df in (scored, ruled):
        assert df.columns == docs.columns
        kept = {r["doc_id"] for r in df.collect()}
        good = [d for d in held if quality.get(d) == 1]
        assert kept < held and sum(d in kept for d in good) >= 0.85 * len(good)
        held = kept
    rows = sorted(ruled.collect(), key=lambda r: r["doc_id"])
    roots = plain_classes([r["text"] for r in rows])
    assert sorted(r["doc_id"] for r in single.collect()) == [rows[k]["doc_id"] for k in sorted(set(roots))]
    rows = single.collect()
    want = dict(zip([r["doc_id"] for r in rows], plain_cuts([r["text"] for r in rows], 400, 50)))
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == want and all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = Counter()
    for r in packed.collect():
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}


def test_odd_and_empty_tables_run_through(spark, odd_docs, empty_docs):
    for docs, some in ((odd_docs, True), (empty_docs, False)):
        frames = [df for _, df in through(spark, docs)]
        assert all(df.columns == docs.columns for df in frames[:-1])
        assert bool(frames[-1].count()) == (some and bool(frames[-2].count()))
    for _, stage in corpus_pipeline.STAGES[2:]:
        assert stage(spark, odd_docs, ROOT).count() > 0


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, ROOT).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
