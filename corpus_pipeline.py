"""From raw documents to packed training sequences, in stages that each take all their predecessor kept.

The columns of ``documents`` come in any order and may be accompanied by others, which the stages carry along. An empty table
runs through; a null or empty text is judged like the empty text (and fails the base rules of the second stage).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_engine.llm.nearcopies import keep_first_near
from catalog_engine.llm.packing import pack
from catalog_engine.llm.quality import fit_quality, score_quality
from catalog_engine.llm.rules import base_failed, fit_rules, rejects, with_statistics
from catalog_engine.llm.substrings import remove_repeats
from catalog_engine.llm.texts import fold
from catalog_engine.workspace import settled

#: share of certainty under which the classifier rejects a document
LEAST_QUALITY = 0.3
#: words of a string that may not occur twice
REPEATED_WORDS = 50


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _wrapped(docs: DataFrame) -> DataFrame:
    """The whole row as one column beside the text, so that no name of a result meets a name of the input."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text").alias("_text"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is under ``LEAST_QUALITY``; a fifth of the keys is kept out of the training."""
    model = fit_quality(docs, _labels(spark, sf_dir), fold(F.col("doc_id"), 5) != 0)
    scored = score_quality(_wrapped(docs), model, "_text", ["_doc"], "_quality")
    return scored.filter(F.col("_quality") >= LEAST_QUALITY).select("_doc.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or that a learned rule rejects."""
    rules = fit_rules(docs, _labels(spark, sf_dir))
    judged = with_statistics(_wrapped(docs), "_text")
    return judged.filter(~base_failed() & (rejects(rules) == 0)).select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each class of near duplicates: SimHash of 5-word shingles proposes, a Jaccard
    similarity of 0.8 decides."""
    return keep_first_near(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of ``REPEATED_WORDS`` words or of 400 bytes that occur elsewhere out of the texts; a character that is cut in
    two goes as a whole."""
    cleaned = remove_repeats(_wrapped(docs), "_text", ["_doc"], as_text=True, words=REPEATED_WORDS)
    cut = F.size("spans") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("_doc.text"))
    changed = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars")).alias("n_chars")
    return cleaned.select(*[changed.get(c, F.col(f"_doc.`{c}`").alias(c)) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("packing", packing),
]

#: the trained and the hashing stages have no form in SQL; tests compare them with plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again. What a stage has staged
    goes when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(spark, name.replace(" ", "-"), lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return docs
