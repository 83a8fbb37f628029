"""Corpus pipeline: quality classifier, line de-duplication, near-duplicates, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents the stage
before it kept; all but the last return the columns of ``documents``. ``run``
writes each stage's rows as Parquet in the shared folder and reads them back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from potable.llm.common import documents, written
from potable.llm.line_dedup import line_dedup
from potable.llm.mixing import mix_sources, repeat_documents
from potable.llm.near_dups import near_duplicates
from potable.llm.packing import pack_documents
from potable.llm.quality_classifier import classify_quality
from potable.sources.tables import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, verdicts: DataFrame, label: str) -> DataFrame:
    """``docs`` without the ids whose every verdict is negative."""
    gone = verdicts.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("doc_id is not null and not kept")
    return docs.select(*COLUMNS).join(written(gone.select("doc_id"), label), "doc_id", "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside their language's perplexity quantiles go."""
    verdicts = classify_quality(docs.select(*COLUMNS), read_table(spark, sf_dir, "labels"))
    return _without(docs, verdicts.select("doc_id", "kept"), "rejected")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; no document goes."""
    out = line_dedup(docs.select(*COLUMNS))
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("dedup.text"))
    return out.select(
        "doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars")
    )


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five words, similarity 0.8)."""
    verdicts = near_duplicates(docs.select("doc_id", "text"), k=5, percent=80)
    return _without(docs, verdicts.select("doc_id", "kept"), "near-duplicates")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return repeat_documents(mix_sources(docs.select(*COLUMNS)), COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near duplicates", near_dups),
    ("mixing", mix),
    ("packing", pack),
]

#: language-model training, MinHash and tokenization have no SQL form; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if number < len(STAGES) - 1:
            rows = written(rows, f"stage-{number}")
    return rows
