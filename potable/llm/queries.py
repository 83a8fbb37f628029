"""Registered queries: the thin contract form of each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from potable.llm.common import documents
from potable.llm.context_mixing import score_documents
from potable.llm.filter_audit import TEXT_FILTERS, filter_audit, text_filter_masks
from potable.llm.heap_clusters import heap_clusters, with_inertia
from potable.llm.kd_search import top_k
from potable.llm.line_dedup import line_dedup
from potable.llm.mixing import mix_sources
from potable.llm.near_dups import near_duplicates
from potable.llm.packing import pack_documents
from potable.llm.perplexity_rules import quality_rules
from potable.llm.quality_classifier import classify_quality
from potable.llm.secret_scan import find_secrets, span_digest, train
from potable.llm.token_counts import token_counts
from potable.llm.token_files import token_files
from potable.sources.tables import read_table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[fn.__name__] = fn
    return fn


@query
def op1_kd_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir).select("doc_id", "text"), WORD_BPE, end_id=1)


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("dedup.n_lines").alias("n_lines"), F.col("dedup.n_dropped").alias("n_dropped"),
        F.sha2(F.encode(F.col("dedup.text"), "UTF-8"), 256).alias("kept_sha256"),
    )


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), read_table(spark, sf_dir, "labels"))


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir).select("doc_id", "text"), WORD_BPE, end_id=2)


@query
def op8_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), k=4, percent=80)


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir).select("doc_id", "text"), WORD_BPE, limit=2048)


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))


@query
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return span_digest(find_secrets(docs, train(docs, read_table(spark, sf_dir, "labels"))))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = text_filter_masks(documents(spark, sf_dir).select("doc_id", "text", "lang"), read_table(spark, sf_dir, "labels"))
    return filter_audit(masks, TEXT_FILTERS)


@query
def op13_heap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*heap_clusters(read_table(spark, sf_dir, "embeddings"), k=40, rounds=5))
