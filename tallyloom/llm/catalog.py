"""The queries of this subpackage: each operator over its whole table, as its result is agreed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.catalog.registry import Query
from tallyloom.llm import (
    hidden_markov, html_extraction, importance, line_dedup, mean_search, mixing, multi_index, passages, quality, sentencepiece_sampling,
    simhash, toxicity, vafile,
)
from tallyloom.llm.common import table

QUERIES: dict[str, Query] = {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}


def _query(run: Query, sql: str | None = None) -> Query:
    QUERIES[run.__name__] = run
    if sql:
        ORACLES[run.__name__] = sql
    return run


@_query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), F.col("component").alias("component_id"))


@_query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_sampling.encode_checked(table(spark, sf_dir, "documents"))


@_query
def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), "kept")


@_query
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"))


@_query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.balance(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@_query
def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.col("start").alias("first_word"), F.col("words").alias("n_words"), "kind",
        F.col("component").alias("component_id"), F.col("kept").alias("kept_doc_ids"),
    )


@_query
def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score_documents(table(spark, sf_dir, "documents"))


@_query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_main_text(table(spark, sf_dir, "pages"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mean_search.cluster(table(spark, sf_dir, "embeddings"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


_query(op11_clusters, mean_search.CLUSTER_SQL)
_query(op12_resample, importance.RESAMPLE_SQL)
_query(op13_lines, line_dedup.LINES_SQL)
