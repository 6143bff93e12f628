"""From raw documents to sampled training tokens, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written and read again as the next
stage's documents: the quality classifier rejects documents, SimHash keeps one document of each group of
near-duplicates, repeated passages are cut out, sources are mixed to their target weights (documents are
left out or repeated), and SentencePiece draws two distinct segmentations of every text that is left.

A stage's intermediate tables go when the next stage starts: by then its result has been written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import mixing, passages, quality, sentencepiece_sampling, simhash
from tallyloom.llm.common import table
from tallyloom.operators.staging import release_shuffles, release_staged, stage, staged_paths, unstage

Step = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT: list[str] = []  # intermediate tables of the stage before

ORACLE_SQL = None  # fitted models and sampling are beyond SQL; tests hold the rows against brute force


def _stage(step: Step) -> Step:
    @wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_staged(spark, _LEFT)
        release_shuffles(spark)
        before = set(staged_paths())
        result = step(spark, docs, sf_dir)
        _LEFT[:] = [path for path in staged_paths() if path not in before]
        return result

    return run


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


@_stage
def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


@_stage
def sample_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_sampling.encode(docs).select("doc_id", "sample", "ids", "log_prob", "inclusion")


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_distinct),
    ("substring dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", sample_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
        unstage(last)
        last = docs
    return docs
