"""Per-user embeddings and pooling of token vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.config import PARTS, POOLING_STRATEGIES
from tallyloom.functions.vectors import dot
from tallyloom.operators.positions import with_part
from tallyloom.operators.sums import mean_vectors


def user_mean_embedding(embedded: DataFrame, key: str = "uid") -> DataFrame:
    """`(uid, n_posts, embedding)`: mean vector and number of posts.

    Sums are combined before the shuffle and exact, so the means do not depend on the partitioning.
    """
    return mean_vectors(embedded, key, n="n_posts", mean="embedding")


def user_all_embeddings(embedded: DataFrame) -> DataFrame:
    """Every embedding of every user, one row per post; `(uid, row_idx)` is the order."""
    return embedded.select("uid", "row_idx", "embedding")


def user_embedding_lists(embedded: DataFrame, part_rows: int = PARTS.vectors) -> DataFrame:
    """`(uid, part, embeddings)` for export: part p holds the vectors at places p * part_rows and on."""
    parts = with_part(embedded.select("uid", "row_idx", "embedding"), "uid", "row_idx", part_rows)
    ordered = F.array_sort(F.collect_list(F.struct("row_idx", "embedding")))
    return parts.groupBy("uid", "part").agg(ordered["embedding"].alias("embeddings"))


def pool_first_token(tokens: DataFrame, key: str) -> DataFrame:
    """Vector of the first token of each sequence, from `(key, pos, embedding)`."""
    return tokens.groupBy(key).agg(F.min_by("embedding", "pos").alias("embedding"))


def pool_mean(tokens: DataFrame, key: str, mask: str | None = None) -> DataFrame:
    """Mean over all token positions; with `mask`, padding positions are left out."""
    rows = tokens.filter(F.col(mask) == 1) if mask else tokens
    return user_mean_embedding(rows, key).select(key, "embedding")


def pool_first_token_dense(
    tokens: DataFrame, key: str, weights: list[list[float]], bias: list[float]
) -> DataFrame:
    """Dense head on the first token vector: tanh(W v + b), one weight row per output."""
    head = F.array(
        *[
            F.tanh(dot(F.col("embedding"), F.array(*[F.lit(float(w)) for w in row])) + F.lit(float(b)))
            for row, b in zip(weights, bias, strict=True)
        ]
    )
    return pool_first_token(tokens, key).select(key, head.alias("embedding"))


def pool(tokens: DataFrame, key: str, strategy: str, **options) -> DataFrame:
    """Pooling chosen by name."""
    dense, first, mean = POOLING_STRATEGIES
    if strategy == dense:
        return pool_first_token_dense(tokens, key, **options)
    if strategy == first:
        return pool_first_token(tokens, key)
    if strategy == mean:
        return pool_mean(tokens, key, **options)
    raise ValueError(f"unknown pooling strategy {strategy!r}")
