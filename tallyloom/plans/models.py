"""Model-facing jobs: embedding with a plugged model, linear baselines with MLlib, user predictions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.config import TextConfig
from tallyloom.functions.text import null_text_fill, words
from tallyloom.operators.embeddings import user_all_embeddings, user_embedding_lists, user_mean_embedding
from tallyloom.operators.evaluation import majority_vote, split_accuracy
from tallyloom.operators.staging import stage
from tallyloom.operators.sums import means_in_order
from tallyloom.plans.linear import Certificate, LinearModel, certify, predict_stacked
from tallyloom.plans.tokenize import TokenizerFactory, tokenize
from tallyloom.sources.writers import write_user_json

# A factory loads the model once per Python worker; the model maps (ids, mask) matrices to vectors.
EmbedderFactory = Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]]


_KNOWN_WORDS = 1 << 18  # words whose ids a task keeps
_WINDOWS = 4_096  # windows that the model gets at once


class HashedBagOfWords:
    """Default embedder: token ids folded into `dim` counts, scaled to length 1."""

    def __init__(self, dim: int = 32):
        self.dim = dim

    def __call__(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        def embed(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
            cells = (np.arange(len(ids))[:, None] * self.dim + ids % self.dim).ravel()
            counts = np.bincount(cells, mask.ravel(), len(ids) * self.dim).reshape(len(ids), self.dim)
            norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            return counts / np.where(norm > 0, norm, 1)

        return embed


def embed_posts(processed: DataFrame, factory: EmbedderFactory | None = None) -> DataFrame:
    """Add `embedding` to tokenized posts. Arrow batches in, one vector per row out, no shuffle."""
    factory = factory or HashedBagOfWords()

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for ids, mask in batches:
            vectors = model(np.stack(ids.to_list()), np.stack(mask.to_list())) if len(ids) else np.zeros((0, 1))
            yield pd.Series(list(np.asarray(vectors, dtype=np.float64)), index=ids.index)

    return processed.withColumn("embedding", embed("input_ids", "attention_mask"))


def embed_texts(
    posts: DataFrame,
    keys: Sequence[str] = ("row_idx", "uid"),
    config: TextConfig = TextConfig(),
    tokenizer: TokenizerFactory | None = None,
    factory: EmbedderFactory | None = None,
) -> DataFrame:
    """`(keys..., embedding)` of whole texts, one row per post; the first key is unique.

    A text is tokenized into windows, each window is embedded, and the vectors are averaged by their
    numbers of tokens, in double and in the order of the windows. The windows of a text stay together where it
    is read, so nothing is shuffled and the vectors do not depend on the partitioning. Words of the built-in
    tokenizer go to Python once, where a word is hashed once, not at each place.
    """
    if tokenizer is None:
        return _embed_words(posts, keys, config, factory or HashedBagOfWords())
    windows = embed_posts(tokenize(posts.select(*keys, "text"), config, tokenizer, windows=True), factory)
    tokens = F.aggregate("attention_mask", F.lit(0), lambda n, m: n + m)
    return means_in_order(windows.withColumn("_weight", F.greatest(tokens, F.lit(1))), keys, "embedding", "_weight")


def _embed_words(posts: DataFrame, keys: Sequence[str], config: TextConfig, factory: EmbedderFactory) -> DataFrame:
    size, vocab = config.max_seq_length, config.vocab_size
    rows = posts.select(*keys, words(null_text_fill(F.col("text"))).alias("_words"))
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", `embedding` array<double>"

    def ids_of(lists: pa.Array, known: dict[bytes, int]) -> np.ndarray:
        encoded = lists.flatten().dictionary_encode()
        distinct = encoded.dictionary.cast(pa.binary()).to_pylist()
        if len(known) > _KNOWN_WORDS:
            known.clear()
        for word in distinct:
            if word not in known:
                known[word] = 1 + int(hashlib.md5(word, usedforsecurity=False).hexdigest()[:8], 16) % (vocab - 1)
        return np.array([known[word] for word in distinct], dtype=np.int32)[encoded.indices.to_numpy()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = factory(), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("_words")
            ids, lengths = ids_of(lists, known), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            counts = np.maximum(1, -(-lengths // size))  # windows of each text
            firsts = np.cumsum(counts) - counts
            text = np.repeat(np.arange(len(lengths)), counts)
            offset = (np.arange(len(text)) - firsts[text]) * size
            begin, held = starts[text] + offset, np.minimum(size, lengths[text] - offset)
            vectors = []
            for at in range(0, len(text), _WINDOWS):
                part = slice(at, at + _WINDOWS)
                mask = np.arange(size) < held[part, None]
                own = np.zeros(mask.shape, dtype=np.int32)
                own[mask] = ids[(begin[part, None] + np.arange(size))[mask]]
                vectors.append(np.asarray(model(own, mask.astype(np.int32)), dtype=np.float64))
            weight = np.maximum(held, 1).astype(np.float64)
            weighed = np.concatenate(vectors) * weight[:, None]
            means, weights = np.zeros((len(lengths), weighed.shape[1])), np.zeros(len(lengths))
            longest = np.argsort(-counts, kind="stable")
            for place in range(int(counts.max())):  # in the order of the windows, all texts that have one there
                longest = longest[: np.searchsorted(-counts[longest], -place)]
                means[longest] += weighed[firsts[longest] + place]
                weights[longest] += weight[firsts[longest] + place]
            means /= weights[:, None]
            offsets = pa.array(np.arange(len(means) + 1, dtype=np.int32) * means.shape[1])
            found = pa.ListArray.from_arrays(offsets, pa.array(means.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), found], names=[*keys, "embedding"])

    return rows.mapInArrow(walk, schema)


def user_embeddings(embedded: DataFrame) -> DataFrame:
    """Mean vector per user of embedded posts."""
    return user_mean_embedding(embedded.select("uid", "embedding"))


def user_embedding_job(posts: DataFrame, path: str, **how) -> tuple[DataFrame, DataFrame]:
    """Embed all posts once and write both results below `path`: `(mean per user, all vectors per user)`."""
    embedded = stage(embed_texts(posts, **how))
    write_user_json(user_embeddings(embedded), f"{path}/mean")
    write_user_json(user_embedding_lists(embedded), f"{path}/all")
    return user_embeddings(embedded), user_all_embeddings(embedded)


def _features(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def fit_linear(
    rows: DataFrame,
    features: str = "input_ids",
    family: str = "auto",
    reg_param: float | None = None,
    max_iter: int = 100,
    tolerance: float = 1e-6,
):
    """Logistic regression on the train split; rows with an unknown label are left out.

    Without `reg_param` the penalty is 1 / n, the usual unit-strength penalty on the summed loss.
    """
    train = rows.filter((F.col("split") == "train") & (F.col("label") >= 0))
    if reg_param is None:
        reg_param = 1.0 / max(train.count(), 1)
    model = LogisticRegression(
        featuresCol="features", labelCol="label", family=family, regParam=reg_param,
        standardization=False, maxIter=max_iter, tol=tolerance,
    )
    return model.fit(_features(train, features).select("features", F.col("label").cast("double").alias("label")))


def predict(model, rows: DataFrame, features: str = "input_ids") -> DataFrame:
    """Add the model's `prediction` as an integer; an MLlib model or a `LinearModel`."""
    if isinstance(model, LinearModel):
        scored = predict_stacked(rows, [model], features, "_predictions")
        return scored.withColumn("prediction", F.col("_predictions")[0]).drop("_predictions")
    scored = model.transform(_features(rows, features))
    return scored.withColumn("prediction", F.col("prediction").cast("int")).drop(
        "features", "rawPrediction", "probability"
    )


def linear_baseline(rows: DataFrame, features: str = "input_ids", **options) -> DataFrame:
    """Fit on train, score every split: `(split, n_rows, accuracy)`.

    The features are written once; counting, every pass of the solver and scoring read them.
    """
    rows = stage(rows.filter(F.col("label") >= 0).select("split", "label", features))
    return split_accuracy(predict(fit_linear(rows, features, **options), rows, features))


def certified_baseline(rows: DataFrame, features: str = "input_ids", **options) -> tuple[DataFrame, Certificate]:
    """The baseline with what shows that it is fitted: `(split, n_rows, accuracy, majority)` and a certificate.

    `majority` is the share of the split's largest class, which a constant model reaches.
    """
    rows = stage(rows.filter(F.col("label") >= 0).select("split", "label", features))
    model = fit_linear(rows, features, **options)
    train = rows.filter(F.col("split") == "train")
    proof = certify(LinearModel.of(model), train, features, "label", model.getOrDefault("regParam"))
    classes = rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    share = classes.groupBy("split").agg((F.max("n") / F.sum("n")).alias("majority"))
    # One row per split.
    return split_accuracy(predict(model, rows, features)).join(F.broadcast(share), "split"), proof


def user_predictions(model, rows: DataFrame, features: str = "input_ids", batch_size: int = 128) -> DataFrame:
    """Majority vote of the row predictions of each user; `row_idx` gives the batch order."""
    scored = predict(model, rows, features)
    return majority_vote(
        scored.select(
            "uid",
            F.expr(f"row_idx div {batch_size}L").alias("batch_id"),
            (F.col("row_idx") % batch_size).alias("pos"),
            "prediction",
        )
    )
