from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.catalog import bindings as D
from tallyloom.catalog.job_queries import quality_labels
from tallyloom.config import MiningConfig, TextConfig
from tallyloom.operators.keywords import keyword_counts
from tallyloom.plans import models as M
from tallyloom.plans.jobs import mine_triplets, prepare_labels, preprocess, preprocess_keywords
from tallyloom.plans.tokenize import tokenize
from tallyloom.sources.writers import write_model


@pytest.fixture(scope="module")
def split_rows(spark, sf):
    return prepare_labels(quality_labels(spark, sf))[0]


def test_tokenizing_keeps_rows_and_length(spark, sf):
    posts = D.sparse_posts(spark, sf)
    got = tokenize(posts, TextConfig(max_seq_length=16))
    assert got.count() == posts.count()
    sizes = got.select(F.size("input_ids").alias("a"), F.size("attention_mask").alias("b")).distinct().collect()
    assert [tuple(r) for r in sizes] == [(16, 16)]
    assert got.filter("exists(zip_with(input_ids, attention_mask, (i, m) -> (i = 0) <> (m = 0)), x -> x)").count() == 0


def test_plugged_tokenizer(spark):
    posts = spark.createDataFrame([("abc",), (None,)], "text string")
    got = tokenize(posts, TextConfig(max_seq_length=2), lambda: (lambda texts: [[ord(c) for c in t] for t in texts]))
    assert sorted((r["input_ids"], r["attention_mask"]) for r in got.collect()) == [([32, 0], [1, 0]), ([97, 98], [1, 1])]


def test_preprocess_labels_every_row_from_its_split(spark, sf, split_rows):
    posts = D.turn_posts(spark, sf)
    rows = preprocess(posts, split_rows).collect()
    known = {r["uid"]: (r["split"], int(r["label"])) for r in split_rows.collect()}
    assert rows and all((r["split"], r["label"]) == known[r["uid"]] for r in rows)
    loose = preprocess(posts, split_rows, concatenate=False)
    users = {r["uid"] for r in posts.select("uid").distinct().collect()} & set(known)
    assert {r["uid"] for r in rows} == users
    assert loose.filter("window = 0").count() == posts.filter(F.col("uid").isin(users)).count()
    cut = preprocess(posts, split_rows, truncate=True)
    assert cut.filter("window > 0").count() == 0 and {r["uid"] for r in cut.collect()} == users
    for r in rows:  # an input and its further windows hold all words of the chunk
        own = sorted((x["window"], sum(x["attention_mask"])) for x in rows if (x["uid"], x["chunk_idx"]) == (r["uid"], r["chunk_idx"]))
        assert sum(n for _, n in own) == len(r["text"].split())


def test_keyword_job_with_gluing_delimiter(spark):
    posts = spark.createDataFrame([(0, "u", "t", "a b"), (1, "u", "t", "b a")], "row_idx long, uid string, tid string, text string")
    split = spark.createDataFrame([(0, "0", "n", "u", "train")], "row_idx long, label string, screen_name string, uid string, split string")
    for name, counts in (("newline", [2, 2]), ("space", [2, 2]), ("sep", [1, 0]), ("none", [2, 0])):
        got = preprocess_keywords(posts, split, ["a", "b"], TextConfig(delimiter=name)).first()
        assert got["input_ids"] == counts, name


def test_embedder_is_plugged_and_scaled(spark, sf):
    tokens = tokenize(D.document_posts(spark, sf))
    for r in M.embed_posts(tokens).select("embedding").collect():
        assert np.linalg.norm(r["embedding"]) == pytest.approx(1, abs=1e-5)
    length = M.embed_posts(tokens, lambda: (lambda ids, mask: mask.sum(axis=1, keepdims=True))).select(
        F.col("embedding")[0].alias("n"), F.aggregate("attention_mask", F.lit(0), lambda a, v: a + v).alias("m")
    )
    assert length.filter("n <> m").count() == 0


def test_user_embeddings_cover_all_users(spark, sf):
    posts = D.document_posts(spark, sf)
    got = M.user_embeddings(M.embed_texts(posts)).collect()
    assert {r["uid"] for r in got} == {r["uid"] for r in posts.select("uid").distinct().collect()}
    assert sum(r["n_posts"] for r in got) == posts.count() and {len(r["embedding"]) for r in got} == {32}


def test_long_texts_are_embedded_whole(spark):
    """The vector is the mean over windows, weighed by their tokens."""
    texts = [("a " * 5 + "b " * 3).strip(), "a b c d e f g", "", None]
    posts = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "row_idx long, uid string, text string")
    config = TextConfig(max_seq_length=4)
    count = lambda: (lambda ids, mask: np.stack([(ids > 0).sum(axis=1), np.ones(len(ids))], axis=1))
    got = {r["row_idx"]: list(r["embedding"]) for r in M.embed_texts(posts, config=config, factory=count).collect()}
    assert got == {0: [4.0, 1.0], 1: [pytest.approx((16 + 9) / 7), 1.0], 2: [0.0, 1.0], 3: [0.0, 1.0]}
    cut = tokenize(posts, config, windows=True).groupBy("row_idx").agg(F.sum(F.aggregate("attention_mask", F.lit(0), lambda a, v: a + v)))
    assert {r[0]: r[1] for r in cut.collect()} == {0: 8, 1: 7, 2: 0, 3: 0}


def test_user_embedding_job_writes_both_results(spark, tmp_path):
    posts = spark.createDataFrame([(i, "uv"[i % 2], "a b c") for i in range(6)], "row_idx long, uid string, text string")
    means, all_vectors = M.user_embedding_job(posts, str(tmp_path / "e"))
    assert means.count() == 2 and all_vectors.count() == 6
    assert spark.read.json(str(tmp_path / "e" / "mean")).count() == 2
    assert sum(len(r["embeddings"]) for r in spark.read.json(str(tmp_path / "e" / "all")).collect()) == 6


def test_linear_models(spark, sf, tmp_path):
    labels = D.embedded(spark, sf)
    rows = labels.withColumn("split", F.when(F.col("row_idx") % 5 == 0, "test").otherwise("train"))
    scores = {r["split"]: r["accuracy"] for r in M.linear_baseline(rows, "embedding", reg_param=1e-5).collect()}
    share = labels.groupBy("label").count().agg(F.max("count")).first()[0] / labels.count()
    assert scores["train"] > share and set(scores) == {"train", "test"}
    model = M.fit_linear(rows, "embedding")
    write_model(model, str(tmp_path / "model"))
    users = M.user_predictions(model, rows, "embedding").collect()
    assert {r["uid"] for r in users} == {str(i) for i in range(10)}


def test_unknown_labels_are_not_fitted(spark, sf):
    counted = keyword_counts(D.single_posts(spark, sf), D.KEYWORDS)
    label = F.when(F.col("row_idx") % 3 == 0, -1).otherwise(F.col("row_idx") % 2).cast("int")
    rows = counted.withColumn("label", label).withColumn("split", F.lit("train"))
    assert M.fit_linear(rows).numClasses == 2
    assert M.linear_baseline(rows).first()["n_rows"] == rows.filter("label >= 0").count()


def test_mining_job(spark, sf):
    posts = D.document_posts(spark, sf).withColumn("label", F.lit(-1))
    config = MiningConfig(anchors_per_batch=8, negatives_per_batch=16, threshold=1.0)
    triplets, loss = mine_triplets(posts, config)
    n = posts.count() // 8 * 8
    row = loss.first()
    assert triplets.count() == row["n_triplets"] == n and 0 <= row["loss"] < 5
