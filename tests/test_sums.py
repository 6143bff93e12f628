"""Sums that give the same bits for any partitioning."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.catalog import bindings as D
from tallyloom.config import TextConfig
from tallyloom.operators import sums as S
from tallyloom.operators.embeddings import user_mean_embedding
from tallyloom.plans import models as M
from tallyloom.plans.tokenize import tokenize


def made(spark, n=900):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (n, 3)) * 10.0 ** rng.integers(-6, 12, (n, 3))
    rows = [(None if i % 13 == 0 else "hot" if i % 3 else f"u{i % 40}", None if i % 29 == 0 else v.tolist()) for i, v in enumerate(x)]
    return rows, spark.createDataFrame(rows, "uid string, embedding array<double>")


def test_means_are_exact_and_equal_bit_by_bit(spark):
    rows, frame = made(spark)
    expected = {}
    for uid, v in rows:
        if v is not None:
            expected.setdefault(uid, []).append(v)
    results = []
    for parts in (1, 4, 211):
        got = user_mean_embedding(frame.repartition(parts, F.rand(parts)))
        results.append({r["uid"]: (r["n_posts"], r["embedding"]) for r in got.collect()})
    assert results[0] == results[1] == results[2] and set(results[0]) == set(expected)
    for uid, vs in expected.items():
        n, mean = results[0][uid]
        assert n == len(vs)
        for d in range(3):
            exact = float(sum(Fraction(v[d]) for v in vs) / n)
            assert mean[d] == pytest.approx(exact, rel=1e-14, abs=1e-18)


def test_odd_numbers_and_lengths(spark):
    rows = [("a", [1.0, float("nan")]), ("a", [2.0, 1.0]), ("b", [float("inf")]), ("b", [1.0]), ("c", []), ("d", [1e300]), ("d", [-3e300]), ("e", [-0.0])]
    got = {r["uid"]: r["embedding"] for r in user_mean_embedding(spark.createDataFrame(rows, "uid string, embedding array<double>")).collect()}
    assert got["a"][0] == 1.5 and np.isnan(got["a"][1]) and got["b"] == [float("inf")] and got["c"] == [] and got["d"] == [-1e300] and got["e"] == [0.0]
    none = spark.createDataFrame(rows, "uid string, embedding array<double>").filter("uid = 'x'")
    assert user_mean_embedding(none).count() == 0


def test_limbs_hold_every_bit():
    x = np.array([0.0, 1.0, -1.5, 2.0**61, -(2.0**40) - 2.0**-12, 3 * 2.0**-55, 2.0**-62, 1e308, -np.inf])
    limbs, rest = S.limbs_of(x)
    assert np.array_equal(S.value_of(limbs, rest), x)
    assert np.array_equal(S.value_of(limbs.copy() * 3, rest)[:7], np.array([float(3 * Fraction(v)) for v in x[:7]]))


def test_whole_texts_are_embedded_alike_for_any_partitioning(spark, sf):
    posts = D.document_posts(spark, sf).limit(150).toPandas()
    posts.loc[3, "text"] = "many words of one text " * 3_000
    results = []
    for parts in (1, 4, 211):
        frame = spark.createDataFrame(posts).repartition(parts)
        got = M.embed_texts(frame, config=TextConfig(max_seq_length=16))
        assert "Exchange" not in M.embed_texts(spark.createDataFrame(posts))._jdf.queryExecution().executedPlan().toString()
        results.append({r["row_idx"]: r["embedding"] for r in got.collect()})
    assert len(results[0]) == 150 and results[0] == results[1] == results[2]


def test_words_are_hashed_once_and_embedded_as_their_windows(spark):
    """No word is hashed in the plan; the vectors are those of the windows of the built-in tokenizer."""
    texts = ["A b  a É é", None, "", "x " * 700, " ".join(f"w{i}" for i in range(300)), "b\x1cAİ\u2003z"] * 3
    posts = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "row_idx long, uid string, text string").repartition(3)
    config = TextConfig(max_seq_length=8)
    assert "md5" not in M.embed_texts(posts, config=config)._jdf.queryExecution().optimizedPlan().toString()
    windows = M.embed_posts(tokenize(posts, config, windows=True))
    weighed = windows.withColumn("w", F.greatest(F.aggregate("attention_mask", F.lit(0), lambda n, m: n + m), F.lit(1)))
    expected = {r["row_idx"]: r["embedding"] for r in S.means_in_order(weighed, ["row_idx", "uid"], "embedding", "w").collect()}
    try:
        for size in ("2", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert {r["row_idx"]: r["embedding"] for r in M.embed_texts(posts, config=config).collect()} == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_windows_are_weighed_by_their_tokens(spark):
    rows = [(1, "u", [1.0, 0.0], 3), (1, "u", [0.0, 1.0], 1), (2, "v", [5.0, 5.0], 2), (1, "w", [1.0, 1.0], 1)]
    frame = spark.createDataFrame(rows, "id long, uid string, e array<double>, w int").coalesce(1)
    for size in (1, 2, 10):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = [tuple(r) for r in S.means_in_order(frame, ["id", "uid"], "e", "w").collect()]
        assert got == [(1, "u", [0.75, 0.25]), (2, "v", [5.0, 5.0]), (1, "w", [1.0, 1.0])]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_exact_mean(spark):
    rng = np.random.default_rng(2)
    values = (rng.normal(0, 1, 500) * 10.0 ** rng.integers(0, 9, 500)).tolist()
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    found = {frame.repartition(n, F.rand(n)).agg(S.exact_mean(F.col("v")).alias("m")).first()["m"] for n in (1, 3, 50)}
    assert len(found) == 1 and found.pop() == pytest.approx(np.mean(values), abs=1e-11, rel=1e-12)
    odd = frame.union(spark.createDataFrame([(float("inf"),)], "v double"))
    assert odd.agg(S.exact_mean(F.col("v")).alias("m")).first()["m"] == float("inf")
    assert frame.filter("v is null").agg(S.exact_mean(F.col("v")).alias("m")).first()["m"] is None
