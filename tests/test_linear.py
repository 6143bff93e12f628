"""Stacked linear fits: certificates, and equality with separate fits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.plans import linear as L
from tallyloom.plans import models as M
from tallyloom.plans.jobs import baseline_by_fold, fold_users, report_labels, user_table


def made(spark, n=240, classes=3, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = np.round(rng.gamma(2, 3, (n, 5)) + 4 * np.eye(classes, 5)[y] + rng.normal(0, 1, (n, 5)), 3)
    x[:, 4] = 7  # a column without spread
    split = np.where(rng.random(n) < 0.7, "train", "test")
    rows = [(i, a.tolist(), int(b), str(s)) for i, (a, b, s) in enumerate(zip(x, y, split))]
    return spark.createDataFrame(rows, "row_idx long, v array<double>, label int, split string").repartition(3)


def stacked(rows, *conditions):
    labels = [F.when(c, F.col("label")).otherwise(-1).cast("int") for c in conditions]
    return rows.withColumn("labels", F.array(*labels))


@pytest.mark.parametrize("classes,newton", [(2, 256), (3, 256), (2, 0)])
def test_stacked_fits_are_optimal_and_equal_separate_ones(spark, monkeypatch, classes, newton):
    monkeypatch.setattr(L, "_NEWTON", newton)
    rows = made(spark, classes=classes)
    parts = [F.col("row_idx") % 3 != k for k in range(3)] + [F.lit(False)]
    together = L.fit_stacked(stacked(rows, *parts), 4, classes, "v", tolerance=1e-7)
    for part, (model, proof) in zip(parts, together[:3]):
        (alone, alone_proof), = L.fit_stacked(stacked(rows, part), 1, classes, "v", tolerance=1e-7)
        assert proof.gradient_norm <= 1e-7 and alone_proof.gradient_norm <= 1e-7 and proof.loss < proof.prior_loss - 0.05
        assert np.allclose(model.weights, alone.weights, atol=1e-4) and proof.n_rows == rows.filter(part).count()
        ml = M.fit_linear(rows.filter(part).withColumn("split", F.lit("train")), "v", tolerance=1e-10, max_iter=500)
        assert np.allclose(np.diff(L.LinearModel.of(ml).weights, axis=0), np.diff(model.weights, axis=0), atol=1e-3)
        assert np.allclose(L.LinearModel.of(ml).weights.sum(0), model.weights.sum(0), atol=1e-3)
    assert together[3][1].n_rows == 0 and not together[3][0].weights.any()


def test_a_certificate_tells_fits_from_other_weights(spark):
    rows = made(spark)
    train = rows.filter("split = 'train'")
    result, proof = M.certified_baseline(rows, "v", tolerance=1e-10, max_iter=500)
    assert proof.gradient_norm < 1e-4 and proof.loss < proof.prior_loss
    assert all(r["accuracy"] > r["majority"] for r in result.collect())
    constant = L.LinearModel(np.zeros((3, 5)), np.zeros(3))
    bad = L.certify(constant, train, "v", "label", 1 / proof.n_rows)
    assert bad.gradient_norm > 0.1 and bad.loss == pytest.approx(np.log(3)) and bad.loss >= bad.prior_loss == proof.prior_loss


@pytest.mark.parametrize("outputs", [1, 3])
def test_second_derivatives_equal_differences(outputs):
    rng = np.random.default_rng(5)
    x, y = rng.normal(0, 1, (50, 4)), rng.integers(-1, max(2, outputs), (50, 1))
    at = rng.normal(0, 0.5, (outputs, 4))

    def gradient(w):
        return np.einsum("nk,nd->kd", L._residuals((x @ w.T)[:, None, :], y)[1][:, 0], x)

    curved = L._curved(x, L._residuals((x @ at.T)[:, None, :], y)[2][:, 0])
    for i in range(at.size):
        step = np.zeros(at.size)
        step[i] = 1e-6
        difference = (gradient(at + step.reshape(at.shape)) - gradient(at - step.reshape(at.shape))) / 2e-6
        assert np.allclose(difference.ravel(), curved[i], atol=1e-6)


def test_gradient_equals_differences(spark):
    rows = stacked(made(spark, 40), F.lit(True))
    rng = np.random.default_rng(3)
    at = rng.normal(0, 0.2, (1, 3, 6))
    penalty = np.array([0.3])

    def value(w):
        return L._penalised(L._pass(rows, "v", "labels", w, [0], 3), w, penalty)

    gradient = value(at)[1]
    for place in ((0, 0, 1), (0, 2, 3), (0, 1, 5)):
        step = np.zeros_like(at)
        step[place] = 1e-5
        assert (value(at + step)[0] - value(at - step)[0])[0] / 2e-5 == pytest.approx(gradient[place], abs=1e-6)


def test_models_are_saved_and_predict(spark, tmp_path):
    rows = made(spark)
    (model, _), = L.fit_stacked(stacked(rows, F.lit(True)), 1, 3, "v")
    model.save(spark, str(tmp_path / "m"))
    back = L.LinearModel.load(spark, str(tmp_path / "m"))
    assert np.array_equal(back.weights, model.weights) and np.array_equal(back.intercepts, model.intercepts)
    got = {r["row_idx"]: r["predictions"] for r in L.predict_stacked(rows, [model, back], "v").collect()}
    for r in M.predict(back, rows, "v").collect():
        scores = model.weights @ np.array(r["v"]) + model.intercepts
        assert got[r["row_idx"]] == [scores.argmax()] * 2 == [r["prediction"]] * 2


def test_class_means(spark):
    rows = spark.createDataFrame([([0.0, 0.0], 0), ([0.0, 2.0], 0), ([4.0, 4.0], 2)], "v array<double>, label int")
    model = L.class_mean_model(rows, "v", "label", 3)
    assert model.classify(np.array([[0.0, 1.0], [4.0, 5.0], [2.0, 2.4]])).tolist() == [0, 2, 0]


def test_no_rows(spark):
    empty = stacked(made(spark).filter("row_idx < 0"), F.lit(True))
    (model, proof), = L.fit_stacked(empty, 1, 2, "v")
    assert proof.n_rows == 0 and model.weights.shape == (1, 0)


LABELS = "row_idx long, label string, screen_name string, uid string"


def test_folds_are_fitted_in_one_scan(spark, tmp_path):
    words = {"x": "red red round", "y": "blue square", "z": "green red square"}
    users = [(i, "xyz"[i % 3], f"n{i}", f"u{i}") for i in range(60)]
    posts = spark.createDataFrame(
        [(2 * i + k, u, f"t{i}-{k}", words[label] + (" blue" if i % 7 == k else "")) for i, label, _, u in users for k in range(2)],
        "row_idx long, uid string, tid string, text string",
    )
    rows = spark.createDataFrame(users, LABELS)
    true = rows.filter(F.col("row_idx") % 2 == 0)
    folds = true.select(F.concat(F.lit("f"), (F.col("row_idx") % 4).cast("string")).alias("fold"), F.col("row_idx").alias("pos"), "uid")
    asked = ["red", "blue", "green", "square", "round"]
    both, proofs = baseline_by_fold(posts, rows, true, folds, ["f0", "f2"], asked, str(tmp_path / "models"))
    found = {(r["fold"], r["split"], r["uid"]): (r["label"], r["prediction"]) for r in both.collect()}
    assert len(found) == 120 and all(p.gradient_norm <= 1e-6 for p in proofs)
    for fold in ("f0", "f2"):
        alone, _ = baseline_by_fold(posts, rows, true, folds, [fold], asked)
        assert {(r["fold"], r["split"], r["uid"]): (r["label"], r["prediction"]) for r in alone.collect()} == {
            k: v for k, v in found.items() if k[0] == fold}
        chosen = {r["uid"] for r in folds.filter(F.col("fold") == fold).collect()}
        assert {u for f, s, u in found if f == fold and s == "test"} == chosen
        assert L.LinearModel.load(spark, str(tmp_path / "models" / fold)).weights.shape == (3, 5)
    assert np.mean([label == prediction for label, prediction in found.values()]) > 0.9


def test_posts_are_scanned_once_for_all_folds(spark, tmp_path, monkeypatch):
    """However many folds, the texts are counted in one job."""
    from tallyloom.plans import jobs

    calls = []
    real = jobs.keyword_counts_by
    monkeypatch.setattr(jobs, "keyword_counts_by", lambda *a, **k: calls.append(1) or real(*a, **k))
    users = [(i, "xy"[i % 2], f"n{i}", f"u{i}") for i in range(20)]
    rows = spark.createDataFrame(users, LABELS)
    posts = spark.createDataFrame([(i, u, "t", f"w{label}") for i, label, _, u in users], "row_idx long, uid string, tid string, text string")
    true = rows.filter("row_idx > 9")
    folds = true.select((F.col("row_idx") % 5).cast("string").alias("fold"), F.col("row_idx").alias("pos"), "uid")
    found, _ = baseline_by_fold(posts, rows, true, folds, list("01234"), ["wx", "wy"])
    assert found.count() == 100 and len(calls) == 1


def test_places_of_all_folds_equal_the_report_split_of_each(spark):
    rows = spark.createDataFrame(
        [(i, "xyz"[i % 3] if i % 5 else "", f"n{i}", f"u{i % 17}") for i in range(40)], LABELS)
    true = spark.createDataFrame([(i, "yzw"[i % 3], f"n{i}", f"u{i % 9}") for i in range(14)], LABELS)
    folds = spark.createDataFrame(
        [("a", 0, "u1"), ("a", 1, "u1"), ("b", 0, "u1"), ("b", 1, "u2"), ("c", 0, "u3"), ("a", 2, "u99"), ("b", 3, "u16")],
        "fold string, pos int, uid string")
    names = ["b", "a", "none"]
    got = {(r["uid"], p["fold"]): (p["splits"], p["label"]) for r in fold_users(rows, true, folds, names).collect() for p in r["places"]}
    for at, name in enumerate(names):
        users = user_table(report_labels(rows, true, folds.filter(F.col("fold") == name))).collect()
        assert {(r["uid"], at): (r["splits"], r["label"]) for r in users} == {k: v for k, v in got.items() if k[1] == at}
