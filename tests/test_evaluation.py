from __future__ import annotations

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyloom.functions import vectors as V
from tallyloom.operators import evaluation as E


def preds(spark, *rows):
    return spark.createDataFrame(list(rows), "uid string, batch_id long, pos long, prediction int")


@pytest.fixture(scope="module")
def lists(spark):
    """Users 7: [4, 2], 11: [2, 3, 2], 12: [4, 4, 3]."""
    return preds(
        spark, ("7", 0, 0, 4), ("7", 0, 1, 2), ("11", 0, 2, 2), ("11", 0, 3, 3), ("11", 0, 4, 2),
        ("12", 0, 5, 4), ("12", 0, 6, 4), ("12", 0, 7, 3),
    )


def test_unmasked_predictions(spark):
    frame = spark.range(16).select(F.col("id").alias("prediction"), (F.col("id") < 11).cast("int").alias("loss_mask"))
    got = sorted(r["prediction"] for r in E.unmasked_predictions(frame).collect())
    assert got == list(range(11))


def test_prediction_lists_put_the_newest_batch_first(spark, lists):
    new = preds(spark, ("11", 1, 0, 5), ("5", 1, 1, 0), ("5", 1, 4, -1), ("11", 1, 7, 6), ("9", 1, 3, 1))
    got = {r["uid"]: r["predictions"] for r in E.user_prediction_lists(lists.unionByName(new)).collect()}
    assert got == {"5": [0, -1], "7": [4, 2], "9": [1], "11": [5, 6, 2, 3, 2], "12": [4, 4, 3]}
    parts = E.user_prediction_lists(lists.unionByName(new), 2).orderBy("uid", "part").collect()
    assert [r["predictions"] for r in parts if r["uid"] == "11"] == [[5, 6], [2, 3], [2]]


def test_majority_vote(spark, lists):
    assert E.majority_vote(preds(spark, ("a", 0, 0, 9), ("a", 0, 1, 9), ("a", 0, 2, 6))).first()["prediction"] == 9
    got = {r["uid"]: r["prediction"] for r in E.majority_vote(lists).collect()}
    assert got == {"7": 4, "11": 2, "12": 4}
    tie = preds(spark, ("a", 0, 0, 1), ("a", 1, 5, 2))
    assert E.majority_vote(tie).first()["prediction"] == 2  # the newest batch is seen first


def test_large_positions_and_batches(spark):
    wide = preds(spark, ("a", 0, 1 << 40, 1), ("a", 0, (1 << 40) + 1, 2), ("b", 0, 0, 3), ("b", 1 << 40, 1 << 50, 4))
    assert {r["uid"]: r["prediction"] for r in E.majority_vote(wide).collect()} == {"a": 1, "b": 4}
    many = spark.range(20).selectExpr("'a' AS uid", "id AS batch_id", "0L AS pos", "CAST(id AS INT) AS prediction", "1 AS loss_mask")
    assert [r["predictions"] for r in E.user_prediction_lists(many, 8).orderBy("part").collect()] == [
        list(range(19, 11, -1)), list(range(11, 3, -1)), [3, 2, 1, 0],
    ]


def test_fraction_correct_users(spark, lists):
    voted = E.majority_vote(lists)
    for kind in ("int", "double"):
        labels = spark.createDataFrame([("7", 4), ("11", 3)], "uid string, label int").withColumn("label", F.col("label").cast(kind))
        row = E.fraction_correct_users(voted, labels).first()
        assert (row["n_users"], row["ratio"]) == (2, 0.5)
    nobody = spark.createDataFrame([("x", 0)], "uid string, label int")
    assert E.fraction_correct_users(voted, nobody).first()["ratio"] == -1


def test_mean_user_accuracy_weighs_users_equally(spark):
    frame = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("a", 0, 1), ("b", 0, 1)], "uid string, prediction int, label int")
    row = E.mean_user_accuracy(frame).first()
    assert row["n_users"] == 2 and row["user_accuracy"] == pytest.approx((2 / 3 + 0) / 2)


def logit_rows(spark, *rows):
    return spark.createDataFrame(
        list(rows), "batch_id long, pos long, uid string, logits array<double>, label int, loss_mask int"
    )


def test_batch_metrics_ignore_padding(spark):
    rows = logit_rows(
        spark, (0, 0, "a", [2.0, 1.0], 0, 1), (0, 1, "b", [1.0, 1.0], 1, 1), (1, 0, "a", [0.0, 3.0], 1, 1),
        (1, 1, None, [9.0, 0.0], -1, 0), (2, 0, None, [9.0, 0.0], -1, 0),
    )
    got = {r["batch_id"]: r for r in E.batch_loss_accuracy(E.scored_logits(rows)).collect()}
    first = (math.log(1 + math.exp(-1)) + math.log(2)) / 2
    assert got[0]["loss"] == pytest.approx(first) and got[0]["accuracy"] == 0.5
    assert got[1]["loss"] == pytest.approx(math.log(1 + math.exp(-3))) and got[1]["accuracy"] == 1.0
    assert (got[2]["n_rows"], got[2]["loss"], got[2]["accuracy"]) == (0, 0.0, 0.0)


def test_eval_summary_has_both_weightings_and_no_row_without_users(spark):
    rows = logit_rows(
        spark, (0, 0, "a", [2.0, 1.0], 0, 1), (0, 1, "b", [1.0, 2.0], 0, 1), (1, 0, "a", [3.0, 0.0], 0, 1),
    ).withColumn("split", F.lit("test"))
    padding = logit_rows(spark, (0, 0, None, [1.0, 0.0], -1, 0)).withColumn("split", F.lit("validation"))
    labels = spark.createDataFrame([("a", 0), ("b", 0)], "uid string, label int")
    got = E.eval_summary(E.scored_logits(rows.unionByName(padding)), labels).collect()
    assert [r["split"] for r in got] == ["test"]
    row = got[0]
    assert row["accuracy"] == 0.75 and row["row_accuracy"] == pytest.approx(2 / 3)
    assert row["user_accuracy"] == 0.5 and row["correct_users_ratio"] == 0.5 and row["n_users"] == 2


def test_rows_without_a_label_do_not_count(spark):
    rows = logit_rows(spark, (0, 0, "a", [2.0, 1.0], 0, 1), (0, 1, "b", [1.0, 2.0], -1, 1), (1, 0, "b", [1.0, 2.0], -1, 1))
    scored = E.scored_logits(rows)
    assert [r["loss"] is None for r in scored.orderBy("batch_id", "pos").collect()] == [False, True, True]
    got = {r["batch_id"]: (r["n_rows"], r["accuracy"]) for r in E.batch_loss_accuracy(scored).collect()}
    assert got == {0: (1, 1.0), 1: (0, 0.0)}


def test_labels_hold_for_their_split(spark):
    rows = logit_rows(spark, (0, 0, "a", [2.0, 1.0], 0, 1))
    both = rows.withColumn("split", F.lit("train")).unionByName(rows.withColumn("split", F.lit("test")))
    labels = spark.createDataFrame([("a", 0, "train"), ("a", 1, "test")], "uid string, label int, split string")
    got = {r["split"]: r["correct_users_ratio"] for r in E.eval_summary(E.scored_logits(both), labels).collect()}
    assert got == {"train": 1.0, "test": 0.0}
    assert E.eval_summary(E.scored_logits(both), labels.filter("split = 'test'")).count() == 1


def test_fold_accuracy(spark, rows):
    folds = spark.createDataFrame([("f", "a"), ("f", "a"), ("f", "b"), ("f", "x"), ("g", "x")], "fold string, uid string")
    labels = spark.createDataFrame([("a", 1), ("b", 1), ("x", 0)], "uid string, label int")
    predictions = spark.createDataFrame([("a", 1), ("b", 0)], "uid string, prediction int")
    assert rows(E.fold_accuracy(folds, labels, predictions)) == [("f", pytest.approx(2 / 3), 3), ("g", -1.0, 0)]
    assert rows(E.all_user_accuracy(labels, predictions)) == [(0.5, 2)]
    assert rows(E.all_user_accuracy(labels.limit(0), predictions)) == [(-1.0, 0)]


def test_split_accuracy_and_classes(spark, rows):
    frame = spark.createDataFrame([("train", 1, 1), ("train", 0, 1), ("test", 1, 1)], "split string, prediction int, label int")
    assert rows(E.split_accuracy(frame)) == [("test", 1, 1.0), ("train", 2, 0.5)]
    dictionary = spark.createDataFrame([("a", 0), ("b", 1)], "label_text string, label_id int")
    assert E.num_classes(dictionary).first()[0] == 2


def test_argmax_takes_the_first_on_ties(spark):
    frame = spark.createDataFrame([([1.0, 3.0, 3.0],), ([2.0, 2.0, 1.0],)], "v array<double>")
    assert [r[0] for r in frame.select(V.argmax(F.col("v"))).collect()] == [1, 0]


def test_vector_functions(spark):
    frame = spark.createDataFrame([([3.0, 0.0], [0.0, 4.0], [6.0, 0.0])], "x array<float>, y array<float>, z array<float>")
    row = frame.select(
        V.squared_l2(F.col("x"), F.col("y")), V.cosine_distance(F.col("x"), F.col("y")), V.cosine_distance(F.col("x"), F.col("z"))
    ).first()
    assert tuple(row) == (25.0, 1.0, 0.0)
    with pytest.raises(ValueError):
        V.distance("other", F.col("x"), F.col("y"))
    with pytest.raises(PySparkException):
        frame.select(V.squared_l2(F.col("x"), F.array(F.lit(1.0)))).collect()


def test_linear_logits_shape(spark):
    frame = spark.range(2).select(F.array_repeat(F.lit(1), 256).alias("x"))
    got = [r[0] for r in frame.select(V.linear_logits(F.col("x"), [[0.5] * 256, [0.0] * 256], [0.0, 1.0])).collect()]
    assert got == [[128.0, 1.0], [128.0, 1.0]]
