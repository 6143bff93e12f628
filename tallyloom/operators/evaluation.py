"""Scoring of predictions by row, batch, user and fold. Everything is a combinable aggregation."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.config import PARTS, UNKNOWN_LABEL
from tallyloom.functions.vectors import argmax, softmax_cross_entropy
from tallyloom.operators.positions import with_part
from tallyloom.operators.skew import lookup_join, stage_measured

NO_USERS = -1.0
_BATCH = Decimal(1 << 63)  # more than any position in a batch


def _ratio(matches: Column) -> Column:
    """Share of true values; -1 when there is nothing to count."""
    return F.coalesce(F.avg(matches.cast("double")), F.lit(NO_USERS))


def _list_order() -> Column:
    """Place of a prediction in a user's list, newest batch first, as one wide decimal.

    A number keeps the aggregations below on the hash path; a struct would force a sort.
    """
    return F.col("pos").cast("decimal(19,0)") - F.col("batch_id").cast("decimal(19,0)") * F.lit(_BATCH)


def _vote(predictions: DataFrame, *keys: str) -> DataFrame:
    votes = predictions.groupBy(*keys, "prediction").agg(
        F.count(F.lit(1)).alias("n"), F.min(_list_order()).alias("first")
    )
    best = F.max_by("prediction", F.struct("n", (-F.col("first")).alias("f")))
    return votes.groupBy(*keys).agg(best.alias("prediction"), F.max("n").alias("n_votes"))


def unmasked_predictions(predictions: DataFrame) -> DataFrame:
    """Predictions of real rows, padding left out."""
    return predictions.filter(F.col("loss_mask") == 1)


def user_prediction_lists(predictions: DataFrame, part_rows: int = PARTS.numbers) -> DataFrame:
    """`(uid, part, predictions)`: the newest batch first, batch order inside.

    Part p of a user holds the predictions at places p * part_rows and on.
    """
    ordered = predictions.withColumn("_ord", _list_order())
    parts = with_part(ordered.select("uid", "_ord", "prediction"), "uid", "_ord", part_rows)
    values = F.array_sort(F.collect_list(F.struct("_ord", "prediction")))
    return parts.groupBy("uid", "part").agg(values["prediction"].alias("predictions"))


def majority_vote(predictions: DataFrame) -> DataFrame:
    """`(uid, prediction, n_votes)`: most frequent prediction of a user.

    On a tie the prediction that comes first in the user's list (newest batch first) wins. Two
    aggregations, both combined map-side: (user, prediction) counts, then the best per user.
    """
    return _vote(predictions, "uid")


def fraction_correct_users(voted: DataFrame, labels: DataFrame) -> DataFrame:
    """`(n_users, ratio)` over users present on both sides."""
    joined = lookup_join(voted.select("uid", "prediction"), labels.select("uid", "label"), "uid")
    return joined.agg(
        F.count(F.lit(1)).alias("n_users"), _ratio(F.col("prediction") == F.col("label")).alias("ratio")
    )


def mean_user_accuracy(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean over users of the user's row accuracy, from `(uid, prediction, label)`."""
    per_user = rows.groupBy(*keys, "uid").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a"))
    return per_user.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_users"), F.avg("a").alias("user_accuracy"))


def scored_logits(logits: DataFrame) -> DataFrame:
    """Add `prediction`, `loss` and `correct`; padding and rows without a label have no loss and are never correct."""
    real = (F.col("loss_mask") == 1) & (F.col("label") > UNKNOWN_LABEL)
    return (
        logits.withColumn("prediction", argmax(F.col("logits")))
        .withColumn("loss", F.when(real, softmax_cross_entropy(F.col("logits"), F.col("label"))))
        .withColumn("correct", F.coalesce(real & (F.col("prediction") == F.col("label")), F.lit(False)))
    )


def batch_loss_accuracy(scored: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """`(batch_id, n_rows, loss, accuracy)`: means over the real, labelled rows; a batch without any scores 0."""
    n = F.sum(F.when((F.col("loss_mask") == 1) & (F.col("label") > UNKNOWN_LABEL), 1).otherwise(0))
    divisor = F.greatest(n, F.lit(1))
    return scored.groupBy(*keys, "batch_id").agg(
        n.cast("long").alias("n_rows"),
        (F.coalesce(F.sum("loss"), F.lit(0.0)) / divisor).alias("loss"),
        (F.sum(F.col("correct").cast("int")) / divisor).alias("accuracy"),
    )


def eval_summary(scored: DataFrame, labels: DataFrame, key: str = "split") -> DataFrame:
    """One row of metrics per split.

    `loss` and `accuracy` average the batches without weights; `row_loss` and `row_accuracy` weigh
    rows equally. User metrics compare labelled rows, and majority votes, with the labels, which hold for
    one split each if they have the column `key` and for all otherwise. A split without labelled users has
    no row.
    """
    batches = batch_loss_accuracy(scored, (key,))
    by_batch = batches.groupBy(key).agg(
        F.avg("loss").alias("loss"),
        F.avg("accuracy").alias("accuracy"),
        (F.sum(F.col("loss") * F.col("n_rows")) / F.greatest(F.sum("n_rows"), F.lit(1))).alias("row_loss"),
        (F.sum(F.col("accuracy") * F.col("n_rows")) / F.greatest(F.sum("n_rows"), F.lit(1))).alias("row_accuracy"),
    )
    real = unmasked_predictions(scored)
    by_user = mean_user_accuracy(real.filter(F.col("label") > UNKNOWN_LABEL), (key,))
    voted = _vote(real, key, "uid")
    if key in labels.columns:
        voted = voted.withColumn("_of", F.struct(key, "uid"))
        known = labels.select(F.struct(key, "uid").alias("_of"), "label")
    else:
        voted = voted.withColumn("_of", F.col("uid"))
        known = labels.select(F.col("uid").alias("_of"), "label")
    correct = (
        lookup_join(voted, known.filter(F.col("label") > UNKNOWN_LABEL), "_of")
        .groupBy(key)
        .agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("ratio"))
    )
    # One row per split on each side.
    return (
        by_batch.join(by_user, key)
        .join(correct, key)
        .select(
            key, "loss", "accuracy", "row_loss", "row_accuracy", "user_accuracy", "n_users",
            F.col("ratio").alias("correct_users_ratio"),
        )
    )


def fold_accuracy(folds: DataFrame, labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """`(fold, correct_user_ratio, num_users)` for every fold; entries repeat as often as listed.

    Entries without label or prediction do not count; a fold without any scores -1.
    """
    # Usually a vote over all predictions: written once, measured in that pass, then joined.
    known, measured = stage_measured(labels.select("uid", "label").join(predictions.select("uid", "prediction"), "uid"))
    joined = lookup_join(folds.select("fold", "uid"), known, "uid", "left", measured=measured)
    both = F.col("label").isNotNull() & F.col("prediction").isNotNull()
    return joined.groupBy("fold").agg(
        _ratio(F.when(both, F.col("label") == F.col("prediction"))).alias("correct_user_ratio"),
        F.count(F.when(both, True)).alias("num_users"),
    )


def all_user_accuracy(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """The same over every labelled user."""
    joined = labels.select("uid", "label").join(predictions.select("uid", "prediction"), "uid")
    return joined.agg(
        _ratio(F.col("label") == F.col("prediction")).alias("correct_user_ratio"),
        F.count(F.lit(1)).alias("num_users"),
    )


def split_accuracy(rows: DataFrame) -> DataFrame:
    """`(split, n_rows, accuracy)` from `(split, prediction, label)`."""
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), _ratio(F.col("prediction") == F.col("label")).alias("accuracy")
    )


def num_classes(dictionary: DataFrame) -> DataFrame:
    """Number of label texts in the dictionary."""
    return dictionary.agg(F.count_distinct("label_text").alias("n_classes"))
