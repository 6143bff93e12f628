"""Scoring queries over predictions and logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalog.bindings import (
    CUSTOMER_LABELS_SQL,
    PREDICTIONS_SQL,
    SCORED_SQL,
    LOGITS_SQL,
    VOTES_SQL,
    customer_labels,
    join_ints,
    logits,
    order_folds,
    predictions,
    segment_folds,
)
from tallyloom.catalog.registry import query
from tallyloom.functions.vectors import argmax
from tallyloom.operators import evaluation as E
from tallyloom.operators.posts import join_parts
from tallyloom.operators.skew import lookup_join


def _rounded(rows, *names, digits=6):
    return rows.withColumns({n: F.round(n, digits) for n in names})


@query(f"SELECT * FROM ({PREDICTIONS_SQL}) WHERE loss_mask = 1")
def unmasked_predictions(spark, sf):
    return E.unmasked_predictions(predictions(spark, sf))


@query(f"""
SELECT uid, 0::BIGINT AS part, string_agg(prediction::VARCHAR, ',' ORDER BY batch_id DESC, pos) AS predictions
FROM ({PREDICTIONS_SQL}) GROUP BY uid
""")
def user_prediction_lists(spark, sf):
    lists = E.user_prediction_lists(predictions(spark, sf))
    return join_parts(lists.select("uid", "part", join_ints(F.col("predictions")).alias("predictions")), "predictions", ",")


@query(f"""
WITH placed AS (
  SELECT *, (row_number() OVER (PARTITION BY uid ORDER BY batch_id DESC, pos) - 1) // 4 AS part FROM ({PREDICTIONS_SQL})
)
SELECT uid, part, string_agg(prediction::VARCHAR, ',' ORDER BY batch_id DESC, pos) AS predictions FROM placed GROUP BY uid, part
""")
def user_prediction_lists_parts(spark, sf):
    """The same lists on rows of at most four predictions."""
    lists = E.user_prediction_lists(predictions(spark, sf), part_rows=4)
    return lists.select("uid", "part", join_ints(F.col("predictions")).alias("predictions"))


@query(f"WITH {VOTES_SQL} SELECT uid, prediction, n AS n_votes FROM votes")
def majority_vote(spark, sf):
    return E.majority_vote(predictions(spark, sf))


@query(f"""
WITH {VOTES_SQL}
SELECT count(*) AS n_users, round(coalesce(avg((prediction = label)::INT::DOUBLE), -1), 6) AS ratio
FROM votes JOIN ({CUSTOMER_LABELS_SQL}) USING (uid)
""")
def fraction_correct_users(spark, sf):
    voted = E.majority_vote(predictions(spark, sf))
    return _rounded(E.fraction_correct_users(voted, customer_labels(spark, sf)), "ratio")


def _labelled_rows(spark, sf):
    return lookup_join(predictions(spark, sf), customer_labels(spark, sf), "uid")


LABELLED_SQL = f"labelled AS (SELECT p.*, l.label FROM ({PREDICTIONS_SQL}) p JOIN ({CUSTOMER_LABELS_SQL}) l USING (uid))"


@query(f"""
WITH {LABELLED_SQL},
users AS (SELECT uid, avg((prediction = label)::INT::DOUBLE) AS a FROM labelled GROUP BY uid)
SELECT count(*) AS n_users, round(avg(a), 6) AS user_accuracy FROM users
""")
def mean_user_accuracy(spark, sf):
    return _rounded(E.mean_user_accuracy(_labelled_rows(spark, sf)), "user_accuracy")


BATCHES_SQL = """
batches AS (
  SELECT split, batch_id, sum(counted)::BIGINT AS n_rows,
         coalesce(sum(loss), 0) / greatest(sum(counted), 1) AS loss,
         sum(correct::INT) / greatest(sum(counted), 1) AS accuracy
  FROM scored GROUP BY split, batch_id
)
"""


@query(f"""
WITH {SCORED_SQL}
SELECT batch_id, sum(counted)::BIGINT AS n_rows, round(coalesce(sum(loss), 0) / greatest(sum(counted), 1), 6) AS loss,
       round(sum(correct::INT)::DOUBLE / greatest(sum(counted), 1), 6) AS accuracy
FROM scored GROUP BY batch_id
""")
def batch_loss_accuracy(spark, sf):
    return _rounded(E.batch_loss_accuracy(E.scored_logits(logits(spark, sf))), "loss", "accuracy")


@query(f"""
WITH {SCORED_SQL}, {BATCHES_SQL},
by_batch AS (
  SELECT split, avg(loss) AS loss, avg(accuracy) AS accuracy, sum(loss * n_rows) / greatest(sum(n_rows), 1) AS row_loss,
         sum(accuracy * n_rows) / greatest(sum(n_rows), 1) AS row_accuracy
  FROM batches GROUP BY split
),
rows_left AS (SELECT * FROM scored WHERE loss_mask = 1),
users AS (SELECT split, uid, avg((prediction = label)::INT::DOUBLE) AS a FROM rows_left WHERE label >= 0 GROUP BY split, uid),
by_user AS (SELECT split, count(*) AS n_users, avg(a) AS user_accuracy FROM users GROUP BY split),
counts AS (
  SELECT split, uid, prediction, count(*) AS n, min((-batch_id) * 16777216 + pos) AS first
  FROM rows_left GROUP BY split, uid, prediction
),
votes AS (
  SELECT split, uid, prediction FROM counts
  QUALIFY row_number() OVER (PARTITION BY split, uid ORDER BY n DESC, first) = 1
),
truth AS (
  SELECT split, uid, (max(label) + CASE WHEN split = 'test' THEN 1 ELSE 0 END) % 3 AS label
  FROM scored WHERE label >= 0 GROUP BY split, uid
),
correct AS (
  SELECT split, avg((prediction = label)::INT::DOUBLE) AS ratio FROM votes JOIN truth USING (split, uid) GROUP BY split
)
SELECT split, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy, round(row_loss, 6) AS row_loss,
       round(row_accuracy, 6) AS row_accuracy, round(user_accuracy, 6) AS user_accuracy, n_users,
       round(ratio, 6) AS correct_users_ratio
FROM by_batch JOIN by_user USING (split) JOIN correct USING (split)
""")
def eval_summary(spark, sf):
    scored = E.scored_logits(logits(spark, sf))
    known = logits(spark, sf).filter("label >= 0").groupBy("split", "uid").agg(F.max("label").alias("m"))
    truth = known.select("split", "uid", ((F.col("m") + F.when(F.col("split") == "test", 1).otherwise(0)) % 3).alias("label"))
    summary = E.eval_summary(scored, truth)
    return _rounded(
        summary, "loss", "accuracy", "row_loss", "row_accuracy", "user_accuracy", "correct_users_ratio"
    )


def _fold_sql(folds: str) -> str:
    return f"""
WITH {VOTES_SQL}, folds AS ({folds}),
joined AS (
  SELECT f.fold, v.prediction, l.label
  FROM folds f LEFT JOIN (SELECT * FROM votes JOIN ({CUSTOMER_LABELS_SQL}) USING (uid)) v USING (uid)
  LEFT JOIN ({CUSTOMER_LABELS_SQL}) l USING (uid)
)
SELECT fold, round(coalesce(avg(CASE WHEN prediction IS NOT NULL THEN (prediction = label)::INT::DOUBLE END), -1), 6)
  AS correct_user_ratio, count(prediction) AS num_users
FROM joined GROUP BY fold
"""


@query(_fold_sql("SELECT o_orderpriority AS fold, o_custkey::VARCHAR AS uid FROM orders"))
def fold_accuracy(spark, sf):
    voted = E.majority_vote(predictions(spark, sf))
    return _rounded(E.fold_accuracy(order_folds(spark, sf), customer_labels(spark, sf), voted), "correct_user_ratio")


@query(_fold_sql("SELECT c_mktsegment AS fold, c_custkey::VARCHAR AS uid FROM customer"))
def fold_accuracy_by_segment(spark, sf):
    voted = E.majority_vote(predictions(spark, sf))
    return _rounded(E.fold_accuracy(segment_folds(spark, sf), customer_labels(spark, sf), voted), "correct_user_ratio")


@query(f"""
WITH {VOTES_SQL}
SELECT round(coalesce(avg((prediction = label)::INT::DOUBLE), -1), 6) AS correct_user_ratio, count(*) AS num_users
FROM votes JOIN ({CUSTOMER_LABELS_SQL}) USING (uid)
""")
def all_user_accuracy(spark, sf):
    voted = E.majority_vote(predictions(spark, sf))
    return _rounded(E.all_user_accuracy(customer_labels(spark, sf), voted), "correct_user_ratio")


@query(f"""
WITH {SCORED_SQL}
SELECT split, count(*) AS n_rows, round(avg((prediction = label)::INT::DOUBLE), 6) AS accuracy FROM scored GROUP BY split
""")
def split_accuracy(spark, sf):
    return _rounded(E.split_accuracy(E.scored_logits(logits(spark, sf))), "accuracy")


@query(f"SELECT batch_id, pos, (list_position(logits, list_max(logits)) - 1)::INT AS prediction FROM ({LOGITS_SQL})")
def argmax_prediction(spark, sf):
    return logits(spark, sf).select("batch_id", "pos", argmax(F.col("logits")).alias("prediction"))


@query(f"WITH {SCORED_SQL} SELECT batch_id, pos, round(loss, 6) AS loss FROM scored")
def softmax_cross_entropy(spark, sf):
    scored = E.scored_logits(logits(spark, sf))
    return scored.select("batch_id", "pos", F.round("loss", 6).alias("loss"))
