"""How the test tables play the roles of posts, labels, predictions and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.readers import read_table

# Keywords of the catalog; the last one never occurs.
KEYWORDS = ["the", "of", "and", "le", "de", "la", "que", "en", "der", "und", "el", "y", "zyxwvut"]
EVENT_CLASSES = ["click", "view", "error", "signup", "purchase"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table. A `documents` table of one small file is dealt to the session's cores before text work."""
    rows = read_table(spark, f"{sf}/{name}.parquet")
    if name == "documents" and len(rows.inputFiles()) == 1:
        return rows.repartition(min(spark.sparkContext.defaultParallelism, 32), "doc_id")
    return rows


def string(name: str):
    return F.col(name).cast("string")


def document_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts of few users with much text: the user is the source. `n_chars` bounds a text's size."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_idx"), F.col("source").alias("uid"), string("doc_id").alias("tid"), "text", "n_chars"
    )


def single_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts with one user per document."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_idx"), string("doc_id").alias("uid"), string("doc_id").alias("tid"), "text"
    )


def sparse_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Document posts in which the text of toxic documents is missing and of low-quality ones empty."""
    marks = table(spark, sf, "labels")
    text = F.when(F.col("toxic") == 1, F.lit(None).cast("string")).when(F.col("quality") == 0, "").otherwise(
        F.col("text")
    )
    return (
        table(spark, sf, "documents")
        .join(marks, "doc_id", "left")
        .select(
            F.col("doc_id").alias("row_idx"), F.col("source").alias("uid"), string("doc_id").alias("tid"),
            text.alias("text"), "n_chars",
        )
    )


SPARSE_SQL = """
SELECT d.doc_id AS row_idx, d.source AS uid, d.doc_id::VARCHAR AS tid,
       CASE WHEN l.toxic = 1 THEN NULL WHEN l.quality = 0 THEN '' ELSE d.text END AS text
FROM documents d LEFT JOIN labels l USING (doc_id)
"""


def turn_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts in turns: the user is the conversation."""
    return table(spark, sf, "conversations").select(
        F.col("turn").alias("row_idx"), string("conv_id").alias("uid"),
        F.concat_ws("-", "conv_id", "turn").alias("tid"), "text",
    )


def order_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Many short posts: the user is the customer."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_idx"), string("o_custkey").alias("uid"), string("o_orderkey").alias("tid"),
        F.col("o_orderpriority").alias("text"),
    )


def label_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Label file: market segment per customer; customers in debt have no label."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("long").alias("row_idx"),
        F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")).alias("label"),
        F.col("c_name").alias("screen_name"),
        string("c_custkey").alias("uid"),
    )


LABEL_ROWS_SQL = """
SELECT c_custkey::BIGINT AS row_idx, CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END AS label,
       c_name AS screen_name, c_custkey::VARCHAR AS uid FROM customer
"""


def true_label_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Hand-made label file: suppliers, whose keys are also customer keys; the class is the nation."""
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("long").alias("row_idx"),
        F.concat(F.lit("NATION_"), string("s_nationkey")).alias("label"),
        F.col("s_name").alias("screen_name"),
        string("s_suppkey").alias("uid"),
    )


TRUE_ROWS_SQL = """
SELECT s_suppkey::BIGINT AS row_idx, 'NATION_' || s_nationkey AS label, s_name AS screen_name,
       s_suppkey::VARCHAR AS uid FROM supplier
"""


def customer_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Integer labels of customers."""
    return table(spark, sf, "customer").select(
        string("c_custkey").alias("uid"), (F.col("c_nationkey") % 5).cast("int").alias("label")
    )


CUSTOMER_LABELS_SQL = "SELECT c_custkey::VARCHAR AS uid, (c_nationkey % 5)::INT AS label FROM customer"


def order_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Folds by order priority; a customer repeats as often as there are orders."""
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("fold"), F.col("o_orderkey").alias("pos"), string("o_custkey").alias("uid")
    )


def segment_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Folds by market segment, every customer once."""
    return table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("fold"), F.col("c_custkey").alias("pos"), string("c_custkey").alias("uid")
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Row predictions in batches of 128: the event type as a class. Errors are padding."""
    return table(spark, sf, "events").select(
        string("user_id").alias("uid"),
        F.expr("event_id div 128").alias("batch_id"),
        (F.col("event_id") % 128).alias("pos"),
        (F.array_position(F.array(*[F.lit(c) for c in EVENT_CLASSES]), F.col("event_type")) - 1)
        .cast("int")
        .alias("prediction"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("loss_mask"),
    )


PREDICTIONS_SQL = """
SELECT user_id::VARCHAR AS uid, event_id // 128 AS batch_id, event_id % 128 AS pos,
       (list_position(['click', 'view', 'error', 'signup', 'purchase'], event_type) - 1)::INT AS prediction,
       CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS loss_mask
FROM events
"""

VOTES_SQL = f"""
preds AS ({PREDICTIONS_SQL}),
counts AS (
  SELECT uid, prediction, count(*) AS n, min((-batch_id) * 16777216 + pos) AS first FROM preds GROUP BY uid, prediction
),
votes AS (
  SELECT uid, prediction, n FROM counts
  QUALIFY row_number() OVER (PARTITION BY uid ORDER BY n DESC, first) = 1
)
"""


def embedded(spark: SparkSession, sf: str) -> DataFrame:
    """Embedded posts: the user is the label."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_idx"), string("label").alias("uid"), "label", "embedding"
    )


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """Three logits per row from the first vector components.

    Rows of label 9 are padding, some rows have no label, and users have rows in two splits.
    """
    parts = F.slice(F.col("embedding").cast("array<double>"), 1, 3)
    return table(spark, sf, "embeddings").select(
        F.expr("vec_id div 128").alias("batch_id"),
        (F.col("vec_id") % 128).alias("pos"),
        F.concat(F.lit("u"), string("label")).alias("uid"),
        parts.alias("logits"),
        F.when(F.col("vec_id") % 17 == 0, -1).otherwise(F.col("label") % 3).cast("int").alias("label"),
        F.when(F.col("label") == 9, 0).otherwise(1).alias("loss_mask"),
        F.when(F.col("vec_id") % 5 == 0, "test").when(F.col("label") < 6, "train").otherwise("validation").alias("split"),
    )


LOGITS_SQL = """
SELECT vec_id // 128 AS batch_id, vec_id % 128 AS pos, 'u' || label AS uid,
       [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE] AS logits,
       CASE WHEN vec_id % 17 = 0 THEN -1 ELSE label % 3 END::INT AS label, CASE WHEN label = 9 THEN 0 ELSE 1 END AS loss_mask,
       CASE WHEN vec_id % 5 = 0 THEN 'test' WHEN label < 6 THEN 'train' ELSE 'validation' END AS split
FROM embeddings
"""

SCORED_SQL = f"""
raw AS ({LOGITS_SQL}),
scored AS (
  SELECT *, (list_position(logits, list_max(logits)) - 1)::INT AS prediction,
         CASE WHEN loss_mask = 1 AND label >= 0 THEN
           list_max(logits) + ln(exp(logits[1] - list_max(logits)) + exp(logits[2] - list_max(logits))
                                 + exp(logits[3] - list_max(logits))) - logits[label + 1] END AS loss,
         (loss_mask = 1 AND list_position(logits, list_max(logits)) - 1 = label) AS correct,
         (loss_mask = 1 AND label >= 0)::INT AS counted
  FROM raw
)
"""


def join_ints(column):
    """An int array as one comparable string."""
    return F.array_join(F.transform(column, lambda v: v.cast("string")), ",")
