"""Training rows of the two text classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import crc_remainder

FOLDS, HELD_OUT = 4, 2


def held_out(key: str = "doc_id"):
    return crc_remainder(key, FOLDS) == HELD_OUT


def training_labels(labels: DataFrame, target: str, key: str = "doc_id") -> DataFrame:
    """(key, y): one 0/1 label per id of the training folds; contradicting labels go by their mean, ties to 1."""
    known = labels.filter(F.col(key).isNotNull() & F.col(target).isNotNull() & ~held_out(key))
    return known.groupBy(key).agg((F.avg(F.col(target).cast("double")) >= 0.5).cast("int").alias("y"))
