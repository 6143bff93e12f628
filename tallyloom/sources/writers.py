"""Writers. Per-user JSON is written as lines, one user each, so that every task writes its own file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from tallyloom.sources.readers import read_label_jsonl, read_processed


def write_processed(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Processed data set by split."""
    rows.write.mode(mode).partitionBy("split").parquet(path)


def processed(spark, path: str, build: Callable[[], DataFrame], rerun: bool = True) -> DataFrame:
    """Build and save the processed data set, or reuse the saved one."""
    if rerun:
        write_processed(build(), path)
    return read_processed(spark, path)


def _csv(rows: DataFrame, mode: str) -> DataFrameWriter:
    return rows.write.mode(mode).option("header", True)


def _label_lines(rows: DataFrame, *lead: str) -> DataFrame:
    """The lines of a label file as they were read: the header's names and all fields.

    The first field is the label, which a job may have replaced. Without `line` the table's own columns.
    """
    if "line" not in rows.columns:
        return rows.drop("row_idx")
    names = rows.schema["line"].dataType.names
    fields = [F.col("label").alias(names[0])] + [F.col(f"line.`{n}`").alias(n) for n in names[1:]]
    return rows.select(*lead, *fields)


def write_label_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Label file with the header and all fields of the input."""
    _csv(_label_lines(rows), mode).csv(path)


def label_jsonl_to_csv(spark: SparkSession, source: str, path: str) -> int:
    """Label JSON lines to a CSV file; the number of lines is returned."""
    rows = read_label_jsonl(spark, source)
    _csv(rows, "overwrite").csv(path)
    return rows.count()


def write_label_splits(split_rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder of label CSVs per split, written in one job."""
    _csv(_label_lines(split_rows, "split"), mode).partitionBy("split").csv(path)


def write_label_folds(fold_rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder of label CSVs per fold, written in one job."""
    rows = _label_lines(fold_rows, "fold") if "line" in fold_rows.columns else fold_rows.select("fold", "label", "screen_name", "uid")
    _csv(rows, mode).partitionBy("fold").csv(path)


def write_true_labels(merged: DataFrame, path: str, mode: str = "overwrite") -> None:
    _csv(merged.select("true_label", "screen_name", "user_id"), mode).csv(path)


def write_user_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines keyed by user: index, token ids, counts, embeddings or predictions."""
    rows.write.mode(mode).json(path)


def write_label_dictionary(dictionary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The dictionary as one JSON object; it has one entry per label class."""
    entries = dictionary.agg(F.map_from_entries(F.collect_list(F.struct("label_text", "label_id"))).alias("d"))
    entries.select(F.to_json("d")).write.mode(mode).text(path)


def write_model(model, path: str) -> None:
    """Save a fitted MLlib model."""
    model.write().overwrite().save(path)
