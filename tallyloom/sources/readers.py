"""Readers. Ids are always strings; schemas are explicit wherever the format allows it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom import schemas
from tallyloom.operators.labels import labels_last_wins
from tallyloom.operators.rowindex import file_order_index


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table."""
    return spark.read.parquet(path)


def read_posts_csv(spark: SparkSession, path: str, indexed: bool = False, multi_line: bool = False) -> DataFrame:
    """Posts CSV with a header; all columns are kept, `uid`, `tid` and `text` first. Empty text is missing text.

    `multi_line` allows line breaks inside quoted text, at the price of one task per file.
    """
    scan = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    columns = ["uid", "tid", "text"]
    columns += [c for c in scan.columns if c not in columns]
    return file_order_index(scan).select("row_idx", *columns) if indexed else scan.select(*columns)


def read_posts_json(spark: SparkSession, path: str, indexed: bool = False, further: Sequence[str] = ()) -> DataFrame:
    """Posts as JSON lines; missing text stays missing, `created_at` stays as it is written.

    `further` names fields to keep beside the usual ones, as text.
    """
    schema = T.StructType([*schemas.POSTS_JSON.fields, *(T.StructField(c, T.StringType()) for c in further)])
    scan = spark.read.schema(schema).json(path)
    rows = file_order_index(scan) if indexed else scan
    return rows.withColumnsRenamed({"user_id": "uid", "tweet_id": "tid"})


def read_posts(
    spark: SparkSession, path: str, source_format: str = "csv", indexed: bool = False, multi_line: bool = False
) -> DataFrame:
    if source_format == "csv":
        return read_posts_csv(spark, path, indexed, multi_line)
    return read_posts_json(spark, path, indexed)


def read_user_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label CSV by position: first field is the label, last field the user id. Adds `row_idx`.

    `line` holds all fields under the names of the header, for writers that give the file back whole.
    """
    scan = spark.read.option("header", True).csv(path)
    names = scan.columns
    middle = F.col(f"`{names[1]}`") if len(names) > 2 else F.lit(None).cast("string")
    return file_order_index(scan).select(
        "row_idx",
        F.col(f"`{names[0]}`").alias("label"),
        middle.alias("screen_name"),
        F.col(f"`{names[-1]}`").alias("uid"),
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("line"),
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """`(uid, label)` with integer labels; the last row of a user wins."""
    return labels_last_wins(read_user_labels(spark, path)).withColumn("label", F.col("label").cast("int"))


def read_label_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Label JSON lines, columns chosen by what is present: hand-made or classifier labels."""
    rows = spark.read.option("primitivesAsString", True).json(path)
    if "true_label" in rows.columns:
        return rows.select("true_label", "screen_name")
    return rows.select("classifier_label", "screen_name", "UID")


def read_keywords(spark: SparkSession, path: str) -> list[str]:
    """Keyword list: the first comma field of every line without quotes, in file order, repeats kept.

    There is no header. The list is a setting inlined in plans, so it is read on the driver.
    """
    first = F.regexp_replace(F.element_at(F.split("value", ","), 1), '^"+|"+$', "")
    keywords = [r[0] for r in spark.read.text(path).select(first).collect()]
    if not keywords:
        raise ValueError("the keyword list is empty")
    return keywords


def read_screen_names(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated `(screen_name, user_id)`."""
    return spark.read.option("header", True).option("sep", "\t").csv(path).select("screen_name", "user_id")


def _json_object(spark: SparkSession, path: str, dtype: str) -> DataFrame:
    """A file that is one JSON object, as rows `(key, value)`."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{dtype}>")).alias("key", "value"))


def read_folds(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """`(fold, pos, uid)`, order and repeats kept.

    From JSON lines of one fold each, `{"fold": ..., "uids": [...]}`, which are read in parallel, or with
    `layout="object"` from one JSON object of user lists, which is one row of one task.
    """
    if layout == "lines":
        lists = spark.read.schema("fold string, uids array<string>").json(path)
        return lists.select("fold", F.posexplode("uids").alias("pos", "uid"))
    lists = _json_object(spark, path, "array<string>")
    return lists.select(F.col("key").alias("fold"), F.posexplode("value").alias("pos", "uid"))


def read_test_uids(spark: SparkSession, path: str) -> DataFrame:
    """A user id CSV (last field, header skipped) as the single fold with an empty name."""
    scan = spark.read.option("header", True).csv(path)
    return file_order_index(scan).select(
        F.lit("").alias("fold"), F.col("row_idx").cast("int").alias("pos"), F.col(f"`{scan.columns[-1]}`").alias("uid")
    )


def read_label_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """`(label_text, label_id)`; a missing file is an empty dictionary."""
    try:
        entries = _json_object(spark, path, "int")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "label_text string, label_id int")
    return entries.select(F.col("key").alias("label_text"), F.col("value").alias("label_id"))


def read_predictions(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """`(uid, prediction)` from JSON lines, which are read in parallel, or with `layout="object"` from one JSON object."""
    if layout == "lines":
        return spark.read.schema("uid string, prediction int").json(path)
    entries = _json_object(spark, path, "double")
    return entries.select(F.col("key").alias("uid"), F.col("value").cast("int").alias("prediction"))


def read_processed(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A processed data set; one split is read by partition pruning."""
    rows = spark.read.parquet(path)
    return rows if split is None else rows.filter(F.col("split") == split)


def read_user_index(spark: SparkSession, path: str) -> DataFrame:
    """The index written by `write_user_json`: `(uid, part, row_idxs)`."""
    return spark.read.schema("uid string, part long, row_idxs array<long>").json(path)
