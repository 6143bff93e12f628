"""Operators on label files: one row per labelled user, `(row_idx, label, screen_name, uid)`.

Label tables are ordered by `row_idx`, an integer unique in the table (dense or not).
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.config import LIMITS, LabelConfig
from tallyloom.functions.hashing import seeded_digest
from tallyloom.operators.rowindex import digests_at_ranks, hash_order_index, row_index, value_at_rank
from tallyloom.operators.skew import lookup_join, stage_measured
from tallyloom.operators.staging import stage, stage_counted


# --- rows and fields -------------------------------------------------------------------------


def uid_of_line(line: Column) -> Column:
    """User id of a raw label line: its last comma field, without line ends."""
    return F.regexp_replace(F.element_at(F.split(line, ","), -1), r"\n+$", "")


def label_of_line(line: Column) -> Column:
    """Label of a raw label line: its first comma field."""
    return F.element_at(F.split(line, ","), 1)


def nonempty_labels(rows: DataFrame) -> DataFrame:
    """Rows with a label; a missing label counts as empty."""
    return rows.filter(F.col("label") != "")


def labels_last_wins(rows: DataFrame, order: str = "row_idx") -> DataFrame:
    """One label per user: the last row of the file wins."""
    return rows.groupBy("uid").agg(F.max_by("label", order).alias("label"))


def label_precedence(*sources: DataFrame) -> DataFrame:
    """Merge `(uid, label)` tables; a later source overrides an earlier one.

    Each source must hold a user once, as `labels_last_wins` returns it.
    """
    ranked = [s.select("uid", "label", F.lit(i).alias("_source")) for i, s in enumerate(sources)]
    merged = reduce(DataFrame.unionByName, ranked)
    return merged.groupBy("uid").agg(F.max_by("label", "_source").alias("label"))


# --- joins between label files ---------------------------------------------------------------


def exclude_users(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows whose user does not occur in another label file."""
    return lookup_join(rows, others, "uid", "left_anti")


def merge_true_labels(
    screen_names: DataFrame, true_labels: DataFrame, match_missing_names: bool = False
) -> DataFrame:
    """Attach user ids to hand-made labels by screen name, many to many; unlabelled rows are dropped.

    Missing names match each other only with `match_missing_names`.
    """
    labelled = true_labels.dropna(subset=["true_label"])
    if match_missing_names:
        on = screen_names["screen_name"].eqNullSafe(labelled["screen_name"])
        joined = screen_names.join(labelled, on).drop(labelled["screen_name"])
    else:
        joined = lookup_join(labelled, screen_names, "screen_name", "inner")
    return joined.select("true_label", "screen_name", "user_id")


def true_label_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("true_label").agg(F.count(F.lit(1)).alias("n"))


# --- label text to label id ------------------------------------------------------------------


def _dense_rank(distinct: DataFrame, value: str, order: str, name: str) -> DataFrame:
    """Dense 0-based rank of a distinct set: on the driver for a short list of classes, else distributed."""
    head = distinct.select(value, order).take(LIMITS.literal_keys + 1)
    if len(head) > LIMITS.literal_keys:
        return row_index(distinct.select(value, order), order, name=name).select(value, name)
    values = [r[value] for r in sorted(head, key=lambda r: r[order])]
    ranked = pa.table({value: pa.array(values, pa.string()), name: pa.array(range(len(values)), pa.int64())})
    return distinct.sparkSession.createDataFrame(ranked)


def label_dictionary(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """`(label_text, label_id)`: dense ids by first appearance, after the ids already given out."""
    first = nonempty_labels(rows).groupBy("label").agg(F.min("row_idx").alias("_first"))
    start = 0
    if existing is not None:
        top = existing.agg(F.max("label_id").alias("m")).first()["m"]
        start = 0 if top is None else top + 1
        known = existing.select(F.col("label_text").alias("label")).distinct()
        first = first.join(known, "label", "left_anti")
    new = _dense_rank(first, "label", "_first", "_rank").select(
        F.col("label").alias("label_text"), (F.col("_rank") + F.lit(start)).cast("int").alias("label_id")
    )
    if existing is None:
        return new
    return existing.select("label_text", F.col("label_id").cast("int").alias("label_id")).unionByName(new)


def label_dictionary_compat(rows: DataFrame, block: int = 1_000_000) -> DataFrame:
    """Ids as the step-by-step rule gives them: id of the previous kept row plus one.

    Two labels can get the same id. Each label points to the label of the kept row before its first
    appearance; its id is the length of that chain. Chains are resolved by pointer doubling, so the
    number of steps is the logarithm of the number of labels.
    """
    kept = nonempty_labels(rows).select("row_idx", "label").withColumn("_block", F.expr(f"row_idx div {block}L"))
    # Previous kept row, by blocks of the row order: inside a block a window of at most `block` rows,
    # before it the last row of the nearest earlier block (one row per block).
    tails = kept.groupBy("_block").agg(F.max_by("label", "row_idx").alias("_tail"))
    before = tails.select("_block", F.lag("_tail").over(W.orderBy("_block")).alias("_before"))
    inside = F.lag("label").over(W.partitionBy("_block").orderBy("row_idx"))
    previous = kept.withColumn("_prev", inside).join(before, "_block")
    links = stage(
        previous.groupBy("label").agg(
            F.min_by(F.coalesce("_prev", "_before"), "row_idx").alias("up"), F.lit(1).cast("long").alias("hops")
        )
    )
    remaining = links.count()
    while remaining > 1:
        links = stage(
            links.alias("a")
            .join(links.alias("b"), F.col("a.up") == F.col("b.label"), "left")
            .select(
                F.col("a.label"),
                F.col("b.up").alias("up"),
                (F.col("a.hops") + F.coalesce(F.col("b.hops"), F.lit(0))).alias("hops"),
            )
        )
        remaining = (remaining + 1) // 2
    return links.select(F.col("label").alias("label_text"), (F.col("hops") - 1).cast("int").alias("label_id"))


def assign_label_ids(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Replace the label text by its id; all other fields stay."""
    ids = dictionary.select(F.col("label_text").alias("label"), "label_id")
    joined = lookup_join(nonempty_labels(rows), ids, "label", "inner")
    return joined.select(
        *[F.col("label_id").cast("string").alias("label") if c == "label" else F.col(c) for c in rows.columns]
    )


# --- order and splits ------------------------------------------------------------------------


def shuffle_labels(rows: DataFrame, key: str = "row_idx", seed: int = 0, name: str = "shuffled_idx") -> DataFrame:
    """Seeded permutation, as a position column."""
    return hash_order_index(rows, key, seed, name)


def held_out(n: int, ratio: float) -> int:
    """Number of rows that go to the held-out side."""
    return int(n * ratio)


def split_labels(
    rows: DataFrame, ratio: float, names: tuple[str, str] = ("train", "test"), order: str = "row_idx"
) -> DataFrame:
    """Positional split: the last int(n * ratio) rows are held out. Adds `split`.

    Only the order value at the cut is looked up; the rows are neither sorted nor shuffled.
    """
    n = rows.count()
    return _cut(rows, n, held_out(n, ratio), names, order)


def _cut(rows: DataFrame, n: int, out: int, names: tuple[str, str], order: str) -> DataFrame:
    if out == 0:
        return rows.withColumn("split", F.lit(names[0]))
    cut = value_at_rank(rows, order, n - out)
    return rows.withColumn("split", F.when(F.col(order) >= F.lit(cut), names[1]).otherwise(names[0]))


def three_way_split(
    rows: DataFrame, config: LabelConfig = LabelConfig(), key: str = "row_idx", total: int | None = None
) -> DataFrame:
    """Random train / validation / test split in one pass. Adds `split`.

    Rows in permuted order: the last int(n * t) are test, of the rest the last int(rest * v / (1 - t))
    are validation. Two hash values mark the cuts, so no row is sorted or moved.
    """
    digest = seeded_digest(config.seed, F.col(key))
    n = rows.count() if total is None else total
    rest = n - held_out(n, config.test_ratio)
    train = rest - held_out(rest, config.validation_ratio / (1 - config.test_ratio))
    cuts = digests_at_ranks(rows, digest, sorted({train, rest}), n)
    split = F.lit("train")
    if train < rest:
        split = F.when(digest >= cuts[train], "validation").otherwise(split)
    if rest < n:
        split = F.when(digest >= cuts[rest], "test").otherwise(split)
    return rows.withColumn("split", split)


def true_label_split(rows: DataFrame, true_rows: DataFrame, validation_ratio: float) -> DataFrame:
    """Hand-made labels are the test split as they are; everyone else is split by position, unshuffled."""
    others, n = stage_counted(exclude_users(rows, true_rows))  # searched before it is read
    parts = _cut(others, n, held_out(n, validation_ratio), ("train", "validation"), "row_idx")
    test = true_rows.withColumn("split", F.lit("test"))
    return parts.unionByName(test.select(*parts.columns))


def report_split(rows: DataFrame, true_rows: DataFrame, fold_rows: DataFrame) -> DataFrame:
    """Test: users of a fold. Validation: other hand-labelled users. Train: users never labelled by hand."""
    validation = exclude_users(true_rows, fold_rows).withColumn("split", F.lit("validation"))
    train = exclude_users(rows, true_rows).withColumn("split", F.lit("train"))
    test = fold_rows.select(*true_rows.columns).withColumn("split", F.lit("test"))
    return train.unionByName(validation).unionByName(test)


def override_split_source(split_rows: DataFrame, split: str, source: DataFrame) -> DataFrame:
    """Use another label file for one split."""
    kept = split_rows.filter(F.col("split") != split)
    return kept.unionByName(source.withColumn("split", F.lit(split)).select(*split_rows.columns))


def label_split_counts(split_rows: DataFrame) -> DataFrame:
    return split_rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# --- folds -----------------------------------------------------------------------------------


def slice_labels_by_fold(folds: DataFrame, rows: DataFrame) -> DataFrame:
    """The label row of each fold entry, in fold order and with repeats; the last row of a user counts."""
    columns = [c for c in rows.columns if c != "uid"]
    last = rows.groupBy("uid").agg(F.max_by(F.struct(*columns), "row_idx").alias("_row"))
    last, measured = stage_measured(last)
    joined = lookup_join(folds, last, "uid", "inner", spread=("fold", "pos"), measured=measured)
    return joined.select("fold", "pos", "uid", *[F.col("_row." + c).alias(c) for c in columns])


def fold_uids_without_label(folds: DataFrame, rows: DataFrame) -> DataFrame:
    """Fold entries whose user has no label row."""
    return lookup_join(folds, rows, "uid", "left_anti", spread=("fold", "pos"))
