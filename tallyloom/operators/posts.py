"""Operators on posts: `(row_idx, uid, tid, text)`, ordered by an integer unique in the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.config import PARTS, UNKNOWN_LABEL
from tallyloom.functions.text import delimiter_for, is_blank
from tallyloom.operators.positions import with_part
from tallyloom.operators.skew import lookup_join
from tallyloom.operators.staging import stage

_ROW_BYTES = 1 << 30  # a value of a row ends at 2 GB


def head_sample(rows: DataFrame, n: int, order: str = "row_idx") -> DataFrame:
    """The first n rows in order."""
    return rows.orderBy(order).limit(n)


def strided_shard(posts: DataFrame, n: int, layout: str = "strided", total: int | None = None) -> DataFrame:
    """The last of n shards by dense `row_idx`; it holds floor(N / n) rows in either layout."""
    if layout == "strided":
        return posts.filter(F.col("row_idx") % n == n - 1)
    if layout == "contiguous":
        total = posts.count() if total is None else total
        return posts.filter(F.col("row_idx") >= total - total // n)
    raise ValueError(f"unknown layout {layout!r}")


def interleaved_order(num_shards: int, order: str = "row_idx") -> Column:
    """Order in which strided shards are merged: by `row_idx % num_shards`, then `row_idx`."""
    return F.col(order) % num_shards * F.lit(1 << 48) + F.col(order)


def filter_posts_by_uid(posts: DataFrame, uids: DataFrame, measured: tuple[int, int] | None = None) -> DataFrame:
    """Posts of listed users. `measured` is the size of the list where it is known."""
    return lookup_join(posts, uids, "uid", "left_semi", measured=measured)


def split_posts_by_uid(posts: DataFrame, uid_split: DataFrame) -> DataFrame:
    """Assign posts to splits by user. One join serves every split.

    A user listed in two splits puts the posts in both; unlisted users are dropped.
    """
    return lookup_join(posts, uid_split.select("uid", "split").distinct(), "uid", "inner")


def label_posts(posts: DataFrame, labels: DataFrame, require_labels: bool = False) -> DataFrame:
    """Add the user's label; -1 for unknown users, or drop them with `require_labels`."""
    joined = lookup_join(posts, labels.select("uid", "label"), "uid", "inner" if require_labels else "left")
    return joined.withColumn("label", F.coalesce(F.col("label"), F.lit(UNKNOWN_LABEL)).cast("int"))


def uid_lookup(posts: DataFrame, part_rows: int = PARTS.numbers) -> DataFrame:
    """Inverted index `(uid, part, row_idxs)`.

    Part p of a user lists the rows at places p * part_rows and on in the user's order; the lists in part
    order make up the whole index entry.
    """
    parts = with_part(posts.select("uid", "row_idx"), "uid", "row_idx", part_rows)
    return parts.groupBy("uid", "part").agg(F.array_sort(F.collect_list("row_idx")).alias("row_idxs"))


def posts_per_user(posts: DataFrame) -> DataFrame:
    return posts.groupBy("uid").agg(F.count(F.lit(1)).alias("n_posts"))


def posts_per_user_all_splits(*splits: DataFrame) -> DataFrame:
    """Counts added over all splits."""
    return posts_per_user(reduce(DataFrame.unionByName, [s.select("uid") for s in splits]))


def unique_users_per_split(posts: DataFrame) -> DataFrame:
    """Two plain aggregations, so one dominating split is deduplicated in parallel."""
    return posts.groupBy("split", "uid").agg(F.lit(1).alias("_")).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_users")
    )


def distinct_users(posts: DataFrame) -> DataFrame:
    return posts.select("uid").distinct()


def union_splits(*splits: DataFrame) -> DataFrame:
    """All rows of data sets with equal columns."""
    return reduce(DataFrame.unionByName, splits)


def export_last_by_uid(processed: DataFrame, splits: list[str] | None = None) -> DataFrame:
    """The model input of each user's last row, over the chosen splits in the given order."""
    splits = splits or ["train", "validation", "test"]
    position = F.coalesce(*[F.when(F.col("split") == s, F.lit(i)) for i, s in enumerate(splits)])
    chosen = processed.filter(F.col("split").isin(splits))
    return chosen.groupBy("uid").agg(
        F.max_by("input_ids", F.struct(position.alias("s"), F.col("row_idx"))).alias("input_ids")
    )


def concat_by_uid(
    posts: DataFrame, delimiter: str = "newline", order: str = "row_idx", part_rows: int = PARTS.texts
) -> DataFrame:
    """All texts of a user in order, each followed by the delimiter: `(uid, part, tid, text)`.

    Missing and empty texts are skipped, users without any text keep an empty row, and `tid` is the id
    of the user's first post. Part p holds the texts at places p * part_rows and on; appended in part order
    they are the whole text.
    """
    tail = delimiter_for(delimiter)
    piece = F.when(~is_blank(F.col("text")), F.concat("text", F.lit(tail)))
    parts = with_part(posts, "uid", order, part_rows, first="tid").select(
        "uid", "part", F.col(order).alias("_ord"), "tid", piece.alias("_piece")
    )
    ordered = F.array_sort(F.collect_list(F.when(F.col("_piece").isNotNull(), F.struct("_ord", "_piece"))))
    return parts.groupBy("uid", "part").agg(
        F.min_by("tid", "_ord").alias("tid"), F.array_join(ordered["_piece"], "").alias("text")
    )


def join_parts(parts: DataFrame, column: str, delimiter: str = "", row_bytes: int = _ROW_BYTES) -> DataFrame:
    """Strings that come in parts `(uid, part, ..., column)` as one row per user, part 0.

    Only what no row can hold goes on: a part that starts at byte n of the user's string is on row n div
    `row_bytes`. Other columns are those of the row's first part. Parts are written once and joined as they
    are, so a task holds one user's parts, not its posts.
    """
    parts = stage(parts)
    if not parts.agg(F.max("part")).first()[0]:
        return parts
    before = W.partitionBy("uid").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length(column).cast("long")).over(before), F.lit(0))
    starts = parts.select(F.col("uid").alias("_uid"), F.col("part").alias("_of"), start.alias("_start"))
    rows = parts.join(starts, F.col("uid").eqNullSafe(F.col("_uid")) & (F.col("part") == F.col("_of")))
    rows = rows.withColumn("_row", F.expr(f"_start div {row_bytes}L"))
    ordered = F.array_sort(F.collect_list(F.when(F.col(column) != "", F.struct("part", column))))[column]
    others = [F.min_by(c, "part").alias(c) for c in parts.columns if c not in ("uid", "part", column)]
    joined = rows.groupBy("uid", "_row").agg(*others, F.array_join(ordered, delimiter).alias(column))
    return joined.withColumnRenamed("_row", "part").select(*parts.columns)
