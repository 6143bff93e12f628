"""Place of a row inside its group, and parts of bounded length cut by that place.

The rule is the same for every group: part = place in the group div `part_rows`. A group's size decides
only how places are found, never the result.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tallyloom.config import LIMITS, SizeLimits
from tallyloom.operators.rowindex import row_index
from tallyloom.operators.skew import heavy_keys


def _places_of_large(df: DataFrame, key: str, order: str, name: str, first: str | None = None) -> DataFrame:
    """Places inside oversized groups: positions in one range-partitioned order, less the group's smallest.

    One row per oversized group is joined back. With `first`, that column becomes its value in the
    group's first row.
    """
    placed = row_index(df, key, order, name="_global")
    starts = [F.min("_global").alias("_start")] + ([F.min_by(first, "_global").alias("_first")] if first else [])
    groups = placed.groupBy(key).agg(*starts).withColumnRenamed(key, "_key")
    joined = placed.join(groups, F.col(key).eqNullSafe(F.col("_key")))  # skewed rows are split by the adaptive join
    if first:
        joined = joined.withColumn(first, F.col("_first"))
    return joined.withColumn(name, (F.col("_global") - F.col("_start")).cast("long")).select(*df.columns, name)


def group_positions(
    df: DataFrame,
    key: str,
    order: str,
    name: str = "pos",
    limits: SizeLimits = LIMITS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Dense 0-based position of each row inside its group, by an order unique in the group.

    Groups that one task may sort use a window. The rows of oversized groups are sorted by key and order
    over range partitions, whatever the values of the order are.
    """
    heavy = heavy_keys(df, key, limits=limits, sizes=sizes)
    place = (F.row_number().over(W.partitionBy(key).orderBy(order)) - 1).cast("long")
    if not heavy:
        return df.withColumn(name, place)
    marked = heavy.mark(df)
    ordinary = marked.filter(~F.col("_heavy")).drop("_heavy").withColumn(name, place)
    return ordinary.unionByName(_places_of_large(marked.filter("_heavy").drop("_heavy"), key, order, name))


def with_part(
    df: DataFrame, key: str, order: str, part_rows: int, name: str = "part", first: str | None = None, limits: SizeLimits = LIMITS
) -> DataFrame:
    """Add the part of each row: its dense position in the group div `part_rows`.

    Parts sorted by number, each in `order`, give the whole group back; a group of n rows has
    ceil(n / part_rows) parts. Where no group is longer than a part, every part is 0 and nothing is
    sorted. `first` names a column that takes the value of the group's first row, in groups of several parts.
    """
    long = heavy_keys(df, key, limits=replace(limits, group_rows=part_rows, group_bytes=1 << 62))
    if not long:
        return df.withColumn(name, F.lit(0).cast("long"))
    marked = long.mark(df)
    short = marked.filter(~F.col("_heavy")).drop("_heavy").withColumn(name, F.lit(0).cast("long"))
    placed = _places_of_large(marked.filter("_heavy").drop("_heavy"), key, order, "_place", first)
    cut = placed.withColumn(name, F.expr(f"_place div {part_rows}L")).drop("_place")
    return short.unionByName(cut)


def with_sized_part(
    df: DataFrame, key: str, order: str, size: Column, part_rows: int, part_bytes: int, name: str = "part", first: str | None = None
) -> DataFrame:
    """Cut every group into parts of at most `part_rows` rows and, but for their last row, `part_bytes` bytes.

    For groups that are large by rows or by bytes; each is sorted over range partitions. A row's bytes in
    front of it are a prefix sum in two levels: inside blocks of `part_rows` rows, and over the blocks of the
    group. Its place and those bytes, each divided by the bound, both grow along the order, so their sum
    changes wherever one of them does: that is the part. Parts are increasing, the first is 0, numbers may be
    skipped. `first` names a column that takes the value of the group's first row. Null sizes count 0.
    """
    sized = df.withColumn("_size", F.coalesce(size.cast("long"), F.lit(0)))
    placed = _places_of_large(sized, key, order, "_place", first).withColumn("_block", F.expr(f"_place div {part_rows}L"))
    blocks = placed.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_of")).agg(F.sum("_size").alias("_sum"))

    def earlier(column: str, by: WindowSpec) -> Column:
        return F.coalesce(F.sum(column).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    starts = blocks.withColumn("_base", earlier("_sum", W.partitionBy("_key").orderBy("_of"))).drop("_sum")
    inside = earlier("_size", W.partitionBy(key, "_block").orderBy("_place"))
    joined = placed.withColumn("_inside", inside).join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_of")))
    part = F.col("_block") + F.expr(f"(_base + _inside) div {part_bytes}L")
    return joined.withColumn(name, part.cast("long")).select(*df.columns, name)
