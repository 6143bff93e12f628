"""Joins that hold when one key owns a large share of all rows.

`lookup_join` enriches a fact table from a keyed table. The keyed side is measured; it is broadcast below a
bound and otherwise shuffled with oversized keys salted. `heavy_keys` finds the oversized keys.

Oversized keys are found by one aggregation on the key column (map-side combined, so it costs a
column scan and one small shuffle). Salts are hashes of row content, never random: a retried task
must send its rows to the same place.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.config import LIMITS, SizeLimits
from tallyloom.operators.staging import stage


_MARK_SALTS = 64


def _atomic(df: DataFrame) -> list[str]:
    nested = (T.ArrayType, T.MapType, T.StructType)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]


def _width(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    dtype = field.dataType
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + F.lit(16)
    if isinstance(dtype, T.ArrayType) and not isinstance(
        dtype.elementType, (T.StringType, T.ArrayType, T.StructType, T.MapType)
    ):
        return F.greatest(F.size(column), F.lit(0)) * F.lit(8) + F.lit(16)
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + F.lit(16)
    return F.lit(8)


def fresh(name: str, *frames: DataFrame) -> str:
    """`name`, with underscores in front until no frame has such a column; column names ignore case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_width(df: DataFrame) -> Column:
    """Approximate bytes of a row in memory."""
    total = F.lit(0).cast("long")
    for field in df.schema.fields:
        total = total + _width(field).cast("long")
    return total


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a table, counted by one aggregation."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row_width(df)).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def stage_measured(df: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """Write an expensive lookup once, then measure the written table."""
    table = stage(df)
    return table, measure(table)


@dataclass(frozen=True)
class HeavyKeys:
    """Keys whose groups exceed a bound.

    With too many to inline they are in `table`; `values` then tells only whether the missing key is one.
    """

    key: str
    values: tuple
    table: DataFrame | None
    max_rows: int
    max_width: int

    def __bool__(self) -> bool:
        return self.table is not None or self.max_rows > 0

    def mark(self, df: DataFrame, name: str = "_heavy") -> DataFrame:
        """Add a boolean column: does the row belong to an oversized group? `name` must be free."""
        known = [v for v in self.values if v is not None]
        flag = F.col(self.key).isin(known) if known else F.lit(False)
        if None in self.values:
            flag = F.col(self.key).isNull() | flag
        if self.table is None:
            return df.withColumn(name, F.coalesce(flag, F.lit(False)))
        listed = fresh("_listed", df)
        flag = F.col(listed).isNotNull() | flag
        return self._join_listed(df, listed).withColumn(name, F.coalesce(flag, F.lit(False))).drop(listed)

    def _join_listed(self, df: DataFrame, name: str) -> DataFrame:
        """At most rows / bound keys are listed. Beyond the broadcast bound every key is salted."""
        listed = self.table.select(F.col("_group").alias(self.key), F.lit(True).alias(name))
        rows, size = measure(listed)
        if rows <= LIMITS.broadcast_rows and size <= LIMITS.broadcast_bytes:
            return df.join(F.broadcast(listed), self.key, "left")
        salt = fresh("_salt", df)
        repeated = listed.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(_MARK_SALTS - 1))))
        salted = df.withColumn(salt, F.pmod(F.xxhash64(*_atomic(df)), F.lit(_MARK_SALTS)).cast("int"))
        return salted.join(repeated, [self.key, salt], "left").drop(salt)


def _sizes(df: DataFrame, key: str, weight: Column | None) -> DataFrame:
    """Sizes by `_group`, the key under a name that cannot clash with those of the sizes."""
    weight = F.lit(0).cast("long") if weight is None else weight.cast("long")
    groups = df.select(F.col(key).alias("_group"), weight.alias("_weight")).groupBy("_group")
    return groups.agg(F.count(F.lit(1)).alias("n"), F.sum("_weight").alias("b"), F.max("_weight").alias("m"))


def group_sizes(df: DataFrame, key: str, weight: Column | None = None) -> DataFrame:
    """Rows `n`, bytes `b` and widest row `m` of each group."""
    if key.lower() in ("n", "b", "m"):
        raise ValueError(f"the key {key!r} has the name of a size")
    return _sizes(df, key, weight).withColumnRenamed("_group", key)


def heavy_keys(
    df: DataFrame,
    key: str,
    weight: Column | None = None,
    limits: SizeLimits = LIMITS,
    sizes: DataFrame | None = None,
) -> HeavyKeys:
    """Find groups with more rows, or more bytes of `weight`, than one task should collect.

    `sizes` are the group sizes where a caller already has them.
    """
    sizes = _sizes(df, key, weight) if sizes is None else sizes.withColumnRenamed(key, "_group")
    groups = sizes.filter((F.col("n") > limits.group_rows) | (F.col("b") > limits.group_bytes))
    found = groups.take(limits.literal_keys + 1)
    if len(found) <= limits.literal_keys:
        return HeavyKeys(
            key,
            tuple(r["_group"] for r in found),
            None,
            max((r["n"] for r in found), default=0),
            max((r["m"] or 0 for r in found), default=0),
        )
    table = stage(groups)
    top = table.agg(
        F.max("n").alias("n"), F.max("m").alias("m"), F.count_if(F.col("_group").isNull()).alias("missing")
    ).first()
    return HeavyKeys(key, (None,) if top["missing"] else (), table, top["n"], top["m"] or 0)


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    how: str = "inner",
    spread: Sequence[str] = (),
    limits: SizeLimits = LIMITS,
    measured: tuple[int, int] | None = None,
    expensive: bool = False,
) -> DataFrame:
    """Join facts to a keyed table: inner, left, left_semi or left_anti.

    The keyed side is measured first. Small: broadcast, the facts are not shuffled. Large: shuffle
    join; rows of oversized keys, and rows without a key, are salted over several tasks by a hash of
    the `spread` columns (default: all atomic columns), and the matching lookup rows are repeated.
    A caller that joins one lookup several times passes its size as `measured`. Finding the oversized keys
    reads the facts once more: `expensive` facts, the result of a job, are written before that.
    """
    if how in ("left_semi", "left_anti"):
        lookup = lookup.select(key).distinct()
    rows, size = measured or measure(lookup)
    if rows <= limits.broadcast_rows and size <= limits.broadcast_bytes:
        return facts.join(F.broadcast(lookup), key, how)
    if expensive:
        facts = stage(facts)
    heavy = heavy_keys(facts, key, limits=limits)
    if not heavy:
        return facts.join(lookup, key, how)
    columns = list(spread) or _atomic(facts)
    fan = int(-(-heavy.max_rows // limits.group_rows))
    flag, salt = fresh("_heavy", facts, lookup), fresh("_salt", facts, lookup)
    place = F.pmod(F.xxhash64(*columns), F.lit(fan)).cast("int")
    salted = (
        heavy.mark(facts, flag)
        .withColumn(salt, F.when(F.col(flag) | F.col(key).isNull(), place).otherwise(F.lit(0)))
        .drop(flag)
    )
    repeated = (
        heavy.mark(lookup, flag)
        .withColumn(salt, F.explode(F.sequence(F.lit(0), F.when(F.col(flag), fan - 1).otherwise(0))))
        .drop(flag)
    )
    joined = salted.join(repeated, [key, salt], how).drop(salt)
    order = facts.columns if how in ("left_semi", "left_anti") else facts.columns + [
        c for c in lookup.columns if c != key
    ]
    return joined.select([key] + [c for c in order if c != key])
