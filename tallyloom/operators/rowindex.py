"""Row positions and order statistics on unordered, partitioned data.

No operator here sends all rows through one task: positions come from per-range or per-bucket counts
plus a position inside the range or bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.hashing import digest_int, seeded_digest
from tallyloom.operators.skew import lookup_join
from tallyloom.operators.staging import stage

_HASH_DIGITS = 4  # 65,536 buckets of a uniform hash
_BUCKETS = 65_536
_SMALL_BUCKET = 100_000


def row_index(df: DataFrame, *order: str, name: str = "row_idx") -> DataFrame:
    """Dense 0-based position by a total order.

    Range-partition, sort inside ranges, write once, count per range, add prefix sums. The written
    table fixes the ranges, so a lost executor cannot shift positions. `order` must be unique.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    table = stage(ranged)
    # One row per range partition: as long as the partition count, whatever the data size.
    ranges = table.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    starts = ranges.select(
        "_pid",
        F.coalesce(F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
    )
    return (
        table.join(F.broadcast(starts), "_pid")
        .withColumn(name, (F.col("_start") + F.col("_at")).cast("long"))
        .drop("_pid", "_at", "_start")
    )


def file_row_index(spark: SparkSession, path: str, name: str = "row_idx") -> DataFrame:
    """Natural position of each row of a Parquet data set: files by path, rows as stored. No shuffle."""
    rows = spark.read.parquet(path).select("*", "_metadata.file_path", "_metadata.row_index")
    # One row per file; counted from a single pass over file footers' row positions.
    files = rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("_n"))
    starts = files.select(
        "file_path",
        F.coalesce(F.sum("_n").over(W.orderBy("file_path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(
            "_start"
        ),
    )
    return (
        lookup_join(rows, starts, "file_path", spread=("row_index",))
        .withColumn(name, (F.col("_start") + F.col("row_index")).cast("long"))
        .drop("file_path", "row_index", "_start")
    )


def hash_order_index(df: DataFrame, key: str, seed: int | str, name: str = "perm_idx") -> DataFrame:
    """Position of each row in the seeded permutation of a unique key.

    The hash is uniform, so its leading digits are balanced buckets: count them (65,536 rows however
    large the table), prefix-sum the counts and rank inside a bucket.
    """
    hashed = df.withColumn("_digest", seeded_digest(seed, F.col(key))).withColumn(
        "_bucket", digest_int(F.col("_digest"), _HASH_DIGITS)
    )
    counts = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(
            "_start"
        ),
    )
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy("_digest", key)) - 1
    return (
        hashed.withColumn("_rank", rank)
        .join(F.broadcast(starts), "_bucket")
        .withColumn(name, (F.col("_start") + F.col("_rank")).cast("long"))
        .drop("_digest", "_bucket", "_rank", "_start")
    )


def value_at_rank(df: DataFrame, order: str, rank: int) -> int | None:
    """The value at a 0-based rank of a unique integer column; None past the end.

    Histogram of at most 65,536 equal blocks, then the same inside the block that holds the rank,
    until that block is short. Each pass reads one column and returns a short histogram.
    """
    values = df.select(F.col(order).cast("long").alias("v"))
    bounds = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")).first()
    if rank < 0 or rank >= bounds["n"]:
        return None
    low, high, n = bounds["lo"], bounds["hi"], bounds["n"]
    while n > _SMALL_BUCKET and high > low:
        step = (high - low) // _BUCKETS + 1
        blocks = (
            values.groupBy(F.expr(f"(v - {low}L) div {step}L").alias("b"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        for block in sorted(blocks, key=lambda r: r["b"]):
            if rank < block["n"]:
                low, high, n = low + block["b"] * step, low + (block["b"] + 1) * step - 1, block["n"]
                break
            rank -= block["n"]
        values = values.filter(F.col("v").between(low, high))
    return values.orderBy("v").offset(rank).limit(1).first()["v"]


def digests_at_ranks(df: DataFrame, digest: Column, ranks: list[int], n: int) -> dict[int, str]:
    """The hash values at 0-based ranks of a uniform unique hex digest over n rows.

    Short tables are ranked at once. Otherwise one histogram of leading digits, at most 65,536
    entries, finds the bucket of every rank, and the bucket is searched the same way.
    """
    ranks = [r for r in ranks if 0 <= r < n]
    return _search_digests(df.select(digest.alias("d")), ranks, n, _HASH_DIGITS) if ranks else {}


def _search_digests(values: DataFrame, ranks: list[int], n: int, digits: int) -> dict[int, str]:
    if n <= _SMALL_BUCKET or digits > 32:
        # At most _SMALL_BUCKET rows reach this single sorted task.
        placed = values.withColumn("at", F.row_number().over(W.orderBy("d")) - 1)
        return {r["at"]: r["d"] for r in placed.filter(F.col("at").isin(ranks)).collect()}
    blocks = values.groupBy(F.substring("d", 1, digits).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    found, start = {}, 0
    for block in sorted(blocks, key=lambda r: r["b"]):
        inside = [r - start for r in ranks if start <= r < start + block["n"]]
        if inside:
            bucket = values.filter(F.substring("d", 1, digits) == block["b"])
            hits = _search_digests(bucket, inside, block["n"], digits + _HASH_DIGITS)
            found.update({start + at: d for at, d in hits.items()})
        start += block["n"]
    return found


def file_order_index(scan: DataFrame, name: str = "row_idx") -> DataFrame:
    """Natural position of each row of a fresh text-file scan: files by path, then offset, then line."""
    placed = scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return row_index(placed, "_file", "_block", "_line", name=name).drop("_file", "_block", "_line")
