"""What several operators share: tables, splits, written tables and connected components."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.staging import stage, unstage

WORD = r"[^\x20\x09-\x0D]+"  # a word of the contracts: a run without ASCII white space


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def word_count(column: str):
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def bounded_sample(df: DataFrame, rows: int, key: str) -> DataFrame:
    """At most `rows` rows, chosen by a hash of the key: the same on every run and for any partitioning.

    Rows are counted first, so that little more than the sample itself leaves the tasks.
    """
    share = min(1.0, 1.1 * rows / max(1, df.count()))
    hashed = F.xxhash64(key)
    return df.filter(F.pmod(hashed, F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy(hashed, key).limit(rows)


def give_back() -> None:
    """Memory that Arrow and the C library hold free goes back to the system; the library keeps it where it has no such call."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int | None = 1_000):
    """A task function over record batches that gets them in slices of `rows` and gives memory back after each batch.

    Python workers live on after a task; what they keep would add up over the stages of a long job.
    """

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows or max(1, batch.num_rows)):
                yield batch.slice(at, rows)
            give_back()

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(slices(batches))
        finally:
            give_back()

    return inner


def mark_of(df: DataFrame, *columns: str) -> tuple[int, int]:
    """Row count and an order-free checksum, to see whether an iteration changed anything."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.expr(f"bit_xor(xxhash64({', '.join(columns)}))"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for every vertex of an edge.

    Alternating large-star and small-star rounds. Minima are combined map-side, so a vertex with very
    many edges is no bottleneck; every round is written to the shared folder, which cuts the lineage, and
    deleted when the next one is.
    Self loops, repeated edges and null ends do no harm; no edges give an empty table.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    state = stage(pairs.filter("u != v").distinct())
    mark = mark_of(state, "u", "v")
    while mark[0]:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, state = state, stage(moved.union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        unstage(last)
        before, mark = mark, mark_of(state, "u", "v")
        if before == mark:
            break
    named = state.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        state.select("v", "v").distinct()
    )
    named.staged_path = state.staged_path  # for `unstage`
    return named


def local_stars(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between positions of `ids`, reduced to one edge from each id to the smallest of its component."""
    label = np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order] = label
    u, v = rank[a], rank[b]
    while True:
        low = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, u, low)
        np.minimum.at(after, v, low)
        np.minimum.at(after, label[u], low)
        np.minimum.at(after, label[v], low)
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    moved = np.flatnonzero(label != np.arange(len(ids)))
    ordered = ids[order]
    return ordered[moved], ordered[label[moved]]


def crc_mod(key, modulus: int) -> int:
    """Python twin of `crc_remainder`, for tests."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % modulus
