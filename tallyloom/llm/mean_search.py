"""Centroid clustering by equal-average equal-variance nearest-neighbour search, in exact integers.

Centroids are sorted by the sum of their components. A vector starts at its own sum and looks outwards, the
closer side first. With n components, sums S and deviations D (root of the summed squares about the mean),
    |x - c|^2 >= (S_x - S_c)^2 / n + (D_x - D_c)^2.
Once the first term alone exceeds the best distance, so it does for all centroids further out and the
search ends; where both terms exceed it, that centroid is left out. What is left is compared in integers,
ties go to the smaller number. The bounds are floating-point numbers with a margin above their rounding
error, so they never reject a centroid that is as near as the best.

A round reads the table once. Each task adds up its vectors per cluster and returns one row per cluster; the
driver holds centroids and sums only, k rows of n numbers whatever the data size. Integer sums do not
depend on the partitioning.

Defined cases: vectors that are null, have another number of components, or hold null or non-finite ones take
no part, nor do those whose scaled components reach 2^27, as their squared distance does not fit a
long; a null id counts as the empty text in the choice of the first centroids; repeated rows are vectors of
their own; with fewer vectors than centroids there are as many centroids as vectors; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import tidy
from tallyloom.llm.vectors import sound
from tallyloom.operators.staging import stage

_REACH = 1 << 27  # scaled components below this have squared distances that fit a long
_SLACK = 1e-11  # above the relative rounding error of sums and deviations
_SLICE = 8_192


def kept(column: str, size: int, scale: int):
    """Does the vector take part?"""
    near = F.forall(column, lambda x: F.abs(x.cast("double")) * scale < _REACH)
    return sound(column) & (F.size(column) == size) & F.coalesce(near, F.lit(False))


def scaled(column: pa.Array, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows take part, their components as integers)."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), size), False)
    flat = column.filter(fits).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = flat.reshape(-1, size)
    good = (np.isfinite(x) & (np.abs(x) * scale < _REACH)).all(axis=1)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))[good]
    return rows, np.floor(x[good] * scale).astype(np.int64)


def _profile(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and deviations of vectors."""
    sums = x.sum(axis=1).astype(np.float64)
    return sums, np.sqrt(((x - sums[:, None] / x.shape[1]) ** 2).sum(axis=1))


def search(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of the nearest centroid of each vector, and how many distances were computed."""
    k, n = centroids.shape
    sums, spread = _profile(centroids)
    number = np.argsort(sums, kind="stable")
    sums, spread, c = sums[number], spread[number], centroids[number]
    own, deviation = _profile(x)
    right = np.searchsorted(sums, own)
    left = right - 1
    best = np.full(len(x), np.iinfo(np.int64).max)
    found = np.full(len(x), k)
    rows, computed = np.arange(len(x)), 0
    while len(rows):
        at_left, at_right = left[rows], right[rows]
        below = np.where(at_left >= 0, own[rows] - sums[np.maximum(at_left, 0)], np.inf)
        above = np.where(at_right < k, sums[np.minimum(at_right, k - 1)] - own[rows], np.inf)
        gap = np.minimum(below, above)
        bar = best[rows] + 0.5
        going = np.isfinite(gap) & (gap**2 / n * (1 - _SLACK) <= bar)
        rows, gap, bar, lower = rows[going], gap[going], bar[going], (below <= above)[going]
        at = np.where(lower, at_left[going], at_right[going])
        left[rows[lower]] -= 1
        right[rows[~lower]] += 1
        apart = np.maximum(np.abs(deviation[rows] - spread[at]) - _SLACK * (deviation[rows] + spread[at]), 0)
        open_ = (gap**2 / n + apart**2) * (1 - _SLACK) <= bar
        asked, at = rows[open_], at[open_]
        distance = ((x[asked] - c[at]) ** 2).sum(axis=1)
        computed += len(asked)
        better = (distance < best[asked]) | ((distance == best[asked]) & (number[at] < found[asked]))
        best[asked[better]], found[asked[better]] = distance[better], number[at[better]]
    return found, best, computed


def first_centroids(vectors: DataFrame, k: int, size: int, scale: int, seed: str, key: str, vector: str) -> np.ndarray:
    """The scaled vectors with the smallest hashes of seed and id, in the order of the hashes."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    chosen = vectors.filter(kept(vector, size, scale)).select(digest.alias("h"), whole.alias("x")).orderBy("h", "x").limit(k)
    return np.array([r["x"] for r in chosen.collect()], dtype=np.int64).reshape(-1, size)


def _summed(vectors: DataFrame, centroids: np.ndarray, scale: int, vector: str) -> dict[int, tuple[int, list[int]]]:
    """Vectors and component sums of each cluster."""
    k, size = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, size), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            _, x = scaled(batch.column("x"), size, scale)
            near, _, _ = search(x, centroids)
            order = np.argsort(near, kind="stable")
            starts = np.flatnonzero(np.diff(near[order], prepend=-1))
            if len(x):
                sums[near[order][starts]] += np.add.reduceat(x[order], starts, axis=0)
            counts += np.bincount(near, minlength=k)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {"cluster": used.astype(np.int32), "n": counts[used], "sums": pa.array(sums[used].tolist(), pa.list_(pa.int64()))}
        )

    parts = vectors.select(F.col(vector).alias("x")).mapInArrow(tidy(add, _SLICE), "cluster int, n long, sums array<long>")
    # Decimals: sums over a very large table may exceed a long.
    totals = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(size)]
    return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) for i in range(size)])
            for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect()}


def fit(vectors: DataFrame, k: int, rounds: int, size: int, scale: int, seed: str = "1", key: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Centroids after a number of rounds; an empty cluster keeps its centroid."""
    centroids = first_centroids(vectors, k, size, scale, seed, key, vector)
    for _ in range(rounds if len(centroids) else 0):
        for cluster, (n, sums) in _summed(vectors, centroids, scale, vector).items():
            centroids[cluster] = [s // n for s in sums]
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, scale: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`(key, cluster, distance)`: the nearest centroid of each vector that takes part."""
    size = centroids.shape[1]
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("x"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = scaled(batch.column("x"), size, scale)
            near, distance, _ = search(x, centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(at)), pa.array(near.astype(np.int32)), pa.array(distance)],
                names=["key", "cluster", "distance"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    near = rows if len(centroids) else rows.limit(0)
    return near.mapInArrow(tidy(nearest, _SLICE), f"key {kind}, cluster int, distance long").withColumnRenamed("key", key)


def cluster(
    vectors: DataFrame,
    k: int = 16,
    rounds: int = 3,
    size: int = 64,
    scale: int = 64,
    seed: str = "1",
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """`(key, cluster, distance, cluster_inertia, inertia, centroid_sha256)` of each vector that takes part."""
    centroids = fit(vectors, k, rounds, size, scale, seed, key, vector)
    assigned = stage(assign(vectors, centroids, scale, key, vector))
    inertia = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    facts = [
        (i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for i, c in enumerate(centroids.tolist())
    ]
    described = vectors.sparkSession.createDataFrame(
        facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    # k rows, so broadcasting them is safe.
    return assigned.join(F.broadcast(described), "cluster").select(
        key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _round_sql(n: int) -> str:
    """Assignment to the centroids c{n} and the centroids c{n+1} after it."""
    return f"""
a{n} AS (
  SELECT r, v, cluster, distance FROM (
    SELECT r, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance,
           row_number() OVER (PARTITION BY r ORDER BY distance, cluster) AS place FROM kept, c{n}
  ) WHERE place = 1
), m{n} AS (
  SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (
    SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}
  ) GROUP BY cluster, i
), u{n} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM m{n} GROUP BY cluster
), c{n + 1} AS (SELECT cluster, coalesce(u{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN u{n} USING (cluster)
), """


CLUSTER_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INTEGER AS cluster, v AS c
  FROM kept ORDER BY cluster LIMIT 16
), {"".join(_round_sql(n) for n in range(4))} described AS (
  SELECT cluster, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM c3
)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a3 JOIN kept USING (r) JOIN described USING (cluster)
"""
