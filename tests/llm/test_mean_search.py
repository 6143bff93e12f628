"""Centroid clustering against a plain version in Python integers."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from tallyloom.llm.mean_search import CLUSTER_SQL, cluster, search


def brute(rows, k=16, rounds=3, size=64, scale=64):
    kept = [
        (i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(x) * scale < 1 << 27 for x in v)
    ]
    named = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, own in groups.items():
            centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)) for i, v in kept]
    per = {}
    for _, d, n in found:
        per[n] = per.get(n, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, per[n], sum(per.values()), sha[n]) for i, d, n in found), key=str)


def made(n=300, seed=2):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (9, 64))
    rows = [(i, (middles[i % 9] + rng.normal(0, 0.3, 64)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[4][1]) for i in range(150)]  # one vector owns a third
    rows += [(2000, [0.0] * 64), (2000, [0.0] * 64), (None, rows[0][1]), (2003, [1.0] * 64), (2004, [-0.001] * 64)]
    rows += [(3000, None), (3001, []), (3002, [1.0] * 63), (3003, [None] + [1.0] * 63), (3004, [math.nan] * 64),
             (3005, [math.inf] + [0.0] * 63), (3006, [1e30] * 64)]
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_plain_version(vectors, parts):
    rows = made()
    got = cluster(vectors(rows).repartition(parts)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_sql_equals_plain_version(vectors):
    rows = [r for r in made() if r[0] != 3006]
    table = vectors(rows).select("vec_id", "embedding").toArrow()  # noqa: F841
    with duckdb.connect() as con:
        con.register("embeddings", table)
        got = con.execute(CLUSTER_SQL).fetchall()
    assert sorted(got, key=str) == brute(rows)


def test_search_is_exact_and_leaves_centroids_out():
    rng = np.random.default_rng(0)
    centroids = np.concatenate([rng.integers(-60, 60, (40, 64)) + rng.integers(-300, 300, (40, 1)), np.full((3, 64), 7)])
    x = np.concatenate([centroids[rng.integers(0, 43, 500)] + rng.integers(-9, 9, (500, 64)), centroids, (centroids[:10] + centroids[10:20]) // 2])
    near, distance, computed = search(x, centroids)
    every = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert np.array_equal(near, every.argmin(axis=1)) and np.array_equal(distance, every.min(axis=1))
    assert computed < every.size / 4


def test_search_of_large_numbers_keeps_ties():
    x = np.full((1, 4), (1 << 27) - 1)
    centroids = np.array([[-(1 << 27) + 1] * 4, [0] * 4, [0] * 4, [(1 << 27) - 2] * 4])
    assert search(x, centroids)[0].tolist() == [3] and search(x, centroids[:3])[0].tolist() == [1]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5] * 64)], [(1, [0.5] * 64), (2, [0.5] * 64), (3, [0.25] * 64)]])
def test_few_vectors(vectors, rows):
    got = cluster(vectors(rows or [(1, [0.0])])).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
