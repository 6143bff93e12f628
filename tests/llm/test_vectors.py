import os
import time

import numpy as np
import pytest

from tallyloom.llm import multi_index, vafile
from tallyloom.operators.staging import release_shuffles

NAN, INF = float("nan"), float("inf")
ODD = [
    (900, None), (901, []), (902, [0.0] * 8), (903, [NAN] + [1.0] * 7), (904, [INF] + [1.0] * 7), (905, [None] + [1.0] * 7),
    (None, [1.0] * 8), (906, [1.0, 2.0]), (907, [1.0, 2.0]), (908, [3.0]),
]


def cloud(rows=160, groups=12, noise=0.1, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, 8))
    x = centres[rng.integers(0, groups, rows)] + noise * rng.standard_normal((rows, 8))
    x[: rows // 3] = x[0]  # a large group of copies
    return [(int(i), [float(np.float32(v)) for v in row]) for i, row in zip(rng.permutation(rows), x)]


def linked(rows, similarity=0.9):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (_, a) in enumerate(good):
        for m, (_, b) in enumerate(good):
            if n != m and len(a) == len(b):
                a64, b64 = np.array(a), np.array(b)
                if a64 @ b64 / np.linalg.norm(a64) / np.linalg.norm(b64) >= similarity:
                    out.append((n, m))
    return good, out


@pytest.mark.parametrize("block_rows", [16, 2_048])
def test_embedding_links_against_brute_force(vectors, components, block_rows):
    rows = cloud() + ODD
    got = {r[0]: tuple(r[1:]) for r in multi_index.near_duplicates(vectors(rows), recall=1.0, block_rows=block_rows).collect() if r[0] is not None}
    good, edges = linked(rows)
    ids = [i for i, _ in good]
    label = components(ids, [(ids[a], ids[b]) for a, b in edges])
    found = sum(got[i][0] for i in ids)
    assert found >= 0.9 * len(edges)
    for n, i in enumerate(ids):
        assert got[i][0] <= sum(a == n for a, _ in edges)
    if found == len(edges):
        assert {i: got[i][1] for i in ids} == label
    for i in (900, 901, 902, 903, 904, 905, 908):
        assert got[i] == (0, i, True)
    assert got[907] == (1, 906, False)


def test_a_pair_found_from_one_side_counts_for_both(vectors, monkeypatch):
    """With few visits many pairs are found from one side only; links and components still agree."""
    rng = np.random.default_rng(9)
    middles = rng.normal(0, 1, (12, 8))
    rows = [(i, (middles[i % 12] + rng.normal(0, 0.4, 8)).tolist()) for i in range(360)] + [(1000 + i, [1.0] * 8) for i in range(5)]
    real = multi_index.fit_grid

    def narrow(*a, **k):
        grid = real(*a, **k | {"per_cell": 2})
        grid.visits = 2
        return grid

    monkeypatch.setattr(multi_index, "fit_grid", narrow)
    got = multi_index.near_duplicates(vectors(rows), block_rows=16).collect()
    sizes = {}
    for r in got:
        sizes[r["component"]] = sizes.get(r["component"], 0) + 1
    assert sum(r["n_links"] for r in got) % 2 == 0 and sum(r["n_links"] for r in got) > 300
    assert all((r["n_links"] > 0) == (sizes[r["component"]] > 1) for r in got)
    assert sum(r["n_links"] for r in got) < len(linked(rows)[1])  # some pairs are missed here


def test_cuts_change_no_link(vectors, monkeypatch):
    """Cells in parts, regions with several tasks, many rounds that are summed up in between, short steps."""
    rows = cloud(150, 5, 0.3) + [(1000 + i, [0.0, 1.0] * 4) for i in range(40)] + [(2000, [-0.0, 1.0] * 4)] + ODD
    rows += rows[100:120] + [(rows[3][0], [5.0] * 8)]  # repeated rows, and an id with two vectors
    whole = sorted(map(str, multi_index.near_duplicates(vectors(rows)).collect()))
    monkeypatch.setattr(multi_index, "_REGION_BYTES", 1)
    monkeypatch.setattr(multi_index, "_TASK_BYTES", 1)
    monkeypatch.setattr(multi_index, "_STEP_BYTES", 500)
    monkeypatch.setattr(multi_index, "_STEP_PAIRS", 7)
    seen, summed = [], []
    real_deal, real_summed = multi_index.Regions.deal, multi_index.summed
    monkeypatch.setattr(multi_index.Regions, "deal", lambda plan, *a: seen.append(real_deal(plan, *a)) or seen.append(plan) or seen[0])
    monkeypatch.setattr(multi_index, "summed", lambda found: summed.append(len(found)) or real_summed(found))
    cut = sorted(map(str, multi_index.near_duplicates(vectors(rows), block_rows=3, region_bytes=800, round_bytes=75_000).collect()))
    rounds, plan = seen
    assert rounds > 1 and max(p.max() for p in plan.parts.values()) > 1 and plan.tasks > len(plan.width) and len(summed) > 1
    assert cut == whole


def test_links_need_a_few_copies_of_the_table_on_disk(spark, vectors, monkeypatch):
    """A vector visits many cells; staged tables and shuffle files stay a small multiple of the vectors."""
    rng = np.random.default_rng(6)
    n, dim = 1_600, 128
    x = rng.standard_normal((n, dim))
    x[: n // 8] = x[n // 8 : n // 4] + 0.05 * x[n // 4 : 3 * n // 8]
    rows = vectors([(i, v) for i, v in enumerate(x.tolist())])
    folders = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def size(top, start=""):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names if f.startswith(start))

    def shuffled():
        return sum(size(d, "shuffle_") for d in folders)

    def settled():
        """Files of earlier steps go soon after `release_shuffles`, not at once."""
        for _ in range(20):
            if shuffled() > before:
                time.sleep(0.1)
        return shuffled()

    release_shuffles(spark)
    time.sleep(1)
    before, staged, peaks, real = shuffled(), [], [], multi_index.stage

    def watched(df):
        now = settled()
        table = real(df)
        staged.append(table.staged_path.removeprefix("file:"))
        peaks.append(sum(size(p) for p in staged if os.path.exists(p)) + shuffled() - min(now, before))
        return table

    monkeypatch.setattr(multi_index, "stage", watched)
    limit = {"round_bytes": 1} if hasattr(multi_index, "Regions") else {}
    found = multi_index.near_duplicates(rows, **limit).collect()
    assert sum(r["n_links"] for r in found) >= 0.95 * 2 * (n // 8)
    assert sorted(peaks)[-2] < 4 * 4 * n * dim  # the collector may miss a step once


def test_embedding_edge_tables(vectors):
    assert multi_index.near_duplicates(vectors([])).collect() == []
    twice = multi_index.near_duplicates(vectors([(3, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [0.0, 1.0])])).collect()
    assert sorted(map(tuple, twice)) == [(3, 1, 3, True), (3, 1, 3, True), (5, 0, 5, True)]


def test_multi_sequence_order():
    rng = np.random.default_rng(4)
    grid = multi_index.Grid(rng.standard_normal((7, 3)), rng.standard_normal((5, 3)))
    u = rng.standard_normal((9, 6))
    for visits in (1, 6, 35):
        i, j = grid.sequence(u, visits)
        for n in range(9):
            d = ((u[n, :3] - grid.first) ** 2).sum(1)[:, None] + ((u[n, 3:] - grid.second) ** 2).sum(1)[None]
            assert np.allclose(np.sort(d.ravel())[:visits], d[i[n], j[n]])


@pytest.mark.parametrize("sizes", [(8, 16), (1_024, 4_096)])
def test_top_k_against_brute_force(vectors, sizes):
    rows = cloud(noise=0.6) + [(150 + 50 * n, [0.5] * 8) for n in range(8)] + ODD
    rows.append(rows[-12])  # a repeated row
    got = sorted(map(tuple, vafile.top_k(vectors(rows), bits=2, query_rows=sizes[0], block_rows=sizes[1]).collect()))
    good = {
        (i, tuple(int(np.floor(256 * x)) for x in v))
        for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)
    }
    want = []
    for i, q in good:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:5])]
    assert got == sorted(want)


def test_top_k_of_few_and_large_numbers(vectors):
    assert vafile.top_k(vectors([])).collect() == []
    got = vafile.top_k(vectors([(0, [1e12, -1e12]), (1, [1e12, 1.0]), (2, [2.0, 2.0])])).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 2)]
