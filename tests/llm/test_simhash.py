import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tallyloom.config import SizeLimits
from tallyloom.llm import simhash
from tallyloom.llm.common import connected_components
from tallyloom.operators import skew


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_follow_the_definition():
    texts = [None, "", " \t\n", "one", "A b C", "a b c d", "É b c d e É", "w " * 9, " ".join(map(str, range(300)))]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_links_of_tiles_are_complete(components):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    near = [b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for b in base for i, j in rng.integers(0, 60, (20, 2))]
    x = np.unique(np.array(near, dtype=np.uint64))
    want = components(range(len(x)), [(i, j) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 4)])
    i, j = simhash.near_links(x, None, 4, tile=16)
    assert components(range(len(x)), list(zip(i.tolist(), j.tolist()))) == want
    half = len(x) // 2
    i, j = simhash.near_links(x[:half], x[half:], 4, tile=16)
    assert all(np.bitwise_count(x[a] ^ x[b]) <= 4 for a, b in zip(i, j))


def test_components_against_brute_force(documents, components):
    random.seed(3)
    base = [[f"w{random.randrange(500)}" for _ in range(60)] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(4):
            c = list(b)
            c[random.randrange(60)] = "changed"
            texts.append(" ".join(c))
    rows = [(100 + n, t) for n, t in enumerate(texts)] + [(1, texts[0]), (7, None), (8, ""), (9, "  "), (None, texts[3]), (100, texts[0])]
    got = simhash.near_duplicates(documents(rows), block_rows=8).collect()
    assert len(got) == len(rows)
    prints = [plain_fingerprint(t) for _, t in rows]
    edges = [(a, b) for a in set(prints) for b in set(prints) if (a ^ b).bit_count() <= 4]
    label = components(set(prints), edges)
    first = {}
    for (key, _), p in zip(rows, prints):
        if key is not None:
            first[label[p]] = min(first.get(label[p], key), key)
    want = sorted((str(k), np.uint64(p).astype(np.int64).item(), first[label[p]]) for (k, _), p in zip(rows, prints))
    assert sorted((str(r["doc_id"]), r["fp"], r["component"]) for r in got) == want
    assert {r["doc_id"]: r["component"] for r in got}[9] == 7  # no words: fingerprint zero, linked like any other


def test_keep_one_keeps_columns_and_one_row(documents):
    table = documents([(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (9, "z y x w v u")])
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "9", "None"]


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    assert simhash.keep_one(documents([])).collect() == []


def test_connected_components(spark, components):
    random.seed(5)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(130)] + [(n, n + 1) for n in range(300, 340)] + [(7, 7), (None, 3)]
    frame = spark.createDataFrame(edges, "a long, b long")
    whole = [(a, b) for a, b in edges if a is not None and a != b]
    want = components({x for e in whole for x in e}, whole)
    assert {r["id"]: r["component"] for r in connected_components(frame).collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_keep_one_links_by_similarity(documents, components):
    rng = random.Random(11)
    rows = []
    for n in range(30):
        base = [f"w{rng.randrange(9_000)}" for _ in range(rng.choice([9, 30, 120]))]
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randrange(1, 1 + len(base) // 25 + 1)):
                copy[rng.choice([0, -1, rng.randrange(len(copy))])] = f"x{rng.randrange(9_000)}"
            rows.append((len(rows), " ".join(copy)))
    words = [t.split() for _, t in rows]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in words]
    share = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in range(len(rows)) for b in range(a)]
    label = components(range(len(rows)), [(a, b) for a, b, s in share if s >= 0.8])
    assert sum(0.8 <= s < 0.9 for *_, s in share) > 10 and sum(0.6 < s < 0.8 for *_, s in share) > 10
    got = sorted(r["doc_id"] for r in simhash.keep_one(documents(rows), recall=0.999999, block_rows=16).collect())
    assert got == sorted(set(label.values()))


def test_radius_is_calibrated():
    rng = np.random.default_rng(5)
    radius, missed = simhash.calibrated_radius(64, 0.8, 0.0025), 0
    for _ in range(2_000):
        x = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        a, b = x[:90], np.concatenate([x[:80], x[90:]])  # similarity 0.8
        missed += np.bitwise_count(simhash.wide_fingerprint(a)[0] ^ simhash.wide_fingerprint(b)[0]) > radius
    assert missed <= 10 and radius < 32


def test_rows_that_share_an_id_are_reduced_by_a_defined_order(documents):
    rows = [(7, f"text {c} of one id " * 4) for c in "zbaq"] + [(8, "another text " * 9), (None, "no id"), (None, "no id")]
    for parts in (1, 3, 7):
        kept = {(r["doc_id"], r["text"]) for r in simhash.keep_one(documents(rows).repartition(parts)).collect()}
        assert kept == {(7, "text a of one id " * 4), (8, "another text " * 9), (None, "no id")}


def test_near_dedup_beyond_the_broadcast_bounds(documents, monkeypatch):
    """Every lookup of the stage is shuffled, with salted keys."""
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghijklmnop") * 3 + str(rng.randint(0, 400)) for _ in range(60)) for _ in range(12)]
    rows = [(i, base[i % 12] + (" extra" if i % 5 == 0 else "")) for i in range(60)]
    plain = sorted(r["doc_id"] for r in simhash.keep_one(documents(rows)).collect())
    tiny = SizeLimits(broadcast_rows=0, broadcast_bytes=0, group_rows=2, literal_keys=0)
    monkeypatch.setattr(simhash, "_SETS", tiny)
    monkeypatch.setattr(simhash, "lookup_join", lambda *a, **k: skew.lookup_join(*a, **{**k, "limits": tiny}))
    assert sorted(r["doc_id"] for r in simhash.keep_one(documents(rows)).collect()) == plain == list(range(12))


def test_parities_never_exclude_a_link():
    rng = np.random.default_rng(8)
    for size in (1, 5, 31, 32, 33, 300, 3_000):
        for share in (0.0, 0.05, 0.3, 1.0):
            x = np.unique(rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64))
            a = x[:size]
            b = np.concatenate([a[int(share * size):], x[size:size + int(rng.uniform(0.5, 1.5) * share * size)]])
            odd = [simhash.parities(a), simhash.parities(b)]
            rows = simhash.folded(odd, min(map(len, odd)))
            assert np.bitwise_count(rows[0] ^ rows[1]).sum() <= len(np.setxor1d(a, b))


def test_groups_below_the_similarity_make_no_square_of_candidates(documents):
    rng = random.Random(12)
    base = [f"w{n}" for n in range(100)]
    rows = []
    for n in range(120):
        text = list(base)
        for at in rng.sample(range(100), 2):
            text[at] = f"x{n}_{at}"
        rows.append((n, " ".join(text)))
    sets = [set(simhash.shingle_set(t).tolist()) for _, t in rows]
    links = {(a, b) for a in range(120) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    prints = simhash.sketches(documents(rows), "doc_id", "text", 5).withColumnRenamed("node", "component").withColumn("node", F.col("doc_id"))
    radius, wide = simhash.calibrated_radius(64, 0.8, 1e-9), simhash.calibrated_radius(256, 0.8, 1e-9)
    near = {(max(r), min(r)) for r in simhash.closest_nodes(prints, radius, wide, 0.8, 256, 64).select("a", "b").collect()}
    assert links and links <= near and len(near) < 120 * 119 / 2 / 5
