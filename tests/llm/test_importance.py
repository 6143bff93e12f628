"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tallyloom.llm.importance import RESAMPLE_SQL, gain_planes, resample, summed_gains

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, run):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return words, [" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, run=1, buckets=10_000, percent=10, min_words=20):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s = Counter(bucket(f) for r in rows for f in features(r[1], run)[1])
    t = Counter(bucket(f) for text in target for f in features(text, run)[1])
    ss, tt = sum(s.values()), sum(t.values())
    out, able = [], []
    for at, (doc, text) in enumerate(rows):
        words, found = features(text, run)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in map(bucket, found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(words) >= min_words:
            able.append(at)
    able.sort(key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0))
    for place, i in enumerate(able[: percent * len(able) // 100], 1):
        out[i][4] = place
    return sorted(map(tuple, out), key=str)


def made(n=150, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "naïve", "ÀB", "中文", "x_y", "don't"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    rows += [(n + i, "Same words here, again and again. " * 5) for i in range(80)]
    rows += [(None, None), (None, " ".join(vocabulary)), (900, ""), (901, "!? -- \n"), (902, "often " * 5000), (903, "Été été  x" * 9)]
    return rows, [" ".join(rng.choice(vocabulary[:90]) for _ in range(50)) for _ in range(5)] + [None, ""]


@pytest.fixture
def target(spark):
    return lambda texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


@pytest.mark.parametrize("run,buckets", [(1, 10_000), (2, 100)])
def test_equals_plain_version(documents, target, run, buckets):
    rows, texts = made()
    got = resample(documents(rows).repartition(4), target(texts), run=run, buckets=buckets, percent=30).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, texts, run, buckets, 30)


def test_sql_equals_plain_version(documents, target):
    rows, texts = made()
    with duckdb.connect() as con:
        con.register("documents", documents(rows).select("doc_id", "text").toArrow())
        con.register("benchmark", target(texts).toArrow())
        got = con.execute(RESAMPLE_SQL).fetchall()
    assert sorted(got, key=str) == brute(rows, texts)


def test_repeated_rows_are_documents_of_their_own(documents, target):
    rows = [(5, "many words of a text " * 6)] * 40
    got = resample(documents(rows).repartition(3), target(["a text"])).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]
    assert len({(r["weight"], r["score"]) for r in got}) == 1


def test_empty_tables(documents, target):
    rows, _ = made(9)
    assert resample(documents(rows).filter("doc_id = -1"), target(["a"])).count() == 0
    got = resample(documents(rows), target([])).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, [])


def test_planes_give_exact_sums():
    rng = np.random.default_rng(1)
    for buckets in (1, 63, 64, 1000):
        gains = rng.integers(-9000, 9000, buckets)
        found = [rng.integers(0, buckets, n) for n in (0, 1, 5, 70, 4000)] + [np.full(1 << 13, buckets - 1)]
        got = summed_gains(found, gain_planes(gains), buckets)
        assert got.tolist() == [int(gains[f].sum()) for f in found]
    assert summed_gains([np.array([0])], gain_planes(np.zeros(4, dtype=np.int64)), 4).tolist() == [0]
