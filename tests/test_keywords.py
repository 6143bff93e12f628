"""Keyword counts with long lists, sparse results and joined texts of many parts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.config import SizeLimits
from tallyloom.functions.text import delimiter_for
from tallyloom.operators import keywords as K
from tallyloom.operators import skew
from tallyloom.operators.posts import concat_by_uid

POSTS = "row_idx long, uid string, tid string, text string"


@pytest.fixture
def posts(spark):
    rng = random.Random(8)
    rows = [
        (i, rng.choice(["hot", "hot", "b", "c", None]), f"t{i}", rng.choice([None, "", " "]) if rng.random() < 0.1 else
         " ".join(rng.choice("kw0 kw1 KW2 kw7 other Σίσυφος".split()) for _ in range(rng.randint(1, 9))))
        for i in range(120)
    ]
    return spark.createDataFrame([*rows, (500, "none", "t500", "nothing here"), (501, "void", "t501", None)], POSTS).repartition(4)


def dense(row, size):
    counts = [0] * size
    for i, n in zip(row["indices"], row["counts"]):
        counts[i] = n
    return counts


@pytest.mark.parametrize("broadcast", [True, False])
def test_sparse_counts_equal_the_literal_form(spark, posts, rows, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(skew.lookup_join, "__defaults__", ("inner", (), SizeLimits(broadcast_rows=0, group_rows=9), None, False))
    asked = ["kw7", "", "kw0", "kw2", "absent", "kw0", "KW2"]
    plain = {r["uid"]: r["input_ids"] for r in K.keyword_counts_by(posts, ["uid"], asked, cap=5).collect()}
    found = K.sparse_keyword_counts_by(posts, ["uid"], K.keyword_table(spark, asked), cap=5, first=("tid", "row_idx")).collect()
    assert {r["uid"]: dense(r, len(asked)) for r in found} == plain
    assert all(r["indices"] == sorted(r["indices"]) and 0 not in r["counts"] for r in found)
    firsts = {r["uid"]: r["tid"] for r in posts.groupBy("uid").agg(F.min_by("tid", "row_idx").alias("tid")).collect()}
    assert {r["uid"]: r["tid"] for r in found} == firsts


def test_first_comes_with_the_counts(posts):
    got = K.keyword_counts_by(posts, ["uid"], ["kw0"], first=("tid", "row_idx"))
    assert got.columns == ["uid", "tid", "input_ids", "attention_mask"]
    firsts = {r["uid"]: r["tid"] for r in posts.groupBy("uid").agg(F.min_by("tid", "row_idx").alias("tid")).collect()}
    assert {r["uid"]: r["tid"] for r in got.collect()} == firsts
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_hundred_thousand_keywords(spark, posts):
    asked = [f"kw{i}" for i in range(100_000)]
    table = K.keyword_table(spark, asked)
    sparse = K.sparse_keyword_counts_by(posts, ["uid"], table)
    assert len(sparse._jdf.queryExecution().optimizedPlan().toString()) < 20_000  # the list is not in the plan
    short = {r["uid"]: r["input_ids"] for r in K.keyword_counts_by(posts, ["uid"], asked[:10]).collect()}
    found = sparse.collect()
    assert {r["uid"]: dense(r, 10) for r in found} == short and max(len(r["indices"]) for r in found) == 4
    whole = K.keyword_counts_by(posts.filter("uid = 'b'"), ["uid"], asked).first()["input_ids"]
    assert len(whole) == 100_000 and whole[:10] == short["b"] and sum(whole[10:]) == 0


@pytest.mark.parametrize("indices,counts,size", [([], [], 3), ([0], [4], 1), ([0, 2, 3], [1, 2, 3], 6), ([5], [9], 6)])
def test_densify(spark, indices, counts, size):
    row = spark.createDataFrame([(indices, counts)], "i array<int>, c array<int>").select(K.densify(F.col("i"), F.col("c"), size).alias("d")).first()
    expected = [0] * size
    for i, n in zip(indices, counts):
        expected[i] = n
    assert row["d"] == expected


@pytest.mark.parametrize("delimiter", ["none", "sep", "newline", "space"])
def test_ten_thousand_parts_are_combined_in_levels(spark, delimiter):
    rng = random.Random(1)
    pieces = ["ap", "ple", "apple", " apple ", "a", "x ", " pie", "pie", " Σ", "Σ ", "b" * 30, "　"]
    texts = {u: [rng.choice(pieces) for _ in range(n)] for u, n in (("huge", 10_000), ("open", 3), ("mid", 700))}
    texts["open"] = ["ap"] * 300 + ["ple"]
    texts["glue"] = ["apple"] * 400
    rows = [(i, u, f"{u}-{i}", t) for u, ts in texts.items() for i, t in enumerate(ts)]
    parts = concat_by_uid(spark.createDataFrame(rows, POSTS), delimiter, part_rows=1)
    asked = ["apple", "pie", "x", "a", "σ", "ς", "pie</s></s>", "apapple", "b" * 30]
    got = {r["uid"]: r for r in K.keyword_counts_of_parts(parts, asked, run=16).collect()}
    tail = delimiter_for(delimiter)
    whole = {u: "".join(t + tail for t in ts) for u, ts in texts.items()}
    joined = spark.createDataFrame(list(whole.items()), "uid string, text string")
    expected = {r["uid"]: r["input_ids"] for r in K.keyword_counts(joined, asked).collect()}
    assert {u: r["input_ids"] for u, r in got.items()} == expected
    assert all(r["tid"] == f"{u}-0" for u, r in got.items())


def test_parts_with_a_long_list(spark):
    rows = [(i, "u", f"t{i}", t) for i, t in enumerate(["k", "w7 kw", "19", " kw3"])]
    parts = concat_by_uid(spark.createDataFrame(rows, POSTS), "none", part_rows=1)
    got = K.keyword_counts_of_parts(parts, [f"kw{i}" for i in range(2_000)]).first()["input_ids"]
    assert {i: n for i, n in enumerate(got) if n} == {7: 1, 19: 1, 3: 1}
