from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import posts as P
from tallyloom.operators.keywords import keyword_counts, keyword_counts_by, keyword_counts_of_parts

TEXTS = ["ring bring sing", "bring bring king ring", "king sing", "", "RING ring, ring"]


def make(spark, *rows):
    return spark.createDataFrame(list(rows), "row_idx long, uid string, tid string, text string")


@pytest.fixture(scope="module")
def posts(spark):
    return make(
        spark, (0, "a", "t0", None), (1, "b", "t1", "one"), (2, "a", "t2", "two"), (3, "a", "t3", ""),
        (4, "c", "t4", None), (5, "a", "t5", "three"),
    )


def test_words_split_like_unicode_whitespace(spark):
    texts = ["  A b\tC ", "x y\u0085z", "p\x1cq\x0br", "u​v", "", "ÉTÉ à la", "　"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["w"] for r in frame.select("i", X.words(F.col("t")).alias("w")).collect()}
    assert got == {i: t.lower().split() for i, t in enumerate(texts)}


@pytest.mark.parametrize("cap", [-1, 1, 0])
def test_keyword_counts(spark, cap):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    got = keyword_counts(frame, ["ring", "bring"], cap).orderBy("i").collect()
    counts = [[t.lower().split().count(k) for k in ("ring", "bring")] for t in TEXTS]
    assert [r["input_ids"] for r in got] == [[n if cap < 0 else min(cap, n) for n in c] for c in counts]
    assert all(r["attention_mask"] == [1, 1] for r in got)


def test_keyword_counts_summed_over_posts_equal_counts_of_the_joined_text(spark, posts):
    keywords = ["two", "one", "Three", "three", "two"]
    whole = keyword_counts(P.concat_by_uid(posts), keywords)
    expected = {r["uid"]: r["input_ids"] for r in whole.collect()}
    got = {r["uid"]: r["input_ids"] for r in keyword_counts_by(posts, ["uid"], keywords).collect()}
    assert got == expected == {"a": [1, 0, 0, 1, 1], "b": [0, 1, 0, 0, 0], "c": [0, 0, 0, 0, 0]}
    lower = keyword_counts_by(posts, ["uid"], keywords, cap=0, normalize=True)
    assert all(r["input_ids"] == [0] * 5 for r in lower.collect())


@pytest.mark.parametrize("delimiter", ["none", "sep", "newline"])
@pytest.mark.parametrize("part_rows", [1_000, 1, 2])
def test_keyword_counts_over_part_borders(spark, delimiter, part_rows):
    texts = {"a": ["app", "le pie", " apple", "a", "p", "ple x ", "apple"], "b": [None, "pie"], "c": ["p", "i", "e"]}
    rows = [(i, u, f"{u}{i}", t) for u, ts in texts.items() for i, t in enumerate(ts)]
    parts = P.concat_by_uid(make(spark, *rows), delimiter, part_rows=part_rows)
    tail = X.delimiter_for(delimiter)
    keywords = ["apple", "pie", "x", "pie</s></s>"]
    got = {r["uid"]: (r["tid"], r["input_ids"]) for r in keyword_counts_of_parts(parts, keywords).collect()}
    for user, ts in texts.items():
        joined = "".join(t + tail for t in ts if t).lower().split()
        assert got[user] == (f"{user}0", [joined.count(k) for k in keywords])
    capped = keyword_counts_of_parts(parts, ["Apple"], cap=1, normalize=True).filter("uid = 'a'").first()
    assert capped["input_ids"] == [min(1, "".join(t + tail for t in texts["a"]).split().count("apple"))]


def test_empty_keyword_list_is_refused(posts):
    with pytest.raises(ValueError):
        keyword_counts(posts, [])
    with pytest.raises(ValueError):
        keyword_counts_by(posts, ["uid"], [])


def test_shards(spark):
    frame = spark.range(11).withColumnRenamed("id", "row_idx")
    for layout in ("strided", "contiguous"):
        assert P.strided_shard(frame, 2, layout).count() == 5
    assert [r[0] for r in P.strided_shard(frame, 4).orderBy("row_idx").collect()] == [3, 7]
    assert [r[0] for r in P.strided_shard(frame, 4, "contiguous").orderBy("row_idx").collect()] == [9, 10]
    with pytest.raises(ValueError):
        P.strided_shard(frame, 2, "other")


def test_filter_posts_by_uid(spark, posts):
    uids = spark.createDataFrame([("a",), ("a",), ("zz",)], "uid string")
    assert {r["uid"] for r in P.filter_posts_by_uid(posts, uids).collect()} == {"a"}
    assert P.filter_posts_by_uid(posts, uids).count() == 4


def test_user_in_two_splits_lands_in_both(spark, posts):
    split = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "test"), ("b", "test")], "uid string, split string")
    got = P.split_posts_by_uid(posts, split)
    assert {(r["split"], r["uid"]): r["n"] for r in got.groupBy("split", "uid").agg(F.count("*").alias("n")).collect()} == {
        ("train", "a"): 4, ("test", "a"): 4, ("test", "b"): 1,
    }
    assert {r["split"]: r["n_users"] for r in P.unique_users_per_split(got).collect()} == {"train": 1, "test": 2}


def test_unknown_users_get_minus_one(spark, posts):
    labels = spark.createDataFrame([("a", 3)], "uid string, label int")
    got = {r["uid"]: r["label"] for r in P.label_posts(posts, labels).collect()}
    assert got == {"a": 3, "b": -1, "c": -1}
    assert {r["uid"] for r in P.label_posts(posts, labels, require_labels=True).collect()} == {"a"}


def test_uid_lookup_points_back(posts, rows):
    index = P.uid_lookup(posts)
    assert {r["uid"]: r["row_idxs"] for r in index.collect()} == {"a": [0, 2, 3, 5], "b": [1], "c": [4]}
    parts = P.uid_lookup(posts, 2).orderBy("uid", "part").collect()
    assert max(len(r["row_idxs"]) for r in parts) <= 2
    assert [i for r in parts if r["uid"] == "a" for i in r["row_idxs"]] == [0, 2, 3, 5]


def test_post_counts(posts, rows):
    assert rows(P.posts_per_user(posts)) == [("a", 4), ("b", 1), ("c", 1)]
    assert rows(P.posts_per_user_all_splits(posts, posts)) == [("a", 8), ("b", 2), ("c", 2)]
    assert rows(P.distinct_users(posts)) == [("a",), ("b",), ("c",)]
    assert P.union_splits(posts, posts).count() == 12
    assert [r["row_idx"] for r in P.head_sample(posts, 2).collect()] == [0, 1]


def test_concat_keeps_every_user_and_trailing_delimiters(posts, rows):
    assert rows(P.concat_by_uid(posts), "uid", "part", "tid", "text") == [
        ("a", 0, "t0", "two\nthree\n"), ("b", 0, "t1", "one\n"), ("c", 0, "t4", ""),
    ]
    assert rows(P.concat_by_uid(posts, "none"), "uid", "text")[0] == ("a", "twothree")
    assert rows(P.concat_by_uid(posts, "sep"), "uid", "text")[1] == ("b", "one</s></s>")


@pytest.mark.parametrize("part_rows", [1, 2, 3])
def test_concat_continues_on_parts_with_the_first_id_of_the_user(spark, part_rows):
    made = [(n * 100_003, "abc"[n % 3], f"t{n}", None if n % 4 == 0 else "w" * (5_000 if n == 7 else 2)) for n in range(30)]
    posts = spark.createDataFrame(made, "row_idx long, uid string, tid string, text string").repartition(4)
    parts = P.concat_by_uid(posts, part_rows=part_rows).orderBy("uid", "part").collect()
    whole = {}
    for r in parts:
        whole[r["uid"]] = whole.get(r["uid"], "") + r["text"]
        assert r["tid"] == {"a": "t0", "b": "t1", "c": "t2"}[r["uid"]]
    assert whole == {u: "".join(t + "\n" for _, v, _, t in made if v == u and t) for u in "abc"}
    assert len(parts) == 3 * -(-10 // part_rows)


@pytest.mark.parametrize("part_rows", [1, 3, 100])
def test_joined_parts_are_one_row_per_user(spark, rows, part_rows):
    made = [(n, ("a", "b", None)[n % 3], f"t{n}", None if n % 4 == 0 or n % 3 == 1 else f"w{n}") for n in range(30)]
    parts = P.concat_by_uid(make(spark, *made).repartition(4), part_rows=part_rows)
    expected = {u: "".join(t + "\n" for _, v, _, t in made if v == u and t) for u in ("a", "b", None)}
    got = P.join_parts(parts, "text").collect()
    assert len(got) == 3 and {r["uid"]: r["text"] for r in got} == expected
    assert {(r["uid"], r["part"], r["tid"]) for r in got} == {("a", 0, "t0"), ("b", 0, "t1"), (None, 0, "t2")}
    # What a row cannot hold goes on in further rows.
    whole = {}
    for r in P.join_parts(parts, "text", row_bytes=8).orderBy("uid", "part").collect():
        whole[r["uid"]] = whole.get(r["uid"], "") + r["text"]
    assert whole == expected


def test_queries_have_one_row_per_user_of_many_posts(spark, tmp_path):
    from __spark_entry__ import queries

    spark.range(1_100).selectExpr("id AS doc_id", "concat('w', id) AS text", "'en' AS lang", "'s' AS source", "5L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    row, = queries()["concat_by_uid"](spark, str(tmp_path)).collect()
    assert (row["uid"], row["part"], row["tid"]) == ("s", 0, "0")
    assert row["text"] == "".join(f"w{n}\n" for n in range(1_100) if n not in (3, 4))
    spark.range(17_000).selectExpr("id AS o_orderkey", "7L AS o_custkey", "'p' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    row, = queries()["uid_lookup"](spark, str(tmp_path)).collect()
    assert (row["uid"], row["part"], row["row_idxs"]) == ("7", 0, ",".join(map(str, range(17_000))))


def test_interleaved_order(spark):
    frame = spark.range(7).withColumnRenamed("id", "row_idx")
    got = frame.orderBy(P.interleaved_order(3)).collect()
    assert [r[0] for r in got] == [0, 3, 6, 1, 4, 2, 5]


def test_export_takes_the_last_row_of_the_last_split(spark, rows):
    frame = spark.createDataFrame(
        [("train", 5, "a", [5]), ("test", 1, "a", [1]), ("test", 0, "a", [0]), ("train", 2, "b", [2]), ("validation", 9, "c", [9])],
        "split string, row_idx long, uid string, input_ids array<int>",
    )
    assert {r["uid"]: r["input_ids"] for r in P.export_last_by_uid(frame).collect()} == {"a": [1], "b": [2], "c": [9]}
    assert {r["uid"]: r["input_ids"] for r in P.export_last_by_uid(frame, ["test", "train"]).collect()} == {"a": [5], "b": [2]}
