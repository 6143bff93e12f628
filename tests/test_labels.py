from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyloom.config import LabelConfig
from tallyloom.operators import labels as L
from tallyloom.plans.jobs import prepare_labels, user_label, user_split


def label_rows(spark, entries):
    rows = [(i, *e.split(",")) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, "row_idx long, label string, screen_name string, uid string")


def many(spark, n=101):
    return label_rows(spark, [f"{'abc'[i % 3]},name{i},{i}" for i in range(n)])


def test_line_fields(spark):
    line = spark.createDataFrame([("3,someone,90\n",), ("x,5",)], "line string")
    got = line.select(L.label_of_line(F.col("line")), L.uid_of_line(F.col("line"))).collect()
    assert [tuple(r) for r in got] == [("3", "90"), ("x", "5")]


def test_exclude_users_matches_on_uid_only(spark, rows):
    labels = label_rows(spark, ["c,kim,21", "d,kim,22", "c,lee,23", "e,max,24"])
    others = label_rows(spark, ["d,lee,23", "c,kim,99"])
    got = rows(L.exclude_users(labels, others), "label", "screen_name", "uid")
    assert got == [("c", "kim", "21"), ("d", "kim", "22"), ("e", "max", "24")]


def test_nonempty_labels(spark):
    labels = label_rows(spark, [",x,1", "a,y,2"]).unionByName(
        spark.createDataFrame([(2, None, "z", "3")], "row_idx long, label string, screen_name string, uid string")
    )
    assert [r["uid"] for r in L.nonempty_labels(labels).collect()] == ["2"]


def test_last_label_wins(spark, rows):
    labels = label_rows(spark, ["0,x,1", "1,x,2", "2,x,1"])
    assert rows(L.labels_last_wins(labels), "uid", "label") == [("1", "2"), ("2", "1")]


def test_label_precedence(spark, rows):
    def labels(*pairs):
        return spark.createDataFrame(list(pairs), "uid string, label int")

    got = L.label_precedence(labels(("a", 1), ("b", 1)), labels(("b", 2), ("c", 2)), labels(("c", 0)))
    assert rows(got, "uid", "label") == [("a", 1), ("b", 2), ("c", 0)]


def test_label_ids_by_first_appearance(spark, rows):
    labels = label_rows(spark, ["a,x,1", "b,x,2", ",x,9", "a,x,3", "c,x,4"])
    got = rows(L.assign_label_ids(labels, L.label_dictionary(labels)), "row_idx", "label")
    assert got == [(0, "0"), (1, "1"), (3, "0"), (4, "2")]


@pytest.mark.parametrize("block", [1, 2, 1_000_000])
def test_label_ids_from_previous_row(spark, rows, block):
    labels = label_rows(spark, ["a,x,1", "b,x,2", ",x,9", "a,x,3", "c,x,4", "c,x,5", "d,x,6", "b,x,7", "e,x,8"])
    got = rows(L.label_dictionary_compat(labels, block), "label_text", "label_id")
    assert got == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 2)]


def test_existing_dictionary_is_kept_and_extended(spark, rows):
    labels = label_rows(spark, ["new,x,1", "old,x,2", "newer,x,3"])
    existing = spark.createDataFrame([("old", 0)], "label_text string, label_id int")
    got = rows(L.label_dictionary(labels, existing), "label_text", "label_id")
    assert got == [("new", 1), ("newer", 2), ("old", 0)]


def test_merge_true_labels_many_to_many(spark, rows):
    names = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), (None, "4")], "screen_name string, user_id string")
    true = spark.createDataFrame([("x", "a"), ("y", "a"), (None, "b"), ("z", None)], "true_label string, screen_name string")
    got = rows(L.merge_true_labels(names, true))
    assert got == [("x", "a", "1"), ("x", "a", "2"), ("y", "a", "1"), ("y", "a", "2")]
    both = L.merge_true_labels(names, true, match_missing_names=True).filter("screen_name is null").collect()
    assert [tuple(r) for r in both] == [("z", None, "4")]


def test_split_is_positional(spark):
    got = L.split_labels(many(spark), 0.2).collect()
    assert {r["row_idx"] for r in got if r["split"] == "test"} == set(range(81, 101))
    assert L.split_labels(many(spark), 0.0).filter("split = 'test'").count() == 0
    assert L.split_labels(many(spark), 1.0).filter("split = 'train'").count() == 0


def test_three_way_split_sizes_and_membership(spark):
    rows = many(spark)
    got = L.three_way_split(rows, LabelConfig(0.2, 0.3, 5))
    counts = {r["split"]: r["n"] for r in L.label_split_counts(got).collect()}
    n_test = int(101 * 0.2)
    n_validation = int((101 - n_test) * (0.3 / (1 - 0.2)))
    assert counts == {"test": n_test, "validation": n_validation, "train": 101 - n_test - n_validation}
    order = {r["row_idx"]: r["shuffled_idx"] for r in L.shuffle_labels(rows, seed=5).collect()}
    assert sorted(order.values()) == list(range(101))
    rank = {"train": 0, "validation": 1, "test": 2}
    placed = [rank[r["split"]] for r in sorted(got.collect(), key=lambda r: order[r["row_idx"]])]
    assert placed == sorted(placed)


def test_true_labels_become_the_test_split(spark, rows):
    true = label_rows(spark, ["z,n,3", "z,n,500"])
    got = L.true_label_split(many(spark, 10), true, 0.5).collect()
    by = {s: sorted(int(r["uid"]) for r in got if r["split"] == s) for s in ("train", "validation", "test")}
    assert by == {"train": [0, 1, 2, 4, 5], "validation": [6, 7, 8, 9], "test": [3, 500]}


def test_report_split(spark):
    true = label_rows(spark, ["z,n,1", "z,n,2", "z,n,3"])
    fold = label_rows(spark, ["z,n,2"])
    got = {(r["uid"], r["split"]) for r in L.report_split(many(spark, 5), true, fold).collect()}
    assert got == {("0", "train"), ("4", "train"), ("1", "validation"), ("3", "validation"), ("2", "test")}


def test_override_split_source(spark, rows):
    split = L.split_labels(many(spark, 5), 0.4)
    other = label_rows(spark, ["q,n,77"])
    got = rows(L.override_split_source(split, "test", other), "uid", "split")
    assert got == [("0", "train"), ("1", "train"), ("2", "train"), ("77", "test")]


def test_folds_keep_order_and_repeats(spark, rows):
    labels = label_rows(spark, ["0,old,1", "1,b,2", "2,new,1"])
    folds = spark.createDataFrame(
        [("f", 0, "2"), ("f", 1, "1"), ("f", 2, "2"), ("f", 3, "9"), ("g", 0, "1")], "fold string, pos int, uid string"
    )
    got = rows(L.slice_labels_by_fold(folds, labels), "fold", "pos", "uid", "label", "screen_name")
    assert got == [
        ("f", 0, "2", "1", "b"), ("f", 1, "1", "2", "new"), ("f", 2, "2", "1", "b"), ("g", 0, "1", "2", "new"),
    ]
    assert rows(L.fold_uids_without_label(folds, labels)) == [("9", "f", 3)] or rows(
        L.fold_uids_without_label(folds, labels), "fold", "pos", "uid"
    ) == [("f", 3, "9")]


def test_prepare_labels_with_unmapped_test(spark):
    true = label_rows(spark, ["z,n,1"])
    mapped, dictionary = prepare_labels(many(spark, 10), true_rows=true)
    assert mapped.filter("split = 'test'").first()["label"] == "3"
    assert dictionary.count() == 4
    verbatim, _ = prepare_labels(many(spark, 10), true_rows=true, map_test=False)
    assert verbatim.filter("split = 'test'").first()["label"] == "z"


def test_user_label_prefers_later_splits(spark, rows):
    split = spark.createDataFrame(
        [(9, "0", "n", "u", "train"), (1, "1", "n", "u", "test"), (5, "2", "n", "v", "train"), (6, "0", "n", "v", "train")],
        "row_idx long, label string, screen_name string, uid string, split string",
    )
    assert rows(user_label(split), "uid", "label") == [("u", 1), ("v", 0)]
    assert user_split(split).count() == 3
