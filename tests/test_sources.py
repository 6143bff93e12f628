from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import staging
from tallyloom.operators.posts import uid_lookup
from tallyloom.sources import readers as R
from tallyloom.sources import writers as S


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_posts_csv(spark, tmp_path):
    path = write(
        tmp_path / "posts.csv",
        'tid,uid,created_at,text,extra\n9007199254740993,010,2022-07-21T09:35:15.000Z,"two\nlines, ""quoted""",x\n'
        "7,11,2022-07-21T09:35:15.000Z,,\n",
    )
    got = R.read_posts(spark, path, multi_line=True)
    assert got.columns == ["uid", "tid", "text", "created_at", "extra"] and set(dict(got.dtypes).values()) == {"string"}
    assert [r["extra"] for r in got.collect()] == ["x", None]
    assert [tuple(r)[:3] for r in got.collect()] == [("010", "9007199254740993", 'two\nlines, "quoted"'), ("11", "7", None)]
    assert [r["row_idx"] for r in R.read_posts_csv(spark, path, indexed=True, multi_line=True).orderBy("row_idx").collect()] == [0, 1]


def test_posts_json(spark, tmp_path):
    lines = [{"tweet_id": str(i), "user_id": "u", "text": None if i == 1 else "t", "created_at": 1658396115000} for i in range(3)]
    path = write(tmp_path / "posts.jsonl", "\n".join(map(json.dumps, lines)))
    got = R.read_posts(spark, path, "json", indexed=True).orderBy("row_idx").collect()
    assert [(r["uid"], r["tid"], r["text"]) for r in got] == [("u", "0", "t"), ("u", "1", None), ("u", "2", "t")]
    assert R.read_posts(spark, path, "json").count() == 3
    times = write(tmp_path / "times.jsonl", '{"tweet_id": "1", "created_at": "Mon Jul 25", "lang": "de"}\n{"tweet_id": "2", "created_at": 5}\n')
    got = R.read_posts_json(spark, times, further=["lang"]).orderBy("tid").collect()
    assert [(r["created_at"], r["lang"]) for r in got] == [("Mon Jul 25", "de"), ("5", None)]


def test_label_files(spark, tmp_path, rows):
    path = write(tmp_path / "labels.csv", "label,screen_name,uid\n0,a,1\n1,b,2\n2,c,1\n")
    assert rows(R.read_labels(spark, path), "uid", "label") == [("1", 2), ("2", 1)]
    got = R.read_user_labels(spark, path)
    assert rows(got, "row_idx", "label", "screen_name", "uid") == [(0, "0", "a", "1"), (1, "1", "b", "2"), (2, "2", "c", "1")]
    S.write_label_csv(got, str(tmp_path / "out"))
    assert rows(R.read_user_labels(spark, str(tmp_path / "out")), "label", "uid") == [("0", "1"), ("1", "2"), ("2", "1")]
    S.write_label_splits(got.withColumn("split", F.lit("train")), str(tmp_path / "splits"))
    assert R.read_user_labels(spark, str(tmp_path / "splits" / "split=train")).count() == 3
    folds = got.withColumn("fold", F.col("label")).withColumn("pos", F.lit(0))
    S.write_label_folds(folds, str(tmp_path / "folds"))
    assert R.read_user_labels(spark, str(tmp_path / "folds" / "fold=2")).count() == 1


def test_label_files_keep_header_and_columns(spark, tmp_path):
    text = "class,name,followers,bio,user\nx,a,12,\"one, two\",1\ny,b,,hello,2\n"
    rows = R.read_user_labels(spark, write(tmp_path / "wide.csv", text))
    S.write_label_csv(rows.withColumn("label", F.when(F.col("label") == "x", 0).otherwise(1)), str(tmp_path / "ids"))
    back = spark.read.option("header", True).csv(str(tmp_path / "ids")).orderBy("user")
    assert back.columns == ["class", "name", "followers", "bio", "user"]
    assert [tuple(r) for r in back.collect()] == [("0", "a", "12", "one, two", "1"), ("1", "b", None, "hello", "2")]
    S.write_label_splits(rows.withColumn("split", F.lit("test")), str(tmp_path / "wide"))
    assert spark.read.option("header", True).csv(str(tmp_path / "wide" / "split=test")).columns == back.columns


def test_label_jsonl(spark, tmp_path):
    true = write(tmp_path / "true.jsonl", '{"true_label": null, "screen_name": "a"}\n{"true_label": "1", "screen_name": "b"}\n')
    assert R.read_label_jsonl(spark, true).columns == ["true_label", "screen_name"]
    other = write(tmp_path / "c.jsonl", '{"classifier_label": "x", "screen_name": "a", "UID": 9007199254740993}\n')
    got = R.read_label_jsonl(spark, other)
    assert S.label_jsonl_to_csv(spark, true, str(tmp_path / "true")) == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "true")).count() == 2
    assert got.columns == ["classifier_label", "screen_name", "UID"] and got.first()["UID"] == "9007199254740993"


def test_keywords(spark, tmp_path):
    path = write(tmp_path / "k.csv", '"keyword","category"\n"apple","x"\npear,y\n"apple","z"\n')
    assert R.read_keywords(spark, path) == ["keyword", "apple", "pear", "apple"]
    with pytest.raises(ValueError):
        R.read_keywords(spark, write(tmp_path / "none.csv", ""))


def test_folds_and_uids(spark, tmp_path, rows):
    path = write(tmp_path / "folds.json", json.dumps({"f0": ["3", "1", "3"], "f1": []}))
    assert rows(R.read_folds(spark, path, "object")) == [("f0", 0, "3"), ("f0", 1, "1"), ("f0", 2, "3")]
    lines = write(tmp_path / "folds.jsonl", '{"fold": "f0", "uids": ["3", "1", "3"]}\n{"fold": "f1", "uids": []}\n')
    assert rows(R.read_folds(spark, lines)) == [("f0", 0, "3"), ("f0", 1, "1"), ("f0", 2, "3")]
    uids = write(tmp_path / "uids.csv", "name,uid\na,7\nb,5\n")
    assert rows(R.read_test_uids(spark, uids)) == [("", 0, "7"), ("", 1, "5")]


def test_screen_names(spark, tmp_path, rows):
    path = write(tmp_path / "names.tsv", "screen_name\tuser_id\na\t007\n")
    names = R.read_screen_names(spark, path)
    assert rows(names) == [("a", "007")]
    S.write_true_labels(names.withColumn("true_label", F.lit("1")), str(tmp_path / "merged"))
    assert spark.read.option("header", True).csv(str(tmp_path / "merged")).columns == ["true_label", "screen_name", "user_id"]


def test_label_dictionary(spark, tmp_path, rows):
    path = str(tmp_path / "dict")
    assert R.read_label_dictionary(spark, path).count() == 0
    S.write_label_dictionary(spark.createDataFrame([("a", 0), ('b "x"', 1)], "label_text string, label_id int"), path)
    assert rows(R.read_label_dictionary(spark, path)) == [("a", 0), ('b "x"', 1)]


def test_predictions(spark, tmp_path, rows):
    path = write(tmp_path / "p.json", '{"1": 0, "2": 1.0}')
    assert rows(R.read_predictions(spark, path, "object")) == [("1", 0), ("2", 1)]
    S.write_user_json(R.read_predictions(spark, path, "object"), str(tmp_path / "lines"))
    assert rows(R.read_predictions(spark, str(tmp_path / "lines"))) == [("1", 0), ("2", 1)]


def test_processed_round_trip(spark, tmp_path):
    path = str(tmp_path / "processed")
    frame = spark.createDataFrame(
        [("train", 0, "a", [1]), ("test", 1, "b", [2])], "split string, row_idx long, uid string, input_ids array<int>"
    )
    built = []

    def build():
        built.append(1)
        return frame

    assert S.processed(spark, path, build).count() == 2
    assert S.processed(spark, path, build, rerun=False).count() == 2 and len(built) == 1
    train = R.read_processed(spark, path, "train")
    assert [r["uid"] for r in train.collect()] == ["a"]
    assert "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().toString()
    S.write_user_json(uid_lookup(train), str(tmp_path / "index"))
    assert json.loads(spark.read.text(str(tmp_path / "index")).first()[0]) == {"uid": "a", "part": 0, "row_idxs": [0]}
    assert [tuple(r) for r in R.read_user_index(spark, str(tmp_path / "index")).collect()] == [("a", 0, [0])]


def test_staged_tables_live_in_the_named_folder_and_are_released(spark):
    staging.release_staged(spark)
    frame = staging.stage(spark.range(5))
    assert frame.count() == 5
    assert spark.conf.get("spark.checkpoint.dir") + "/staged/" in frame.inputFiles()[0]
    assert staging.release_staged(spark) == 1
