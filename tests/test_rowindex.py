from __future__ import annotations

import glob
import hashlib

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.hashing import hash_int, seeded_digest
from tallyloom.operators import rowindex
from tallyloom.operators.rowindex import digests_at_ranks, file_row_index, hash_order_index, row_index, value_at_rank


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_row_index_is_dense_and_ordered(spark):
    frame = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    got = row_index(frame, "k").orderBy("k").collect()
    assert [r["row_idx"] for r in got] == list(range(5000))


def test_row_index_with_skewed_leading_column(spark):
    frame = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("a"), "id")
    got = sorted((r["a"], r["id"], r["row_idx"]) for r in row_index(frame, "a", "id").collect())
    assert [g[2] for g in got] == list(range(3000))


def test_row_index_of_nothing(spark):
    assert row_index(spark.range(0), "id").count() == 0


def test_file_row_index(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(path)
    got = file_row_index(spark, path).collect()
    assert sorted(r["row_idx"] for r in got) == list(range(1000))
    # Rows of a file stay together and in their stored order.
    files = [sorted(r["id"] for r in spark.read.parquet(f).collect()) for f in sorted(glob.glob(f"{path}/*.parquet"))]
    at = {r["id"]: r["row_idx"] for r in got}
    assert [at[i] for ids in files for i in ids] == list(range(1000))


def test_hash_order_is_md5_order(spark):
    got = hash_order_index(spark.range(500), "id", 7).collect()
    expected = sorted(range(500), key=lambda i: (md5(f"7|{i}"), i))
    assert [r["id"] for r in sorted(got, key=lambda r: r["perm_idx"])] == expected


def test_hash_int(spark):
    got = spark.range(20).select("id", hash_int(F.col("id").cast("string")).alias("h")).collect()
    assert all(r["h"] == int(md5(str(r["id"]))[:8], 16) for r in got)


@pytest.mark.parametrize("small", [100_000, 3])
def test_order_statistics(spark, monkeypatch, small):
    monkeypatch.setattr(rowindex, "_SMALL_BUCKET", small)
    monkeypatch.setattr(rowindex, "_BUCKETS", 5)
    values = [(i * i * (-1) ** i,) for i in range(300)]
    frame = spark.createDataFrame(values, "v long")
    ordered = sorted(v[0] for v in values)
    for rank in (0, 1, 150, 299):
        assert value_at_rank(frame, "v", rank) == ordered[rank]
    assert value_at_rank(frame, "v", 300) is None
    digests = sorted(md5(f"0|{v[0]}") for v in values)
    got = digests_at_ranks(frame, seeded_digest(0, F.col("v")), [0, 77, 299, 300], 300)
    assert got == {r: digests[r] for r in (0, 77, 299)}
