"""Oversized keys: every strategy gives the same rows as the plain one."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyloom.config import LIMITS, SizeLimits
from tallyloom.operators import skew
from tallyloom.operators.positions import group_positions, with_part
from tallyloom.operators.skew import heavy_keys, lookup_join, measure

INLINE = SizeLimits(broadcast_rows=0, group_rows=7)
STAGED = SizeLimits(broadcast_rows=0, group_rows=7, literal_keys=0)


@pytest.fixture(scope="module")
def facts(spark):
    """A third of the rows share one key, some have no key, keys 40.. match nothing."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 31 == 1, None).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))
    )
    return spark.range(400).select(F.col("id").alias("row_idx"), key.alias("uid"))


@pytest.fixture(scope="module")
def lookup(spark):
    keys = [("hot", 100)] + [(f"k{i}", i) for i in range(40)]
    return spark.createDataFrame(keys, "uid string, label int")


def test_heavy_keys(facts):
    found = heavy_keys(facts, "uid", limits=INLINE)
    counts = {r["uid"]: r["count"] for r in facts.groupBy("uid").count().collect()}
    assert set(found.values) == {k for k, n in counts.items() if n > 7}
    assert found.max_rows == counts["hot"]
    assert not heavy_keys(facts, "uid", limits=LIMITS)


def test_heavy_keys_by_bytes(spark):
    posts = spark.createDataFrame([("a", "x" * 50), ("a", "y" * 60), ("b", "z")], "uid string, text string")
    found = heavy_keys(posts, "uid", F.octet_length("text"), SizeLimits(group_bytes=100))
    assert found.values == ("a",) and found.max_width == 60


@pytest.mark.parametrize("limits", [INLINE, STAGED])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_strategies_agree(facts, lookup, rows, how, limits):
    def key(r):
        return tuple((v is None, v) for v in r)

    columns = ["row_idx", "uid"] + (["label"] if how in ("inner", "left") else [])
    plain = facts.join(lookup, "uid", how).select(*columns).collect()
    for chosen in (LIMITS, limits):
        got = lookup_join(facts, lookup, "uid", how, limits=chosen)
        assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, plain))


def test_large_lookup_is_not_broadcast_and_hot_key_is_salted(facts, lookup):
    big = lookup_join(facts, lookup, "uid", limits=INLINE)
    plan = big._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "strategy=broadcast" not in plan
    small = lookup_join(facts, lookup, "uid")
    assert "strategy=broadcast" in small._jdf.queryExecution().optimizedPlan().toString()


def test_measure(lookup):
    n, size = measure(lookup)
    assert n == 41 and size > 41 * 8


def test_listed_keys_beyond_the_broadcast_bound_are_salted(facts, monkeypatch):
    monkeypatch.setattr(skew, "LIMITS", SizeLimits(broadcast_rows=0))
    marked = heavy_keys(facts, "uid", limits=STAGED).mark(facts)
    counts = {r["uid"]: r["count"] for r in facts.groupBy("uid").count().collect()}
    assert marked.count() == 400
    assert all(r["_heavy"] == (counts[r["uid"]] > 7) for r in marked.collect())


@pytest.mark.parametrize("limits", [INLINE, STAGED])
def test_group_positions(facts, limits):
    plain = {r["row_idx"]: r["pos"] for r in group_positions(facts, "uid", "row_idx").collect()}
    parts = {r["row_idx"]: r["pos"] for r in group_positions(facts, "uid", "row_idx", limits=limits).collect()}
    assert plain == parts and len(plain) == 400
    assert sorted(v for k, v in plain.items() if k % 3 == 0) == list(range(134))


def test_positions_of_sparse_and_negative_orders(spark):
    """Orders far apart: places are still dense."""
    rows = [("hot", n * 100_003 - 900_000) for n in range(60)] + [(f"u{n}", n * 7) for n in range(9)] + [(None, n * 11) for n in range(20)]
    frame = spark.createDataFrame(rows, "uid string, row_idx long").repartition(5)
    for limits in (INLINE, STAGED):
        got = {(r["uid"], r["row_idx"]): r["pos"] for r in group_positions(frame, "uid", "row_idx", limits=limits).collect()}
        assert len(got) == len(rows)
        for key in {u for u, _ in rows}:
            own = sorted(o for u, o in rows if u == key)
            assert [got[key, o] for o in own] == list(range(len(own)))


@pytest.mark.parametrize("part_rows", [1, 7, 1_000])
def test_parts_are_equal_ordered_and_whole(spark, facts, part_rows):
    sparse = facts.withColumn("row_idx", F.col("row_idx") * 100_003).withColumn("tid", F.col("row_idx").cast("string"))
    rows = with_part(sparse, "uid", "row_idx", part_rows, first="tid").orderBy("uid", "part", "row_idx").collect()
    assert len(rows) == 400
    users = {}
    for r in rows:
        users.setdefault(r["uid"], []).append(r)
    for own in users.values():
        assert [r["row_idx"] for r in own] == sorted(r["row_idx"] for r in own)
        assert [r["part"] for r in own] == [n // part_rows for n in range(len(own))]
        if len(own) > part_rows:
            assert {r["tid"] for r in own} == {str(own[0]["row_idx"])}


@pytest.mark.parametrize("limits", [INLINE, STAGED])
@pytest.mark.parametrize("key", ["n", "b", "m", "w", "_salt", "_heavy", "_listed", "_group", "_weight"])
def test_helper_columns_do_not_clash(facts, lookup, rows, monkeypatch, key, limits):
    """A key, and a further column of the facts, may have any name."""
    monkeypatch.setattr(skew, "LIMITS", SizeLimits(broadcast_rows=0))
    other = "_salt" if key != "_salt" else "_heavy"
    named = facts.withColumnRenamed("uid", key).withColumn(other, F.col("row_idx"))
    got = lookup_join(named, lookup.withColumnRenamed("uid", key), key, limits=limits)
    assert set(got.columns) == {key, "row_idx", other, "label"}
    assert rows(got, "row_idx", "label") == rows(facts.join(lookup, "uid"), "row_idx", "label")
    kept = lookup_join(named, lookup.withColumnRenamed("uid", key), key, "left_anti", limits=limits)
    assert kept.count() == 400 - got.count() and set(kept.columns) == {key, "row_idx", other}
