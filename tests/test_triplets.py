from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.config import MiningConfig, SizeLimits
from tallyloom.operators import batching as B
from tallyloom.operators import embeddings as EM
from tallyloom.operators import positions, skew
from tallyloom.operators import triplets as T

SMALL = MiningConfig(anchors_per_batch=5, negatives_per_batch=7)


def batch(spark, positive=True):
    """5 zero anchors, 7 negatives that are zero but the last, which is all fives; positive 1 is all tens."""
    rows = [(0, "anchor", i, i, i % 2, [0.0] * 11) for i in range(5)]
    rows += [(0, "negative", i, 100 + i, i % 2, [5.0 if i == 6 else 0.0] * 11) for i in range(7)]
    if positive:
        rows += [(0, "positive", i, 200 + i, i % 2, [10.0 if i == 1 else 0.0] * 11) for i in range(5)]
    return spark.createDataFrame(
        rows, "batch_id long, role string, slot int, row_idx long, label int, embedding array<float>"
    ).repartition(3)


@pytest.fixture(scope="module")
def posts(spark):
    uid = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), (F.col("id") % 8).cast("string")))
    return spark.range(103).select(F.col("id").alias("row_idx"), uid.alias("uid"))


def test_distances_of_every_pair(spark):
    got = T.anc_neg_distance(batch(spark, positive=False)).collect()
    assert len(got) == 35
    assert all(r["distance"] == (275.0 if r["neg_idx"] == 6 else 0.0) for r in got)


def test_distances_of_uneven_vectors(spark):
    rows = [(0, "anchor", 0, 0, 0, [1.0, 2.0]), (0, "anchor", 1, 1, 0, [0.0, 0.0]), (0, "negative", 0, 2, 0, [3.0, 5.0])]
    frame = spark.createDataFrame(rows, batch(spark).schema)
    assert {r["anc_idx"]: r["distance"] for r in T.anc_neg_distance(frame).collect()} == {0: 13.0, 1: 34.0}


def test_margins(spark):
    for r in T.margins(batch(spark)).collect():
        expected = 275.0 if r["neg_idx"] == 6 else 0.0
        if r["anc_idx"] == 1:
            expected -= 1100.0
        assert r["margin"] == expected


def test_index_grid(spark, rows):
    got = rows(T.neg_anc_index_grid(batch(spark)), "neg_idx", "anc_idx")
    assert got == [(j, k) for j in range(7) for k in range(5)]


def test_top_triplets_order_and_ties(spark):
    got = [(r["neg_idx"], r["anc_idx"], r["margin"]) for r in T.top_triplets(batch(spark)).orderBy("rank").collect()]
    assert got == [(i, 1, -1100.0) for i in range(5)]
    row = T.top_triplets(batch(spark)).filter("rank = 1").first()
    assert (row["anc_row"], row["pos_row"], row["neg_row"]) == (1, 201, 100)
    ordered = T.sorted_margins(T.margins(batch(spark))).collect()
    assert [r["margin"] for r in sorted(ordered, key=lambda r: r["rank"])] == sorted(r["margin"] for r in ordered)


def test_masking(spark):
    masked = MiningConfig(require_labels=True, enable_masking=True)
    penalties = T.eligibility_mask(batch(spark), masked).collect()
    assert all((r["penalty"] == float("inf")) == (r["neg_idx"] % 2 == r["anc_idx"] % 2) for r in penalties)
    for half in (MiningConfig(require_labels=True), MiningConfig(enable_masking=True)):
        assert all(r["penalty"] == 0 for r in T.eligibility_mask(batch(spark), half).collect())
    same = batch(spark).withColumn("label", F.lit(1))
    kept = T.top_triplets(same, masked).collect()
    assert len(kept) == 5 and all(r["margin"] == float("inf") for r in kept)
    assert T.top_triplets(same, masked, mode="filter").count() == 0
    assert all(
        r["neg_idx"] % 2 != r["anc_idx"] % 2 for r in T.top_triplets(batch(spark), masked, mode="filter").collect()
    )


def test_loss(spark):
    anchor = [[0.0] + [1.0] * 6] * 2
    rows = [(anchor[0], [1.0] * 7, [0.0] + [1.0] * 6), (anchor[1], [1.0] * 7, [1.0] * 7)]
    frame = spark.createDataFrame(rows, "anc_vec array<float>, pos_vec array<float>, neg_vec array<float>")
    got = T.triplet_loss(frame).first()
    assert (got["n_triplets"], got["loss"], got["net_loss"]) == (2, 100.5, 0.5)


def test_anchors_once_and_negatives_evenly(posts):
    batches = T.mining_batches(posts, SMALL)
    counts = {(r["batch_id"], r["role"]): r["count"] for r in batches.groupBy("batch_id", "role").count().collect()}
    assert counts == {(j, role): n for j in range(20) for role, n in (("anchor", 5), ("positive", 5), ("negative", 7))}
    anchors = [r["row_idx"] for r in batches.filter("role = 'anchor'").collect()]
    assert len(set(anchors)) == len(anchors) == 100
    uses = {r["row_idx"]: r["count"] for r in batches.filter("role = 'negative'").groupBy("row_idx").count().collect()}
    assert len(uses) == 103 and max(uses.values()) - min(uses.values()) <= 1


def test_fewer_rows_than_a_batch(posts):
    assert T.mining_batches(posts.limit(3), SMALL).count() == 0


@pytest.mark.parametrize("exclude_self", [False, True])
def test_positives_come_from_the_same_user(posts, exclude_self):
    uid = {r["row_idx"]: r["uid"] for r in posts.collect()}
    got = T.sample_positives(posts, 1, exclude_self).collect()
    assert sorted(r["anc_row"] for r in got) == list(range(103))
    assert all(uid[r["pos_row"]] == r["uid"] == uid[r["anc_row"]] for r in got)
    if exclude_self:
        alone = {u for u in uid.values() if list(uid.values()).count(u) == 1}
        assert all(r["anc_row"] != r["pos_row"] or r["uid"] in alone for r in got)
    assert len({r["pos_row"] for r in got if r["uid"] == "hot"}) > 10


def test_positives_do_not_depend_on_the_strategy(posts, monkeypatch, rows):
    plain = rows(T.sample_positives(posts, 1), "anc_row", "pos_row")
    tight = SizeLimits(broadcast_rows=0, group_rows=4)
    monkeypatch.setattr(T, "group_positions", lambda *a, **k: positions.group_positions(*a, **k, limits=tight))
    monkeypatch.setattr(T, "lookup_join", lambda *a, **k: skew.lookup_join(*a, **{**k, "limits": tight}))
    assert rows(T.sample_positives(posts, 1), "anc_row", "pos_row") == plain


def test_candidates_are_counted_once_per_user(posts):
    got = {r["anc_row"]: r for r in T.positive_candidates(posts).collect()}
    assert len(got) == 103
    assert (got[3]["n_candidates"], got[3]["first_row"], got[3]["last_row"]) == (35, 0, 102)


def test_token_rows_of_triplets(spark):
    tokens = spark.createDataFrame(
        [(i, [i, 0], [1, 0]) for i in range(300)], "row_idx long, input_ids array<int>, attention_mask array<int>"
    )
    got = T.triplet_token_rows(T.top_triplets(batch(spark)), tokens).collect()
    counts = {}
    for r in got:
        assert r["input_ids"] == [r["row_idx"], 0]
        counts[r["role"]] = counts.get(r["role"], 0) + 1
    assert counts == {"anchor": 5, "positive": 5, "negative": 5}


# --- batches ---------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 3, 8, 11])
def test_batches(spark, n):
    frame = spark.range(n).withColumnRenamed("id", "row_idx")
    assert B.num_batches(frame, 4).first()[0] == -(-n // 4)
    assert B.batches_drop_last(frame, 4).count() == n // 4 * 4
    tail = min(n, 4)
    assert B.batches_with_leftovers(frame, 4).count() == n // 4 * 4 + tail
    assert B.batches_with_leftovers(frame, 4, repeat=False).count() == n
    covered = {r["row_idx"] for r in B.batches_with_leftovers(frame, 4).collect()}
    assert covered == set(range(n))


@pytest.mark.parametrize("seed", [None, 4])
def test_padding(spark, seed):
    frame = spark.range(11).select(
        F.col("id").alias("row_idx"), F.col("id").cast("string").alias("uid"), F.lit(2).alias("label"),
        F.array(F.lit(7), F.lit(8)).alias("input_ids"), F.array(F.lit(1), F.lit(1)).alias("attention_mask"),
    )
    got = B.padded_batches(frame, 4, shuffle_seed=seed).collect()
    assert len(got) == 12 and sum(r["loss_mask"] for r in got) == 11
    pad = [r for r in got if r["loss_mask"] == 0]
    assert [(r["batch_id"], r["pos"], r["label"], r["input_ids"], r["attention_mask"], r["uid"]) for r in pad] == [
        (2, 3, -1, [0, 0], [0, 0], None)
    ]
    assert sorted((r["batch_id"], r["pos"]) for r in got) == [(b, p) for b in range(3) for p in range(4)]
    assert B.padded_batches(frame.limit(8), 4, total=8).count() == 8


def test_info_defaults(spark):
    row = B.with_info_defaults(spark.createDataFrame([(None,)], "uid string")).first()
    assert (row["uid"], row["tid"]) == ("", "")


# --- user embeddings -------------------------------------------------------------------------


def test_user_means_and_lists(spark):
    frame = spark.createDataFrame(
        [(i, "a" if i < 5 else "b", [float(i), 1.0]) for i in range(6)], "row_idx long, uid string, embedding array<float>"
    )
    means = {r["uid"]: (r["n_posts"], r["embedding"]) for r in EM.user_mean_embedding(frame).collect()}
    assert means == {"a": (5, [2.0, 1.0]), "b": (1, [5.0, 1.0])}
    lists = {r["uid"]: r["embeddings"] for r in EM.user_embedding_lists(frame).collect()}
    assert lists["a"] == [[float(i), 1.0] for i in range(5)]
    parts = EM.user_embedding_lists(frame, 2).orderBy("uid", "part").collect()
    assert [v for r in parts if r["uid"] == "a" for v in r["embeddings"]] == lists["a"]
    assert EM.user_all_embeddings(frame).count() == 6


def test_pooling(spark):
    frame = spark.createDataFrame(
        [(1, 0, [1.0, 2.0], 1), (1, 1, [3.0, 6.0], 1), (1, 2, [5.0, 1.0], 0)],
        "seq int, pos int, embedding array<float>, mask int",
    )
    assert EM.pool(frame, "seq", "cls_embedding_only").first()["embedding"] == [1.0, 2.0]
    assert EM.pool(frame, "seq", "word_embedding_mean").first()["embedding"] == [3.0, 3.0]
    assert EM.pool(frame, "seq", "word_embedding_mean", mask="mask").first()["embedding"] == [2.0, 4.0]
    dense = EM.pool(frame, "seq", "cls_embedding_with_dense_layer", weights=[[0.0, 0.0]], bias=[0.0])
    assert dense.first()["embedding"] == [0.0]
    with pytest.raises(ValueError):
        EM.pool(frame, "seq", "other")


def test_rows_without_a_user_get_positives(spark):
    frame = spark.createDataFrame([(i, None if i % 4 == 0 else "a", 0, [float(i), 1.0]) for i in range(40)], "row_idx long, uid string, label int, embedding array<float>")
    drawn = {r["anc_row"]: r["pos_row"] for r in T.sample_positives(frame).collect()}
    assert len(drawn) == 40 and all((a % 4 == 0) == (p % 4 == 0) for a, p in drawn.items())
    config = MiningConfig(anchors_per_batch=4, negatives_per_batch=8)
    assert T.top_triplets(T.embedded_batches(frame, config), config).count() > 0


def vectors_of(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, "hot" if i % 3 == 0 else f"u{i % 5}", None if i % 11 == 0 else i % 4, np.round(rng.normal(0, 1, 6), 1).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "row_idx long, uid string, label int, embedding array<float>").repartition(4)


@pytest.mark.parametrize("n,stretch", [(103, 1), (103, 2), (103, 100), (61, 8), (6, 2), (11, 1), (3, 1)])
@pytest.mark.parametrize("mode", ["penalty", "filter"])
def test_mining_without_copies_equals_mining_of_batches(spark, rows, n, stretch, mode):
    frame = vectors_of(spark, n)
    config = MiningConfig(anchors_per_batch=5, negatives_per_batch=7, require_labels=True, enable_masking=True)
    expected = T.top_triplets(T.embedded_batches(frame, config), config, mode)
    assert rows(T.mine(frame, config, mode, stretch)) == rows(expected) and (n < 5 or expected.count())


def test_a_task_is_called_once_whatever_the_number_of_batches(spark):
    """Rows of many batches, of several sizes, in few partitions."""
    frame = vectors_of(spark, 700)
    batches = T.embedded_batches(frame, MiningConfig(anchors_per_batch=2, negatives_per_batch=3))
    uneven = batches.filter("not (batch_id % 5 = 0 and role = 'negative' and slot = 2) and not (batch_id % 7 = 0 and role = 'anchor' and slot = 1)"
                            " and not (batch_id % 7 = 0 and role = 'positive' and slot = 1)")
    scored = T.margins(uneven)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    by = {}
    for r in uneven.collect():
        by.setdefault(r["batch_id"], {}).setdefault(r["role"], []).append((r["slot"], np.array(r["embedding"])))
    expected = {}
    for batch_id, roles in by.items():
        negative, anchor, positive = ([v for _, v in sorted(roles[k], key=lambda x: x[0])] for k in ("negative", "anchor", "positive"))
        for i, x in enumerate(negative):
            for j, (y, z) in enumerate(zip(anchor, positive)):
                expected[batch_id, i, j] = ((x - y) ** 2).sum() - ((y - z) ** 2).sum()
    got = {(r["batch_id"], r["neg_idx"], r["anc_idx"]): r["margin"] for r in scored.collect()}
    assert set(got) == set(expected) and all(got[k] == pytest.approx(v, abs=1e-5) for k, v in expected.items())


def test_runs_hold_whole_groups():
    keys = [0] * 3 + [1] * 9 + [2, 3, 3, 3, 4]
    for width in range(1, len(keys) + 1):
        batches = [pa.RecordBatch.from_pydict({"k": pa.array(keys[i : i + width], pa.int64())}) for i in range(0, len(keys), width)]
        runs = [t.column("k").to_pylist() for t in T._runs(iter(batches), "k")]
        assert [k for r in runs for k in r] == keys
        assert all(a[-1] != b[0] for a, b in zip(runs, runs[1:]))


def test_ranks_of_margins(spark):
    got = T.sorted_margins(T.margins(batch(spark).union(batch(spark).withColumn("batch_id", F.lit(1).cast("long"))))).collect()
    ordered = sorted(got, key=lambda r: (r["margin"], r["batch_id"], r["neg_idx"], r["anc_idx"]))
    assert [r["rank"] for r in ordered] == list(range(1, 71))
    for b in (0, 1):
        assert [r["batch_rank"] for r in ordered if r["batch_id"] == b] == list(range(1, 36))


@pytest.mark.parametrize("part_rows", [1, 4, 1_000])
@pytest.mark.parametrize("max_square", [None, 100, 0])
def test_candidate_pairs(spark, part_rows, max_square):
    users = [None if i % 10 == 1 else "hot" if i % 3 == 0 else f"u{i % 8}" for i in range(90)]
    frame = spark.createDataFrame([(i * 7, u) for i, u in enumerate(users)], "row_idx long, uid string").repartition(3)
    own = {}
    for i, u in enumerate(users):
        own.setdefault(u or "", []).append(i * 7)
    pairs, lazy = T.positive_pairs(frame, part_rows, max_square)
    small = {u: v for u, v in own.items() if max_square is None or len(v) ** 2 <= max_square}
    expected = sorted((a, u, b) for u, v in small.items() for a in v for b in v)
    assert sorted(tuple(r) for r in pairs.collect()) == expected
    index = {(r["uid"], r["part"]): r["row_idxs"] for r in T.candidate_index(frame, part_rows)[0].collect()}
    rest = sorted((r["anc_row"], r["uid"], b) for r in lazy.collect() for b in index[r["uid"], r["part"]])
    assert rest == sorted((a, u, b) for u, v in own.items() if u not in small for a in v for b in v)
    assert max(map(len, index.values())) <= part_rows


def test_a_large_user_is_spread_over_tasks(spark):
    frame = spark.range(600).select(F.col("id").alias("row_idx"), F.lit("hot").alias("uid"))
    pairs, _ = T.positive_pairs(frame, part_rows=20)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pairs, _ = T.positive_pairs(frame, part_rows=20)
        per_task = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(per_task) == 360_000 and len(per_task) == 4 and max(per_task) < 180_000
