"""Triplet mining: batches of anchors, positives and negatives; pair distances; hardest pairs.

A mining batch is `B` anchors, one positive per anchor and `NB` negatives. Pairs exist only inside a
batch, so there are at most B * NB of them whatever the table holds. Rows are partitioned and sorted by
batch; a task then walks over runs of whole batches, and equal-sized batches of a run are compared at once
with numpy, in double. Calls into Python do not grow with the number of batches.

`mine` goes from embedded posts to the hardest pairs without copying negatives: batches whose negative
windows start in the same stretch of the permutation share a task, so a vector is sent there once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.config import MiningConfig
from tallyloom.functions.hashing import digest_int, seeded_digest
from tallyloom.functions.vectors import distance, triplet_hinge
from tallyloom.operators.rowindex import hash_order_index, row_index
from tallyloom.operators.positions import group_positions
from tallyloom.operators.posts import uid_lookup
from tallyloom.operators.skew import group_sizes, lookup_join, stage_measured
from tallyloom.operators.staging import stage
from tallyloom.operators.sums import exact_mean

_PICK_DIGITS = 15  # 60 bits: the choice stays uniform for groups of any size
_ROLES = ("anchor", "negative", "positive")  # in the order in which rows of a batch are sorted
_PAIR_NUMBERS = 1 << 22  # differences of components that are held at once
_STRETCH = 4  # negative windows that make a stretch: fewer copy more vectors, more leave fewer tasks
_TOP = "batch_id long, rank int, anc_idx int, neg_idx int, anc_row long, pos_row long, neg_row long, margin double"


# --- positives -------------------------------------------------------------------------------


def positive_candidates(posts: DataFrame) -> DataFrame:
    """For each anchor the rows it may be paired with: all rows of its user, the anchor included.

    The candidates of a user are described once, by count and bounds, not repeated per anchor.
    """
    candidates = posts.groupBy("uid").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.min("row_idx").alias("first_row"),
        F.max("row_idx").alias("last_row"),
    )
    candidates, measured = stage_measured(candidates)
    anchors = posts.select(F.col("row_idx").alias("anc_row"), "uid")
    return lookup_join(anchors, candidates, "uid", spread=("anc_row",), measured=measured)


def positive_pairs(
    posts: DataFrame, part_rows: int = 256, max_square: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The candidate relation itself: `(anc_row, uid, pos_row)`, and the lazy form of what is too large for that.

    The index of a user comes in parts of `part_rows` rows. Every part meets every part of the same user: the
    anchors' side is repeated once per part and joined on (user, number of the other part), so a pair of
    parts is a unit of bounded size and a user with a large share of the rows is spread over as many tasks as
    the user has parts. With `max_square`, users with more pairs than that are left out and get
    `(anc_row, uid, part)` instead: the anchor may be paired with all rows of these parts of `candidate_index`.
    Rows without a user belong together, like those of a user with an empty name.
    """
    index, sizes, measured = candidate_index(posts, part_rows)
    whole = lookup_join(index, sizes, "uid", spread=("part",), measured=measured)
    square = F.col("n").cast("decimal(38,0)") * F.col("n")
    large = F.lit(False) if max_square is None else square > max_square
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1))
    left = whole.filter(~large).select("uid", F.col("row_idxs").alias("anchors"), every.alias("part"))
    met = left.join(index, ["uid", "part"])
    pairs = met.select("uid", F.explode("anchors").alias("anc_row"), "row_idxs").select(
        "anc_row", "uid", F.explode("row_idxs").alias("pos_row")
    )
    lazy = whole.filter(large).select("uid", F.explode("row_idxs").alias("anc_row"), "n_parts")
    return pairs, lazy.select("anc_row", "uid", every.alias("part"))


def candidate_index(posts: DataFrame, part_rows: int = 256) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """`(uid, part, row_idxs)`, `(uid, n, n_parts)` and the measured size of the second table."""
    named = posts.select(F.coalesce("uid", F.lit("")).alias("uid"), "row_idx")
    index = stage(uid_lookup(named, part_rows))
    sizes = index.groupBy("uid").agg(F.sum(F.size("row_idxs")).alias("n"), F.count(F.lit(1)).alias("n_parts"))
    sizes, measured = stage_measured(sizes)
    return index, sizes, measured


def sample_positives(posts: DataFrame, seed: int | str = 0, exclude_self: bool = False) -> DataFrame:
    """`(anc_row, uid, pos_row)`: one pseudo-random row of the same user for each row.

    The choice is a position in the user's rows, so anchors join on (user, position). Positions are
    uniform, hence the join is balanced even if one user owns a large share of the rows. Rows without a
    user belong together, like those of a user with an empty name.
    """
    posts = posts.withColumn("uid", F.coalesce("uid", F.lit("")))
    # One row per user, written once: it finds oversized users, is measured and is joined.
    sizes, measured = stage_measured(group_sizes(posts, "uid"))
    ranked = group_positions(posts.select("uid", "row_idx"), "uid", "row_idx", "at", sizes=sizes)
    drawn = digest_int(seeded_digest(seed, F.col("row_idx")), _PICK_DIGITS)
    pick = F.pmod(drawn, F.col("n"))
    if exclude_self:
        pick = F.when(
            F.col("n") > 1, F.pmod(F.col("at") + 1 + F.pmod(drawn, F.greatest(F.col("n") - 1, F.lit(1))), F.col("n"))
        ).otherwise(F.lit(0))
    anchors = lookup_join(ranked, sizes.select("uid", "n"), "uid", spread=("row_idx",), measured=measured).select(
        F.col("row_idx").alias("anc_row"), "uid", pick.alias("at")
    )
    rows = ranked.select("uid", "at", F.col("row_idx").alias("pos_row"))
    return anchors.join(rows, ["uid", "at"]).select("anc_row", "uid", "pos_row")


# --- batches ---------------------------------------------------------------------------------


def anchor_slots(rows: DataFrame, config: MiningConfig = MiningConfig(), total: int | None = None) -> DataFrame:
    """Permuted rows in full batches of anchors. Adds `batch_id, slot`; each row at most once."""
    total = rows.count() if total is None else total
    size = config.anchors_per_batch
    permuted = hash_order_index(rows, "row_idx", f"{config.seed}/anchor", "_perm")
    return (
        permuted.filter(F.col("_perm") < total // size * size)
        .withColumn("batch_id", F.expr(f"_perm div {size}L"))
        .withColumn("slot", (F.col("_perm") % size).cast("int"))
        .drop("_perm")
    )


def negative_windows(rows: DataFrame, config: MiningConfig = MiningConfig(), total: int | None = None) -> DataFrame:
    """Negative candidates of each batch: consecutive windows of another permutation, wrapping around.

    Slot p of batch j is permuted position (j * NB + p) mod N. Read backwards, a row at permuted
    position r fills the slots r, r + N, r + 2N, ... so the windows come from arithmetic, not a join.
    """
    total = rows.count() if total is None else total
    width = config.negatives_per_batch
    slots = total // config.anchors_per_batch * width
    permuted = hash_order_index(rows, "row_idx", f"{config.seed}/negative", "_perm")
    rounds = -(-slots // total) if total else 0
    if rounds == 0:
        return permuted.drop("_perm").withColumn("batch_id", F.lit(0).cast("long")).withColumn(
            "slot", F.lit(0)
        ).filter(F.lit(False))
    return (
        permuted.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
        .withColumn("_at", F.col("_perm") + F.col("_round").cast("long") * F.lit(total))
        .filter(F.col("_at") < slots)
        .withColumn("batch_id", F.expr(f"_at div {width}L"))
        .withColumn("slot", (F.col("_at") % width).cast("int"))
        .drop("_perm", "_round", "_at")
    )


def mining_batches(posts: DataFrame, config: MiningConfig = MiningConfig()) -> DataFrame:
    """`(batch_id, role, slot, row_idx)`: anchors, their positives and the negative candidates."""
    rows = posts.select("row_idx", "uid")
    total = rows.count()
    anchors = anchor_slots(rows, config, total)
    positives = sample_positives(rows, f"{config.seed}/positive")
    paired = anchors.join(positives.select(F.col("anc_row").alias("row_idx"), "pos_row"), "row_idx")
    both = paired.select(
        "batch_id",
        "slot",
        F.explode(F.create_map(F.lit("anchor"), F.col("row_idx"), F.lit("positive"), F.col("pos_row"))).alias(
            "role", "row_idx"
        ),
    )
    negatives = negative_windows(rows.select("row_idx"), config, total).withColumn("role", F.lit("negative"))
    columns = ["batch_id", "role", "slot", "row_idx"]
    return both.select(*columns).unionByName(negatives.select(*columns))


def embedded_batches(embedded: DataFrame, config: MiningConfig = MiningConfig()) -> DataFrame:
    """Mining batches with vectors: `(batch_id, role, slot, row_idx, label, embedding)`.

    `embedded` is `(row_idx, uid, label, embedding)`, one row per post: a post is embedded once and
    looked up, however often it occurs in batches. Anchors and negatives carry their vector through
    the permutation; only positives need the join on the (unique) row.
    """
    total = embedded.count()
    values = embedded.select("row_idx", "label", "embedding")
    columns = ["batch_id", "role", "slot", "row_idx", "label", "embedding"]
    anchors = anchor_slots(values, config, total).withColumn("role", F.lit("anchor"))
    places = anchor_slots(embedded.select("row_idx"), config, total)
    drawn = sample_positives(embedded.select("row_idx", "uid"), f"{config.seed}/positive")
    positives = (
        places.join(drawn, places["row_idx"] == drawn["anc_row"])
        .select("batch_id", "slot", F.col("pos_row").alias("row_idx"))
        .join(values, "row_idx")
        .withColumn("role", F.lit("positive"))
    )
    negatives = negative_windows(values, config, total).withColumn("role", F.lit("negative"))
    return (
        anchors.select(*columns).unionByName(positives.select(*columns)).unionByName(negatives.select(*columns))
    )


# --- pairs -----------------------------------------------------------------------------------


def neg_anc_index_grid(batches: DataFrame) -> DataFrame:
    """`(batch_id, neg_idx, anc_idx)`: the numbered pair grid of each batch."""
    sizes = batches.groupBy("batch_id").agg(
        F.sum(F.when(F.col("role") == "negative", 1).otherwise(0)).cast("int").alias("n_neg"),
        F.sum(F.when(F.col("role") == "anchor", 1).otherwise(0)).cast("int").alias("n_anc"),
    )
    return (
        sizes.filter((F.col("n_neg") > 0) & (F.col("n_anc") > 0))
        .select("batch_id", F.explode(F.expr("sequence(0, n_neg - 1)")).alias("neg_idx"), "n_anc")
        .select("batch_id", "neg_idx", F.explode(F.expr("sequence(0, n_anc - 1)")).alias("anc_idx"))
    )


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("embedding").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Consecutive rows as tables that hold whole groups; the rows come sorted by `by`."""
    held: list[pa.RecordBatch] = []
    for rows in batches:
        if not rows.num_rows:
            continue
        keys = rows.column(by).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and (cut or held[-1].column(by)[-1].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, rows.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([rows.slice(0, cut)])
        held.append(rows.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


@dataclass(frozen=True)
class _Stack:
    """Batches of equal sizes: their ids, and the rows of each role as batches x slots."""

    ids: np.ndarray
    anchor: np.ndarray
    negative: np.ndarray
    positive: np.ndarray

    def part(self, chosen: slice) -> _Stack:
        return _Stack(self.ids[chosen], self.anchor[chosen], self.negative[chosen], self.positive[chosen])

    def parts(self, width: int) -> Iterator[_Stack]:
        """Some batches at a time, so that the differences of all their pairs fit in memory."""
        step = max(1, _PAIR_NUMBERS // max(1, self.anchor.shape[1] * self.negative.shape[1] * width))
        for at in range(0, len(self.ids), step):
            yield self.part(slice(at, at + step))


def _stacks(table: pa.Table) -> Iterator[_Stack]:
    """The batches of a run, grouped by their sizes; rows are sorted by batch, role and slot."""
    ids = table.column("batch_id").to_numpy()
    roles = np.asarray(table.column("role").to_pylist())
    starts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
    sizes = np.stack([np.add.reduceat((roles == role).astype(np.int64), starts) for role in _ROLES], axis=1)
    for size in np.unique(sizes, axis=0):
        own = starts[(sizes == size).all(axis=1)]
        ends = np.concatenate([[0], np.cumsum(size)])
        rows = [own[:, None] + np.arange(ends[i], ends[i + 1]) for i in range(3)]
        yield _Stack(ids[own], *rows)


def _distances(vectors: np.ndarray, stack: _Stack) -> np.ndarray:
    """Squared L2 of the (negative, anchor) pairs of each batch."""
    gap = vectors[stack.negative][:, :, None, :].astype(np.float64) - vectors[stack.anchor][:, None, :, :]
    return (gap * gap).sum(axis=-1)


def _margins(vectors: np.ndarray, stack: _Stack) -> np.ndarray:
    gap = vectors[stack.anchor].astype(np.float64) - vectors[stack.positive]
    return _distances(vectors, stack) - (gap * gap).sum(axis=-1)[:, None, :]


def _same_label(table: pa.Table, stack: _Stack) -> np.ndarray:
    codes = table.column("label").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    return codes[stack.negative][:, :, None] == codes[stack.anchor][:, None, :]


def _grid(stack: _Stack, name: str, values: np.ndarray) -> pa.RecordBatch:
    """All pairs of each batch, by negative and then anchor."""
    n, n_neg, n_anc = values.shape
    return pa.RecordBatch.from_pydict({
        "batch_id": pa.array(np.repeat(stack.ids, n_neg * n_anc), pa.int64()),
        "neg_idx": pa.array(np.tile(np.repeat(np.arange(n_neg, dtype=np.int32), n_anc), n)),
        "anc_idx": pa.array(np.tile(np.arange(n_anc, dtype=np.int32), n * n_neg)),
        name: pa.array(values.ravel()),
    })


def _over_batches(batches: DataFrame, run: Callable[[pa.Table, _Stack], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function to stacks of whole batches: one shuffle by batch, one call into Python a task."""

    def walk(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(rows, "batch_id"):
            width = _matrix(table).shape[1] if "embedding" in table.column_names else 1
            for stack in _stacks(table):
                for part in stack.parts(width):
                    yield run(table, part)

    return batches.repartition("batch_id").sortWithinPartitions("batch_id", "role", "slot").mapInArrow(walk, schema)


def anc_neg_distance(batches: DataFrame) -> DataFrame:
    """`(batch_id, neg_idx, anc_idx, distance)`: squared L2 for each pair of a batch."""

    def score(table: pa.Table, stack: _Stack) -> pa.RecordBatch:
        return _grid(stack, "distance", _distances(_matrix(table), stack))

    return _over_batches(
        batches.filter(F.col("role") != "positive"), score, "batch_id long, neg_idx int, anc_idx int, distance double"
    )


def margins(batches: DataFrame) -> DataFrame:
    """`(batch_id, neg_idx, anc_idx, margin)`: d(anchor, negative) - d(anchor, positive)."""

    def score(table: pa.Table, stack: _Stack) -> pa.RecordBatch:
        return _grid(stack, "margin", _margins(_matrix(table), stack))

    return _over_batches(batches, score, "batch_id long, neg_idx int, anc_idx int, margin double")


def eligibility_mask(batches: DataFrame, config: MiningConfig = MiningConfig()) -> DataFrame:
    """`(batch_id, neg_idx, anc_idx, penalty)`: 0, or infinity where both sides share a label."""
    masked = config.masked

    def score(table: pa.Table, stack: _Stack) -> pa.RecordBatch:
        return _grid(stack, "penalty", np.where(_same_label(table, stack) & masked, np.inf, 0.0))

    rows = batches.filter(F.col("role") != "positive").drop("embedding")
    return _over_batches(rows, score, "batch_id long, neg_idx int, anc_idx int, penalty double")


def sorted_margins(scored: DataFrame) -> DataFrame:
    """All pairs with their `rank`, hardest first, counted from 1 over the whole table, and `batch_rank` inside the batch.

    The order is a column, whatever becomes of the rows: positions come from range partitions and their
    counts, so no task sorts more than its range.
    """
    order = ("margin", "batch_id", "neg_idx", "anc_idx")
    inside = F.row_number().over(W.partitionBy("batch_id").orderBy("margin", "neg_idx", "anc_idx"))
    ranked = row_index(scored.withColumn("batch_rank", inside), *order, name="_place")
    return ranked.withColumn("rank", F.col("_place") + 1).drop("_place")


def _hardest(table: pa.Table, stack: _Stack, masked: bool, keep_masked: bool) -> pa.RecordBatch:
    """The pairs of smallest margin of each batch, as many as it has anchors."""
    margin = _margins(_matrix(table), stack)
    if masked:
        margin = np.where(_same_label(table, stack), np.inf, margin)
    n, _, n_anc = margin.shape
    flat = margin.reshape(n, -1)  # ties are already in (negative, anchor) order
    order = np.argsort(flat, axis=1, kind="stable")[:, :n_anc]
    values = np.take_along_axis(flat, order, 1)
    kept = np.isfinite(values) if masked and not keep_masked else np.ones(values.shape, dtype=bool)
    at, rank = np.nonzero(kept)
    neg, anc = order[kept] // n_anc, order[kept] % n_anc
    rows = table.column("row_idx").to_numpy()
    return pa.RecordBatch.from_pydict({
        "batch_id": pa.array(stack.ids[at], pa.int64()),
        "rank": pa.array((rank + 1).astype(np.int32)),
        "anc_idx": pa.array(anc.astype(np.int32)),
        "neg_idx": pa.array(neg.astype(np.int32)),
        "anc_row": pa.array(rows[stack.anchor[at, anc]]),
        "pos_row": pa.array(rows[stack.positive[at, anc]]),
        "neg_row": pa.array(rows[stack.negative[at, neg]]),
        "margin": pa.array(values[kept]),
    })


def _mode(mode: str) -> bool:
    if mode not in ("penalty", "filter"):
        raise ValueError(f"unknown mode {mode!r}")
    return mode == "penalty"


def top_triplets(batches: DataFrame, config: MiningConfig = MiningConfig(), mode: str = "penalty") -> DataFrame:
    """The hardest pairs of each batch, as many as it has anchors.

    Order: margin, negative slot, anchor slot. With masking, same-label pairs get an infinite margin
    and can still fill up a batch that has too few eligible pairs; `mode="filter"` leaves them out.
    """
    masked, keep = config.masked, _mode(mode)
    return _over_batches(batches, lambda table, stack: _hardest(table, stack, masked, keep), _TOP)


def mine(embedded: DataFrame, config: MiningConfig = MiningConfig(), mode: str = "penalty", stretch: int = _STRETCH) -> DataFrame:
    """`top_triplets` of the batches of embedded posts `(row_idx, uid, label, embedding)`, without making the batches.

    Batch j takes its negatives from the places j * NB and on of a permutation, around its end. The permutation
    is cut into stretches of `stretch` windows. Anchors and positives go to the stretch where their window
    starts, each negative to those in which windows that reach it start: its own, and near a cut the one
    before. So vectors cross the network some three times instead of once per batch that holds them.
    """
    masked, keep = config.masked, _mode(mode)
    width = config.negatives_per_batch
    total = embedded.count()
    values = embedded.select("row_idx", "label", "embedding")
    size = stretch * width

    def of(place):
        return F.expr(f"pmod({place}, {max(total, 1)}L) div {size}L")

    columns = ["stretch", "role", "batch_id", "slot", "row_idx", "label", "embedding"]
    anchors = anchor_slots(values, config, total).withColumn("role", F.lit("anchor"))
    places = anchor_slots(embedded.select("row_idx"), config, total)
    drawn = sample_positives(embedded.select("row_idx", "uid"), f"{config.seed}/positive")
    positives = (
        places.join(drawn, places["row_idx"] == drawn["anc_row"])
        .select("batch_id", "slot", F.col("pos_row").alias("row_idx"))
        .join(values, "row_idx")
        .withColumn("role", F.lit("positive"))
    )
    started = [rows.withColumn("stretch", of(f"batch_id * {width}L")).select(*columns) for rows in (anchors, positives)]
    around = F.when(F.col("batch_id") < width - 1, of(total - 1)).otherwise(of("batch_id"))
    negatives = (
        hash_order_index(values, "row_idx", f"{config.seed}/negative", "batch_id")  # the place, in the column of the batch
        .withColumn("stretch", F.explode(F.array_distinct(F.array(of("batch_id"), of(f"batch_id - {width - 1}L"), around))))
        .withColumns({"role": F.lit("negative"), "slot": F.lit(0)})
        .select(*columns)
    )
    rows = started[0].unionByName(started[1]).unionByName(negatives)

    def walk(sorted_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(sorted_rows, "stretch"):
            yield from _mine_stretches(table)

    def _mine_stretches(table: pa.Table) -> Iterator[pa.RecordBatch]:
        at = table.column("stretch").to_numpy()
        cuts = [*np.flatnonzero(np.diff(at, prepend=at[0] - 1)).tolist(), len(at)]
        for start, end in zip(cuts, cuts[1:]):
            own = table.slice(start, end - start)
            role = np.asarray(own.column("role").to_pylist())
            ids = own.column("batch_id").to_numpy()
            by_role = {name: np.flatnonzero(role == name) for name in _ROLES}
            found = ids[by_role["anchor"]]
            if not len(found):
                continue
            shape = (len(np.unique(found)), -1)
            first = found.reshape(shape)[:, 0]
            # Places are sorted; a window is looked up place by place.
            windows = (first[:, None] * width + np.arange(width)) % total
            negative = by_role["negative"][np.searchsorted(ids[by_role["negative"]], windows)]
            stack = _Stack(first, by_role["anchor"].reshape(shape), negative, by_role["positive"].reshape(shape))
            for part in stack.parts(_matrix(own).shape[1]):
                yield _hardest(own, part, masked, keep)

    return rows.repartition("stretch").sortWithinPartitions("stretch", "role", "batch_id", "slot").mapInArrow(walk, _TOP)


# --- selected triplets -----------------------------------------------------------------------


def triplet_token_rows(triplets: DataFrame, processed: DataFrame) -> DataFrame:
    """`(batch_id, rank, role, row_idx, input_ids, attention_mask)` of the selected triplets.

    The three roles go through one join on the unique row, not three.
    """
    roles = triplets.select(
        "batch_id",
        "rank",
        F.explode(
            F.create_map(
                F.lit("anchor"), F.col("anc_row"), F.lit("positive"), F.col("pos_row"), F.lit("negative"), F.col("neg_row")
            )
        ).alias("role", "row_idx"),
    )
    tokens = processed.select("row_idx", "input_ids", "attention_mask")
    return roles.join(tokens, "row_idx").select("batch_id", "rank", "role", "row_idx", "input_ids", "attention_mask")


def triplet_vectors(triplets: DataFrame, embedded: DataFrame) -> DataFrame:
    """Selected triplets with their three vectors."""
    vectors = embedded.select("row_idx", "embedding")
    out = triplets
    for role in ("anc", "pos", "neg"):
        side = vectors.select(F.col("row_idx").alias(f"{role}_row"), F.col("embedding").alias(f"{role}_vec"))
        out = out.join(side, f"{role}_row")
    return out


def triplet_loss(vectors: DataFrame, config: MiningConfig = MiningConfig()) -> DataFrame:
    """`(n_triplets, loss, net_loss)`: mean hinge over `anc_vec, pos_vec, neg_vec`, and loss - threshold.

    The mean does not depend on the partitioning.
    """
    hinge = triplet_hinge(
        distance(config.distance, F.col("anc_vec"), F.col("pos_vec")),
        distance(config.distance, F.col("anc_vec"), F.col("neg_vec")),
        config.threshold,
    )
    return vectors.agg(F.count(F.lit(1)).alias("n_triplets"), exact_mean(hinge).alias("loss")).withColumn(
        "net_loss", F.col("loss") - F.lit(float(config.threshold))
    )
