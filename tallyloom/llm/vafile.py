"""Exact top-k inner products by vector-approximation files.

Integer vectors are approximated by one small cell number per component. A first scan reads the
approximations only: the bounds of the cells bound every score from below and above, and the k-th best
lower bound of a query over all blocks is a threshold that no result can miss. A second scan takes, block by
block, the candidates whose upper bound reaches the threshold, best bound first, reads their exact vectors
and stops when the k-th exact score is above every bound that is left. So results are exact.

Equal vectors are one entry with its k + 1 smallest ids, which is all that ties can need; the limit per
entry is applied before the shuffle. Queries and candidates meet in blocks of bounded size; each block pair
returns at most k rows per query. Cell borders come from quantiles of a bounded sample (`sample_rows`), the
outermost borders from the whole table, so bounds hold for every row.

Defined cases: vectors that are null, empty or hold null or non-finite components, and rows without an id,
take no part. Vectors meet only those of their own length. A query never meets rows of its own id; rows that
repeat id and vector count once. With fewer than k candidates all are returned. Scores beyond the range of a long are given as its ends. An empty table gives an
empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import bounded_sample
from tallyloom.llm.vectors import matrix, sound
from tallyloom.operators.staging import stage


_WIDE = 1 << 62


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T: floating point where its 53 bits suffice, else integers of any size."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    top = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T if top < 1 << 62 else a.astype(object) @ b.T.astype(object)


class Cells:
    """Borders of the cells of one vector length: component x lies in cell c if low[c] <= x <= high[c]."""

    def __init__(self, sample: np.ndarray, bits: int, least: int, most: int):
        steps = np.linspace(0, 1, (1 << bits) + 1)[1:-1]
        self.low, self.high, self.inner = [], [], []
        for column in sample.T:
            inner = np.unique(np.quantile(column, steps, method="nearest")).astype(np.int64)
            inner = inner[inner > least]
            self.inner.append(inner)
            self.low.append(np.concatenate(([least], inner)))
            self.high.append(np.concatenate((inner - 1, [most])))

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, d], side="right") for d, e in enumerate(self.inner)], axis=1).astype(np.uint8)

    def bounds(self, queries: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of queries with approximated vectors."""
        low = np.stack([e[codes[:, d]] for d, e in enumerate(self.low)], axis=1)
        high = np.stack([e[codes[:, d]] for d, e in enumerate(self.high)], axis=1)
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        return products(plus, low) + products(minus, high), products(plus, high) + products(minus, low)


def verified(query, entries, ids, own, upper, threshold, k: int) -> list[tuple[int, int]]:
    """The best k (score, id) of a block for one query, reading exact vectors in order of their upper bounds."""
    at = np.flatnonzero(upper >= threshold)
    at = at[np.argsort(-upper[at], kind="stable")]
    best: list[tuple[int, int]] = []
    for start in range(0, len(at), 64):
        if len(best) == k and -best[-1][0] > upper[at[start]]:
            break
        part = at[start:start + 64]
        for score, n in zip(products(query[None, :], entries[part])[0].tolist(), part.tolist()):
            best += [(-score, i) for i in ids[n] if i != own]
        best = sorted(best)[:k]
    return [(-s, i) for s, i in best]


def top_k(
    embeddings: DataFrame, k: int = 5, every: int = 50, scale: int = 256, key: str = "vec_id", vector: str = "embedding",
    bits: int = 6, sample_rows: int = 10_000, query_rows: int = 1_024, block_rows: int = 4_096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best partners of each row whose id is divisible by `every`."""
    whole = embeddings.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(
        F.col("id").isNotNull() & sound("v") & (F.size(F.coalesce("v", F.array())) > 0)
    )
    rows = stage(whole.select("id", F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("x")).distinct())
    smallest = F.row_number().over(W.partitionBy("x").orderBy("id"))
    entries = stage(
        rows.withColumn("n", smallest).filter(F.col("n") <= k + 1).groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select("x", "ids", F.col("ids")[0].alias("first"), F.size("x").alias("dim"))
    )
    queries = rows.filter(F.col("id") % every == 0).select("id", "x", F.size("x").alias("dim"))
    sizes = entries.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.array_min("x")).alias("least"), F.max(F.array_max("x")).alias("most")
    ).orderBy(F.desc("n"), "dim").limit(1_000).collect()  # lengths; the rare ones beyond share one wide cell
    asked = max(1, queries.count())
    sample = bounded_sample(entries, sample_rows, "first").select("x").toPandas()["x"]
    cells = {}
    for r in sizes:
        some = [v for v in sample if len(v) == r["dim"]]
        cells[r["dim"]] = Cells(np.array(some, dtype=np.int64).reshape(len(some), r["dim"]) if some else np.full((1, r["dim"]), r["least"], dtype=np.int64), bits, r["least"], r["most"])
    total = max([1, *(r["n"] for r in sizes)])
    blocks, parts = -(-total // block_rows), -(-asked // query_rows)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                if int(dim) in cells:
                    codes = cells[int(dim)].codes(matrix(part.column("x"), np.int64))
                    packed = pa.array([c.tobytes() for c in codes], pa.binary())
                else:
                    packed = pa.nulls(part.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("dim"), part.column("first"), part.column("x"), part.column("ids"), packed],
                    names=["dim", "first", "x", "ids", "codes"],
                )

    file = stage(
        entries.mapInArrow(approximate, "dim int, first long, x array<long>, ids array<long>, codes binary")
        .withColumn("block", F.pmod(F.xxhash64("first"), F.lit(blocks)).cast("int"))
    )
    dealt = queries.withColumn("part", F.pmod(F.xxhash64("id", "x"), F.lit(parts)).cast("int"))
    task = ["dim", "block", "part"]
    here = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    coming = lambda df: df.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def limits(dim, q, codes, x):
        if codes is None:  # no approximation: the exact scores are the bounds
            s = products(q, x())
            return s, s
        return cells[dim].bounds(q, codes)

    def unpack(table: pa.Table):
        column = table["codes"]
        if column.null_count:
            return None
        return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(table.num_rows, -1)

    def scan(entries: pa.Table, asking: pa.Table) -> pa.Table:
        empty = {"id": pa.array([], pa.int64()), "mark": pa.array([], pa.int64()), "lower": pa.array([], pa.int64())}
        if not entries.num_rows or not asking.num_rows:
            return pa.table(empty)
        q = matrix(asking["x"], np.int64)
        lower, _ = limits(asking["dim"][0].as_py(), q, unpack(entries), lambda: matrix(entries["x"], np.int64))
        firsts, many = entries["first"].to_numpy(), entries["many"].to_numpy(zero_copy_only=False)
        own = asking["id"].to_numpy()
        lower = lower.astype(np.float64) if lower.dtype == object else lower
        # An entry whose only id is the query's own gives it no result.
        floor = np.iinfo(np.int64).min if lower.dtype == np.int64 else -np.inf
        lower = np.where((firsts[None, :] == own[:, None]) & ~many[None, :], floor, lower)
        take = min(k, lower.shape[1])
        top = np.partition(lower, lower.shape[1] - take, axis=1)[:, lower.shape[1] - take:]
        row, col = np.nonzero(top > floor)
        return pa.table({"id": pa.array(own[row]), "mark": asking["mark"].take(pa.array(row)), "lower": pa.array(np.clip(top[row, col], -_WIDE, _WIDE).astype(np.int64))})

    narrow = file.select("dim", "block", "first", (F.size("ids") > 1).alias("many"), "codes", F.when(F.col("codes").isNull(), F.col("x")).alias("x"))
    marked = dealt.withColumn("mark", F.xxhash64("x"))
    lower = here(narrow).groupBy(*task).cogroup(coming(marked).groupBy(*task)).applyInArrow(scan, "id long, mark long, lower long")
    nth = F.row_number().over(W.partitionBy("id", "mark").orderBy(F.desc("lower")))
    bars = stage(
        lower.withColumn("n", nth).filter(F.col("n") <= k).groupBy("id", "mark")
        .agg(F.min("lower").alias("bar"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).drop("n")
    )
    ready = marked.join(bars, ["id", "mark"], "left")

    def finish(entries: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if entries.num_rows and asking.num_rows:
            q, x = matrix(asking["x"], np.int64), matrix(entries["x"], np.int64)
            _, upper = limits(asking["dim"][0].as_py(), q, unpack(entries), lambda: x)
            ids = entries["ids"].to_pylist()
            for n, (own, mark, bar) in enumerate(zip(asking["id"].to_pylist(), asking["mark"].to_pylist(), asking["bar"].to_pylist())):
                found = verified(q[n], x, ids, own, upper[n], -_WIDE * _WIDE if bar is None else bar, k)
                out += [(own, mark, i, s) for s, i in found]
        a, b, c, d = zip(*out) if out else ((), (), (), ())
        d = [min(max(s, -(1 << 63)), (1 << 63) - 1) for s in d]
        return pa.table({"query_id": pa.array(a, pa.int64()), "mark": pa.array(b, pa.int64()), "vec_id": pa.array(c, pa.int64()), "score": pa.array(d, pa.int64())})

    found = here(file.select("dim", "block", "first", "x", "ids", "codes")).groupBy(*task).cogroup(
        coming(ready).groupBy(*task)
    ).applyInArrow(finish, "query_id long, mark long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
