"""Embedding near-duplicates over an inverted multi-index.

Two codebooks, one for each half of the (normalised) vectors, form a grid of cells; every vector lies in the
cell of its nearest pair of centroids. A vector visits cells in order of the summed distance of its halves
to the two centroids (the multi-sequence order) until the target recall is met, and is compared in double
precision with all members of those cells. Nothing below the similarity links.

How many cells to visit is calibrated on the sample: partners at exactly the linking similarity, in random
directions, are placed in the grid, and the number of visits is the quantile `recall` of the rank of their
cells. Codebooks and calibration use a bounded sample (`sample_rows`, chosen by a hash of the id); every
vector is indexed and every vector visits.

Equal vectors are one entry with a count. Cells are dealt to regions of bounded bytes; a cell with more members than that is cut
by a hash. Vectors are stored with their cell and the place, in their own order, of the last cell they visit, so that whether a
vector visits a cell can be seen anywhere from the two. They visit in rounds: in each, all members go to the tasks of their
regions, and a share of the vectors, chosen by a hash, goes once to every region it visits, with the list of cells. Rounds are so
many that what one sends is a small multiple of the table; its shuffle files are deleted before the next. So the disk holds a
few copies of the table however many cells a vector visits. A task holds the members of one region and reads its visitors as a
stream; it returns counts per vector and at most one link per row, never all pairs, and these are summed up between rounds when
they outgrow the table.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing
and are their own component. Vectors of different lengths never link. Repeated rows are vectors of their
own: they link with each other. A row without an id takes no part, has no links and no component. An empty
table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.config import LIMITS
from tallyloom.llm.common import bounded_sample, connected_components, local_stars, tidy
from tallyloom.llm.vectors import matrix, sound
from tallyloom.operators.skew import lookup_join
from tallyloom.operators.staging import release_shuffles, stage, unstage

_SCALE = 1 << 18  # halves are rounded to integers for visits: their products and sums are exact in double precision
_CELL_BITS = 20
_CELL = (1 << _CELL_BITS) - 1
_ROW_BYTES = 48  # what is sent with a vector, roughly
_REGIONS = 12  # at least, for tables that need not be cut, unless regions get smaller than _REGION_BYTES
_REGION_BYTES = 1 << 16
_TASK_BYTES = 1 << 26  # visitors of a task, unless it gets four times as many as members
_PACK_BYTES = 1 << 12  # vectors in a row that is sent
_STEP_BYTES = 1 << 23  # vectors that a task sends, or compares with its members, at a time
_STEP_PAIRS = 1 << 20

_ENTRY = "first long, copies long, mark binary, dim int"
_SENT = "g int, side int, dim int, vec binary, first binary, copies binary, home binary, reach binary, counts binary, cells binary"
_FOUND = "a long, b long, n long"


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of a bounded sample."""
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres, 1)[0][:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest centroids of each row, nearest first, and their squared distances."""
    d = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None, :]
    n = min(n, len(centres))
    at = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centres) else np.broadcast_to(np.arange(len(centres)), d.shape)
    near = np.take_along_axis(d, at, 1)
    order = np.argsort(near, axis=1, kind="stable")
    return np.take_along_axis(at, order, 1), np.take_along_axis(near, order, 1)


class Grid:
    """The product grid of one vector length; `visits` cells are visited by each vector."""

    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int = 1):
        self.first, self.second, self.visits = first, second, visits

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return unit[:, :cut], unit[:, cut:]

    def cell(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.halves(unit)
        return nearest(a, self.first, 1)[0][:, 0], nearest(b, self.second, 1)[0][:, 0]

    def keys(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An integer for each row and centroid of the first and of the second half.

        The sum of a first and a second key orders the cells by distance, ties by number, and has the number of the cell in its
        low bits. Being exact, keys are the same whatever other rows are in the batch.
        """
        keys = []
        for half, centres, step in zip(self.halves(unit), (self.first, self.second), (len(self.second), 1)):
            x, c = np.rint(half * _SCALE), np.rint(centres * _SCALE)
            far = (c**2).sum(1) - 2 * x @ c.T  # the half's own square is the same for all centroids
            keys.append((far.astype(np.int64) << _CELL_BITS) + np.arange(len(c)) * step)
        return keys[0], keys[1]

    def fronts(self, unit: np.ndarray, visits: int) -> Iterator[tuple[slice, np.ndarray]]:
        """For runs of rows: the keys of all cells that can be among the first `visits`.

        The cell of sorted ranks (r, s) comes after (r + 1)(s + 1) - 1 others, so only ranks with
        (r + 1)(s + 1) <= visits can be among the first.
        """
        most = np.minimum(visits // np.arange(1, min(visits, len(self.first)) + 1), len(self.second))
        r = np.repeat(np.arange(len(most)), most)
        s = np.arange(len(r)) - np.repeat(np.cumsum(most) - most, most)
        step = max(1, (1 << 20) // (len(r) + len(self.first) + len(self.second)))
        for start in range(0, len(unit), step):
            some = slice(start, start + step)
            a, b = (np.sort(x, axis=1) for x in self.keys(unit[some]))
            yield some, np.take(a, r, axis=1) + np.take(b, s, axis=1)

    def sequence(self, unit: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
        """The first `visits` cells of each row in multi-sequence order."""
        cells = np.concatenate([np.sort(keys, axis=1)[:, :visits] & _CELL for _, keys in self.fronts(unit, visits)])
        return cells // len(self.second), cells % len(self.second)

    def reach(self, unit: np.ndarray) -> np.ndarray:
        """The key of the last cell that each row visits."""
        out = np.zeros(len(unit), dtype=np.int64)
        last = min(self.visits, len(self.first) * len(self.second)) - 1
        for some, keys in self.fronts(unit, self.visits):
            out[some] = np.partition(keys, last, axis=1)[:, last]
        return out

    def visited(self, unit: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all visits, by row."""
        rows, cells = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for some, keys in self.fronts(unit, self.visits):
            row, at = np.nonzero(keys <= reach[some, None])
            rows.append(row + some.start)
            cells.append(keys[row, at] & _CELL)
        return np.concatenate(rows), np.concatenate(cells)


def units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    x = x / np.where(top > 0, top, 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_grid(sample: np.ndarray, rows: int, similarity: float, recall: float, per_cell: int = 64, most: int = 1024) -> Grid:
    """Codebooks for `rows` vectors and the calibrated number of visits."""
    unit = units(sample)
    k = int(np.clip(round((rows / per_cell) ** 0.5), 1, most))
    cut = (unit.shape[1] + 1) // 2
    grid = Grid(kmeans(unit[:, :cut], k), kmeans(unit[:, cut:], k) if unit.shape[1] > cut else np.zeros((1, 0)))
    cells = len(grid.first) * len(grid.second)
    rng = np.random.default_rng(11)
    u = unit[: min(len(unit), 1000)]
    side = rng.standard_normal(u.shape)
    side -= (side * u).sum(1)[:, None] * u
    norm = np.linalg.norm(side, axis=1, keepdims=True)
    partner = similarity * u + np.sqrt(1 - similarity**2) * side / np.where(norm > 0, norm, 1)
    i, j = grid.cell(partner)
    a, b = grid.halves(u)
    da = ((a**2).sum(1)[:, None] - 2 * a @ grid.first.T + (grid.first**2).sum(1)[None])
    db = ((b**2).sum(1)[:, None] - 2 * b @ grid.second.T + (grid.second**2).sum(1)[None])
    at = np.arange(len(u))
    reach = da[at, i] + db[at, j]
    rank = np.array([(da[n][:, None] + db[n][None, :] <= reach[n] + 1e-12).sum() for n in at])
    grid.visits = int(min(cells, np.quantile(rank, recall, method="higher")))
    return grid


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(length of the vectors, their rows)."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim))


def joined(column: pa.Array, dtype) -> np.ndarray:
    """The numbers in all the bytes of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def blobs(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of `x` as bytes, a value for each pair of neighbours in `ends`."""
    x = np.ascontiguousarray(x)
    offsets = (ends * x[:1].nbytes).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(x.tobytes())])


def packed(side: int, dim: int, group: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """Members (side 0) or visitors (side 1), sorted by the task they go to, several in a row of `_SENT`; `cells` go by `counts`."""
    pack = max(1, _PACK_BYTES // max(1, columns["vec"][:1].nbytes))
    new = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(group)) - np.repeat(new, np.diff(np.append(new, len(group))))
    starts = np.flatnonzero(place % pack == 0)
    ends, n = np.append(starts, len(group)), len(starts)
    out = [pa.array(group[starts], pa.int32()), pa.array(np.full(n, side), pa.int32()), pa.array(np.full(n, dim), pa.int32())]
    for name in ("vec", "first", "copies", "home", "reach", "counts", "cells"):
        if name not in columns:
            out.append(pa.nulls(n, pa.binary()))
        elif name == "cells":
            out.append(blobs(columns[name], np.append(0, np.cumsum(columns["counts"]))[ends]))
        else:
            out.append(blobs(columns[name], ends))
    return pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in _SENT.split(", ")])


class Regions:
    """The cells with members, dealt to regions of bounded bytes; a region's members go to each of its tasks, a visitor to one."""

    def __init__(self, dim: np.ndarray, cell: np.ndarray, n: np.ndarray, itemsize: int, region_bytes: int):
        width = dim.astype(np.int64) * itemsize + _ROW_BYTES
        size = n * width
        self.vector_bytes = int((n * (width - _ROW_BYTES)).sum())
        self.most = max(1, min(region_bytes, max(int(size.sum()) // _REGIONS, _REGION_BYTES)))
        self.start = {int(d): np.full(cell[dim == d].max() + 1, -1) for d in np.unique(dim)}
        self.parts = {d: np.ones(len(s), dtype=np.int64) for d, s in self.start.items()}
        self.rows = {d: int(n[dim == d].sum()) for d in self.start}
        self.width, last, room = [], None, 0
        for d, c, s, w in zip(dim.tolist(), cell.tolist(), size.tolist(), width.tolist()):
            parts = -(-s // self.most)
            if parts > 1 or d != last or s > room:
                self.start[d][c] = len(self.width)
                self.width += [w] * parts
                room = self.most - s if parts == 1 else 0
            else:
                self.start[d][c] = len(self.width) - 1
                room -= s
            self.parts[d][c], last = parts, d

    def regions(self, dim: int, row: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, region) of visits; cells without members fall away, those in parts come once for each."""
        start, parts = self.start[dim], self.parts[dim]
        there = np.flatnonzero(cell < len(start))
        there = there[start[cell[there]] >= 0]
        row, cell = row[there], cell[there]
        times = parts[cell]
        at = np.repeat(np.arange(len(cell)), times)
        return row[at], cell[at], start[cell[at]] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)

    def deal(self, sampled: dict[int, tuple[np.ndarray, np.ndarray, int]], round_bytes: float, region_bytes: int) -> int:
        """Tasks of each region and the number of rounds, by the visits (row, cell) of a number of sampled rows per length."""
        visitors, visits = np.zeros(len(self.width)), np.zeros(len(self.width))
        for dim, rows in self.rows.items():
            row, cell, drawn = sampled.get(dim, (np.zeros(len(self.start[dim]), dtype=np.int64), np.arange(len(self.start[dim])), 1))
            row, _, region = self.regions(dim, row, cell)
            seen = np.unique(row * len(self.width) + region) % max(1, len(self.width))
            visitors += np.bincount(seen, minlength=len(self.width)) * (rows / drawn)
            visits += np.bincount(region, minlength=len(self.width)) * (rows / drawn)
        sent = visitors * np.array(self.width) + visits * 4
        rounds = max(1, int(np.ceil(sent.sum() / round_bytes)))
        task = max(4 * self.most, min(region_bytes, _TASK_BYTES))  # every task gets the members, so only crowded regions have many
        self.tasks_of = np.maximum(1, np.ceil(sent / rounds / task)).astype(np.int64)
        self.base = np.cumsum(self.tasks_of) - self.tasks_of
        self.tasks = max(1, int(self.tasks_of.sum()))
        each = max(1, sent.sum() / max(1, sum(self.rows.values())))  # bytes that a visitor sends
        self.slice_rows = int(np.clip(_STEP_BYTES // each, 1, 4_096))
        return rounds

    def ordered(self, group: np.ndarray) -> np.ndarray:
        return np.argsort(group.astype(np.uint16) if self.tasks <= 1 << 16 else group, kind="stable")  # short integers sort faster

    def own(self, dim: int, cell: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(task, row) of members, sorted by task."""
        region = self.start[dim][cell] + (salt >> np.uint64(40)).astype(np.int64) % self.parts[dim][cell]
        times = self.tasks_of[region]
        at = np.repeat(np.arange(len(cell)), times)
        group = self.base[region[at]] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        order = self.ordered(group)
        return group[order], at[order]

    def calls(self, dim: int, row: np.ndarray, cell: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, ...]:
        """(task, row, number of cells) of visitors, sorted by task, and the cells of all of them."""
        row, cell, region = self.regions(dim, row, cell)
        group = self.base[region] + (salt[row] >> np.uint64(20)).astype(np.int64) % self.tasks_of[region]
        order = self.ordered(group)
        group, row, cell = group[order], row[order], cell[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (row[1:] != row[:-1])
        starts = np.flatnonzero(new)
        return group[starts], row[starts], np.diff(np.append(starts, len(row))), cell


class Comparison:
    """The members of a region and the visitors of one of its tasks."""

    def __init__(self, grid: Grid, dim: int, dtype, similarity: float, block_rows: int):
        self.grid, self.dim, self.dtype, self.similarity, self.block_rows = grid, dim, dtype, similarity, block_rows
        self.held: list[tuple[np.ndarray, ...]] = []
        self.coming: list[tuple[np.ndarray, ...]] = []
        self.members: tuple[np.ndarray, ...] | None = None
        self.waiting = 0
        self.stars = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        self.numbers = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]

    def read(self, batch: pa.RecordBatch, **more) -> tuple[np.ndarray, ...]:
        kinds = {"vec": self.dtype, "first": np.int64, "copies": np.int64, "home": np.int32} | more
        vec, *rest = (joined(batch.column(c), t) for c, t in kinds.items())
        return vec.reshape(-1, self.dim), *rest

    def hold(self, batch: pa.RecordBatch) -> None:
        self.held.append(self.read(batch, reach=np.int64))

    def meet(self, batch: pa.RecordBatch) -> None:
        self.coming.append(self.read(batch, counts=np.int32, cells=np.int32))
        self.waiting += self.coming[-1][0].nbytes
        if self.waiting >= _STEP_BYTES:
            self.compare()

    @staticmethod
    def short(raw: np.ndarray) -> np.ndarray:
        """Unit vectors in single precision."""
        out = np.empty(raw.shape, dtype=np.float32)
        for start in range(0, len(raw), 4_096):
            out[start:start + 4_096] = units(raw[start:start + 4_096])
        return out

    def compare(self) -> None:
        """The visitors that wait, with the members of the cells they visit. Single precision only leaves out what cannot link."""
        if self.members is None and not self.held:  # a part of a cell that the hash gave nothing
            self.coming, self.waiting = [], 0
            return
        if self.members is None:
            columns = [np.concatenate(c) for c in zip(*self.held)]
            self.held = []
            order = np.argsort(columns[3], kind="stable")
            self.members = tuple(c[order] for c in columns)
            self.near, self.back = self.short(self.members[0]), np.zeros(len(order), dtype=np.int64)
        raw, own, copies, home, counts, cells = (np.concatenate(c) for c in zip(*self.coming))
        self.coming, self.waiting = [], 0
        here, ids, _, homes, _ = self.members
        coming, found = self.short(raw), np.zeros(len(own), dtype=np.int64)
        bar = np.float32(self.similarity - (self.dim + 8) * 2.0**-23)
        order = np.argsort(cells, kind="stable")
        row, cells = np.repeat(np.arange(len(own)), counts)[order], cells[order]
        starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        low, high = np.searchsorted(homes, cells[starts], "left"), np.searchsorted(homes, cells[starts], "right")
        pairs, some = [], 0
        for start, end, lo, hi in zip(starts, np.append(starts[1:], len(row)), low, high):
            for at in range(start, end, self.block_rows):
                visitors = row[at:min(end, at + self.block_rows)]
                for to in range(lo, hi, self.block_rows):
                    close = coming[visitors] @ self.near[to:min(hi, to + self.block_rows)].T >= bar
                    if not close.any():
                        continue
                    x, y = visitors[close.any(axis=1)], to + np.flatnonzero(close.any(axis=0))
                    u, v = np.nonzero(units(raw[x]) @ units(here[y]).T >= self.similarity)
                    u, v = x[u], y[v]
                    other = own[u] != ids[v]
                    pairs.append((u[other], v[other]))
                    some += len(u)
                    if some > _STEP_PAIRS:
                        self.settle(own, copies, home, found, *map(np.concatenate, zip(*pairs)))
                        pairs, some = [], 0
        if pairs:
            self.settle(own, copies, home, found, *map(np.concatenate, zip(*pairs)))
        linked = np.flatnonzero(found)
        self.numbers.append((own[linked], found[linked]))

    def settle(self, own, copies, home, found, u, v) -> None:
        """Counts and links of linked pairs (visitor, member)."""
        raw, ids, times, _, reach = self.members
        np.add.at(found, u, times[v])
        order = np.argsort(v, kind="stable")
        u, v = u[order], v[order]
        who, at = np.unique(v, return_inverse=True)
        for start in range(0, len(who), 1_024):
            # Members that do not visit the visitor's cell: the pair counts for them here.
            some = slice(*np.searchsorted(at, (start, start + 1_024)))
            a, b = self.grid.keys(units(raw[who[start:start + 1_024]]))
            i, j = np.divmod(home[u[some]], len(self.grid.second))
            unseen = a[at[some] - start, i] + b[at[some] - start, j] > reach[v[some]]
            np.add.at(self.back, v[some][unseen], copies[u[some][unseen]])
        self.stars.append((own[u], ids[v]))
        self.reduce()

    def reduce(self) -> None:
        a, b = map(np.concatenate, zip(*self.stars))
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        self.stars = [local_stars(at[: len(a)], at[len(a):], names)]

    def end(self) -> pa.RecordBatch:
        if self.coming:
            self.compare()
        if self.members is not None:
            linked = np.flatnonzero(self.back)
            self.numbers.append((self.members[1][linked], self.back[linked]))
        (x, y), (who, n) = self.stars[0], map(np.concatenate, zip(*self.numbers))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([x, who])), pa.concat_arrays([pa.array(y), pa.nulls(len(who), pa.int64())]),
                pa.concat_arrays([pa.nulls(len(x), pa.int64()), pa.array(n)]),
            ],
            names=["a", "b", "n"],
        )


def summed(found: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(a, n) links of each entry and (id, component) of those linked, from what rounds have found."""
    whole = reduce(DataFrame.union, found)
    return whole.filter("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("n")), connected_components(whole.filter("b IS NOT NULL"))


def near_duplicates(
    embeddings: DataFrame, similarity: float = 0.9, recall: float = 0.995, key: str = "vec_id", vector: str = "embedding",
    sample_rows: int = 20_000, block_rows: int = 2_048, region_bytes: int = 32 << 20, round_bytes: int = 32 << 20,
) -> DataFrame:
    """(key, n_links, component, kept) of every vector.

    `block_rows` bounds a block of the comparison, `region_bytes` the members that a task holds, and `round_bytes` what the
    visitors of a round send, if that is more than the vectors have. None of them changes a result.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    fit = sound("v") & (F.size("v") > 0) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull()
    good = rows.filter(fit)
    dtype = np.float32 if dict(rows.dtypes)["v"] == "array<float>" else np.float64

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_length(batch):
                x = np.ascontiguousarray(matrix(part.column("v"), dtype))
                ends = np.arange(len(x) + 1)
                columns = [part.column(c) for c in ("first", "copies", "mark", "dim")]
                yield pa.RecordBatch.from_arrays([*columns, blobs(x, ends)], names=["first", "copies", "mark", "dim", "vec"])

    # Equal vectors have equal marks; the other way round is checked, so that a mark can stand for its vector.
    for seed in count(0, 2):
        mark = F.unhex(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(s), "v")), 16, "0") for s in (seed, seed + 1))))
        equal = good.groupBy("v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
        entries = stage(equal.withColumn("mark", mark).withColumn("dim", F.size("v")).mapInArrow(raw, f"{_ENTRY}, vec binary"))
        total = entries.count()
        if entries.select("mark").distinct().count() == total:
            break
        unstage(entries)
    release_shuffles(spark)
    sample: dict[int, list] = {}
    for r in bounded_sample(entries, sample_rows, "first").select("dim", "vec").collect():
        sample.setdefault(r["dim"], []).append(np.frombuffer(r["vec"], dtype))
    of = max(1, sum(map(len, sample.values())))
    grids = {d: fit_grid(np.array(vs, dtype=float), max(1, total * len(vs) // of), similarity, recall) for d, vs in sample.items()}

    def grid_of(dim: int) -> Grid:
        return grids.get(dim) or Grid(np.zeros((1, (dim + 1) // 2)), np.zeros((1, dim // 2)))  # a length the sample has not

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_length(batch):
                grid, unit = grid_of(dim), units(joined(part.column("vec"), dtype).reshape(part.num_rows, dim))
                i, j = grid.cell(unit)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(i * len(grid.second) + j, pa.int32()), pa.array(grid.reach(unit), pa.int64())],
                    names=[*part.schema.names, "cell", "reach"],
                )

    placed = stage(entries.mapInArrow(tidy(place, None), f"{_ENTRY}, vec binary, cell int, reach long"))
    unstage(entries)
    release_shuffles(spark)
    held = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).orderBy("dim", "cell").toArrow()
    plan = Regions(*(held[c].to_numpy() for c in ("dim", "cell", "n")), np.dtype(dtype).itemsize, region_bytes)
    some = {d: units(np.array(vs[:2_000])) for d, vs in sample.items()}
    drawn = {d: (*grid_of(d).visited(u, grid_of(d).reach(u)), len(u)) for d, u in some.items()}
    rounds = plan.deal(drawn, max(round_bytes, plan.vector_bytes), region_bytes)

    def dealt(turn: int):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, part in by_length(batch):
                    grid, raw = grid_of(dim), joined(part.column("vec"), dtype).reshape(part.num_rows, dim)
                    first, copies, home, reach, salt = (part.column(c).to_numpy() for c in ("first", "copies", "cell", "reach", "salt"))
                    salt = salt.view(np.uint64)
                    step = max(1, _STEP_BYTES // raw[:1].nbytes)
                    for start in range(0, len(raw), step):
                        group, at = plan.own(dim, home[start:start + step], salt[start:start + step])
                        at += start
                        yield packed(0, dim, group, vec=raw[at], first=first[at], copies=copies[at], home=home[at], reach=reach[at])
                    coming = np.flatnonzero(salt % np.uint64(rounds) == turn)
                    for start in range(0, len(coming), plan.slice_rows):
                        some = coming[start:start + plan.slice_rows]
                        row, cell = grid.visited(units(raw[some]), reach[some])
                        group, at, *lists = plan.calls(dim, row, cell, salt[some])
                        at, (counts, cells) = some[at], (x.astype(np.int32) for x in lists)
                        yield packed(1, dim, group, vec=raw[at], first=first[at], copies=copies[at], home=home[at], counts=counts, cells=cells)

        return deal

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, task = None, None
        for batch in batches:
            group, side = batch.column("g").to_numpy(), batch.column("side").to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (side[1:] != side[:-1])))) if len(group) else []
            for lo, hi in zip(starts, [*starts[1:], len(group)]):
                if group[lo] != now:
                    if task:
                        yield task.end()
                    dim = batch.column("dim")[int(lo)].as_py()
                    now, task = group[lo], Comparison(grid_of(dim), dim, dtype, similarity, block_rows)
                (task.meet if side[lo] else task.hold)(batch.slice(lo, hi - lo))
        if task:
            yield task.end()

    entry = placed.select("dim", "first", "copies", "vec", "cell", "reach", F.xxhash64("mark").alias("salt"))
    found: list[DataFrame] = []
    pending = 0
    for turn in range(rounds):
        sent = entry.mapInArrow(tidy(dealt(turn), None), _SENT).repartitionById(plan.tasks, "g").sortWithinPartitions("g", "side")
        found.append(stage(sent.mapInArrow(tidy(compare, None), _FOUND)))
        del sent
        pending += found[-1].count()
        release_shuffles(spark)  # after the count, when nothing of the written plan is left in Spark's queues
        if pending > 2 * total and turn < rounds - 1:  # never more than some rows per vector stay on disk
            counts, groups = summed(found)
            both = counts.select("a", F.lit(None).cast("long").alias("b"), "n").union(groups.select("id", "component", F.lit(None).cast("long")))
            found, last, pending = [stage(both)], found, 0
            unstage(groups, *last)
    links, groups = summed(found)
    named = stage(
        placed.join(links, F.col("first") == F.col("a"), "left").join(groups, F.col("first") == F.col("id"), "left")
        .select("mark", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component"))
    )
    unstage(placed, groups, *found)
    release_shuffles(spark)
    limits = replace(LIMITS, literal_keys=0, broadcast_bytes=8 << 20)  # equal vectors in masses are found and salted through a table
    linked = lookup_join(good.select("id", mark.alias("mark")), named, "mark", spread=("id",), limits=limits).select("id", "n_links", "component")
    alone = rows.filter(~F.coalesce(fit, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.union(alone).select(
        F.col("id").alias(key), "n_links", "component", F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept")
    )
