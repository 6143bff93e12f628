"""Sums of vectors that do not depend on how the rows are partitioned.

Floating-point sums change with their order. Here every number is split into whole multiples of fixed powers of
two, limbs of 31 bits, and limbs are added as 64-bit integers: exact in any order, for up to 2^32 vectors of a
key. Values below 2^62 keep everything down to 2^-62; what is larger or not finite is added as it is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LIMB = 31
_POWERS = (_LIMB, 0, -_LIMB, -2 * _LIMB)  # limbs count multiples of 2^31, 1, 2^-31 and 2^-62
_FIXED = 40  # binary digits behind the point of `exact_mean`


def limbs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(limbs as integers along a new first axis, what has none)."""
    plain = np.abs(x) < 2.0 ** (2 * _LIMB)
    rest = np.where(plain, 0.0, x)
    left = np.where(plain, x, 0.0)
    limbs = np.empty((len(_POWERS), *x.shape), dtype=np.int64)
    for i, power in enumerate(_POWERS):
        whole = np.trunc(np.ldexp(left, -power))
        limbs[i] = whole
        left = left - np.ldexp(whole, power)  # exact: the leading bits are taken away
    return limbs, rest


def value_of(limbs: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The numbers that summed limbs stand for.

    Carries are moved up first, so equal sums give equal numbers; what stays behind is at most half a unit of the
    next limb on either side, so adding the limbs up does not cancel leading digits.
    """
    limbs = limbs.copy()
    for i in range(len(_POWERS) - 1, 0, -1):
        carry = (limbs[i] + (1 << _LIMB - 1)) >> _LIMB
        limbs[i] -= carry << _LIMB
        limbs[i - 1] += carry
    out = np.zeros(limbs.shape[1:])
    for i in reversed(range(len(_POWERS))):
        out = out + np.ldexp(limbs[i].astype(np.float64), _POWERS[i])
    return out + rest


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def mean_vectors(rows: DataFrame, key: str, vector: str = "embedding", n: str = "n", mean: str = "mean") -> DataFrame:
    """`(key, n, mean)`: number and mean of each key's vectors, the same bits for any partitioning.

    Two steps: a task adds up the vectors of a key batch by batch, then the few sums of a key are added.
    A key that owns a large share of the rows sends one sum per batch, not its rows. All vectors of a key have one
    length; missing ones are left out. Rows without a key belong together.
    """
    chosen = rows.select(F.col(key).alias("key"), F.col(vector).alias("v")).filter(F.col("v").isNotNull())
    kind = chosen.schema["key"].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy()
            for length in np.unique(lengths):
                own = batch.filter(pa.array(lengths == length))
                encoded = own.column("key").dictionary_encode(null_encoding="encode")
                codes = encoded.indices.to_numpy()
                order = np.argsort(codes, kind="stable")
                starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
                limbs, rest = limbs_of(_matrix(own.column("v"))[order])
                sums = np.add.reduceat(limbs, starts, axis=1)
                yield pa.RecordBatch.from_pydict({
                    "key": own.column("key").take(pa.array(order[starts])),
                    "n": pa.array(np.diff(np.append(starts, len(order)))),
                    "limbs": _lists(np.moveaxis(sums, 0, 1).reshape(len(starts), -1)),
                    "rest": _lists(np.add.reduceat(rest, starts, axis=0)),
                })

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = None, None  # the last key's row, which the next batch may go on with
        for batch in batches:
            of = batch.schema.field("key").type
            lengths = batch.column("rest").value_lengths().to_numpy()
            cuts = [*np.flatnonzero(np.diff(lengths, prepend=-1)).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                own = batch.slice(start, end - start)
                codes = own.column("key").dictionary_encode(null_encoding="encode").indices.to_numpy()
                starts = np.flatnonzero(np.diff(codes, prepend=-1))
                keys = own.column("key").take(pa.array(starts)).to_pylist()
                counts = np.add.reduceat(own.column("n").to_numpy(), starts)
                rest = np.add.reduceat(_matrix(own.column("rest")), starts, axis=0)
                flat = own.column("limbs").flatten().to_numpy().reshape(len(codes), len(_POWERS), -1)
                limbs = np.moveaxis(np.add.reduceat(flat, starts, axis=0), 1, 0)
                if held is not None and held[0] == keys[0]:
                    counts[0] += held[1]
                    limbs[:, 0] += held[2]
                    rest[0] += held[3]
                elif held is not None:
                    yield _means([held[0]], np.array([held[1]]), held[2][:, None], held[3][None], of)
                held = keys[-1], counts[-1], limbs[:, -1], rest[-1]
                yield _means(keys[:-1], counts[:-1], limbs[:, :-1], rest[:-1], of)
        if held is not None:
            yield _means([held[0]], np.array([held[1]]), held[2][:, None], held[3][None], of)

    def _means(keys: list, counts: np.ndarray, limbs: np.ndarray, rest: np.ndarray, of: pa.DataType) -> pa.RecordBatch:
        means = value_of(limbs, rest) / counts[:, None]
        return pa.RecordBatch.from_pydict({"key": pa.array(keys, of), "n": pa.array(counts, pa.int64()), "mean": _lists(means)})

    sums = chosen.mapInArrow(partial, f"key {kind}, n long, limbs array<long>, rest array<double>")
    added = sums.repartition("key").sortWithinPartitions("key").mapInArrow(total, f"key {kind}, n long, mean array<double>")
    return added.select(F.col("key").alias(key), F.col("n").alias(n), F.col("mean").alias(mean))


def means_in_order(rows: DataFrame, keys: Sequence[str], vector: str, weight: str) -> DataFrame:
    """`(keys..., vector)`: weighted means of neighbouring rows with the same first key, added up in their order.

    For rows that were made from one row each and so still stand together; nothing is shuffled.
    """
    fields = [rows.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{vector}` array<double>"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (the row's keys, sum, weights)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, w = _matrix(batch.column(vector)), batch.column(weight).to_numpy().astype(np.float64)
            own = batch.column(keys[0]).to_pylist()
            starts = [i for i in range(len(own)) if i == 0 or own[i] != own[i - 1]]
            firsts, means = [], []
            for start, end in zip(starts, [*starts[1:], len(own)]):
                if held is None or start or held[0][0] != own[0]:
                    if held is not None:
                        firsts.append(held[0])
                        means.append((held[1] / held[2]).tolist())
                    held = (tuple(batch.column(k)[start].as_py() for k in keys), np.zeros(x.shape[1]), 0.0)
                summed, weights = held[1], held[2]
                for i in range(start, end):
                    summed, weights = summed + x[i] * w[i], weights + w[i]
                held = (held[0], summed, weights)
            yield out(firsts, means, batch)
        if held is not None:
            yield out([held[0]], [(held[1] / held[2]).tolist()], batch)

    def out(firsts: list[tuple], means: list[list[float]], like: pa.RecordBatch) -> pa.RecordBatch:
        columns = [pa.array([f[i] for f in firsts], like.schema.field(k).type) for i, k in enumerate(keys)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(means, pa.list_(pa.float64()))], names=[*keys, vector])

    return rows.select(*keys, vector, weight).mapInArrow(walk, schema)


def exact_mean(value: Column) -> Column:
    """Mean of numbers to 40 binary digits behind the point, as an aggregate that no order of the rows changes."""
    odd = F.isnan(value) | (F.abs(value) >= 2.0**80)
    fixed = F.round(F.when(~odd, value) * F.lit(2.0**_FIXED)).cast("decimal(38,0)")
    mean = F.sum(fixed).cast("double") / F.lit(2.0**_FIXED) / F.count(value)
    return F.when(F.count_if(odd) > 0, F.avg(value)).otherwise(mean)
