"""Linear classifiers on stacked problems: one pass over the rows serves all of them.

A row carries its features once and a training label per problem (-1: not a training row of it). Each pass
adds up losses and gradients of all problems that still move, in one matrix product per batch; tasks return
sums only, in blocks that are added up in parallel. The solver runs on the driver on vectors as long as the
coefficients, with one step length per problem. Few coefficients: second derivatives are added up as well and
Newton's method ends after some ten passes. Many: a limited-memory quasi-Newton method.

The same pass gives a certificate: the norm of the penalised gradient at any weights. The penalised loss is
strictly convex in the weights, so a norm near zero proves a fit, whoever made it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCK = 4_096  # numbers of a sum that travel together
_MEMORY = 10  # steps the solver remembers
_NEWTON = 256  # coefficients of a problem up to which second derivatives are added up
SCHEMA = "weights array<array<double>>, intercepts array<double>"


@dataclass(frozen=True)
class LinearModel:
    """One row of weights per class; a single row means two classes and is the weight of class 1."""

    weights: np.ndarray
    intercepts: np.ndarray

    @classmethod
    def of(cls, model) -> LinearModel:
        """From a fitted MLlib logistic regression."""
        return cls(model.coefficientMatrix.toArray(), model.interceptVector.toArray())

    @property
    def stacked(self) -> np.ndarray:
        return np.column_stack([self.weights, self.intercepts])

    def classify(self, x: np.ndarray) -> np.ndarray:
        scores = x @ self.weights.T + self.intercepts
        return (scores[:, 0] > 0).astype(np.int32) if len(self.weights) == 1 else scores.argmax(axis=1).astype(np.int32)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(self.weights.tolist(), self.intercepts.tolist())]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearModel:
        row = spark.read.schema(SCHEMA).parquet(path).first()
        return cls(np.array(row["weights"]), np.array(row["intercepts"]))


@dataclass(frozen=True)
class Certificate:
    """How good a fit is on its training rows; losses are means and without the penalty."""

    n_rows: int
    gradient_norm: float
    loss: float
    prior_loss: float
    """Loss of the shares of the classes, the best that a model without features can do."""
    mean_probabilities: tuple[float, ...] = ()
    """Of each class (of class 1 alone if there are two); at an optimum they are the shares."""


@dataclass(frozen=True)
class _Sums:
    counts: np.ndarray  # (problems, classes)
    loss: np.ndarray  # (problems,)
    gradient: np.ndarray  # (problems, outputs, features + 1)
    curvature: np.ndarray | None  # (problems, coefficients, coefficients)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _residuals(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(losses, derivatives by score, probabilities) of rows x problems x outputs; rows without a label count nothing."""
    known = labels >= 0
    if scores.shape[2] == 1:
        z, y = scores[:, :, 0], (labels > 0).astype(np.float64)
        losses = np.logaddexp(0, z) - y * z
        shares = np.exp(-np.logaddexp(0, -z))[:, :, None]
        derivatives = shares - y[:, :, None]
    else:
        top = scores.max(axis=2, keepdims=True)
        powers = np.exp(scores - top)
        total = powers.sum(axis=2, keepdims=True)
        at = np.maximum(labels, 0)[:, :, None]
        losses = (np.log(total) + top - np.take_along_axis(scores, at, 2))[:, :, 0]
        shares = powers / total
        derivatives = shares.copy()
        np.put_along_axis(derivatives, at, np.take_along_axis(derivatives, at, 2) - 1, 2)
    return losses * known, derivatives * known[:, :, None], shares * known[:, :, None]


def _curved(x: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Second derivatives of the summed losses of one problem; masked rows have shares of zero."""
    n, outputs = shares.shape
    if outputs == 1:
        return x.T @ (x * (shares * (1 - shares)))
    spread = (x[:, None, :] * shares[:, :, None]).reshape(n, -1)
    out = -spread.T @ spread
    width = x.shape[1]
    for k in range(outputs):
        own = slice(k * width, (k + 1) * width)
        out[own, own] += x.T @ spread[:, own]
    return out


def _pass(
    rows: DataFrame, features: str, labels: str, stacked: np.ndarray, problems: Sequence[int], classes: int, curvature: bool = False
) -> _Sums:
    """Counts, losses and derivatives of some of the problems at given weights, without the penalty."""
    m, outputs, width = stacked.shape
    size = outputs * width
    chosen = np.array(problems, dtype=np.int64)
    flat_weights = stacked.reshape(m * outputs, width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, loss, gradient = np.zeros((m, classes)), np.zeros(m), np.zeros((m * outputs, width))
        curved = np.zeros((m if curvature else 0, size, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([_matrix(batch.column(0)), np.ones(batch.num_rows)])
            y = _matrix(batch.column(1)).astype(np.int64)[:, chosen]
            losses, derivatives, shares = _residuals((x @ flat_weights.T).reshape(len(x), m, outputs), y)
            loss += losses.sum(axis=0)
            gradient += derivatives.reshape(len(x), -1).T @ x
            for c in range(classes):
                counts[:, c] += (y == c).sum(axis=0)
            for problem in range(len(curved)):
                curved[problem] += _curved(x, shares[:, problem])
        flat = np.concatenate([counts.ravel(), loss, gradient.ravel(), curved.ravel()])
        starts = range(0, len(flat), _BLOCK)
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(range(len(starts)), pa.int32()),
            "v": pa.array([flat[s : s + _BLOCK].tolist() for s in starts], pa.list_(pa.float64())),
        })

    parts = rows.select(features, labels).mapInArrow(add, "block int, v array<double>")
    numbers = parts.select("block", F.posexplode("v").alias("at", "x")).groupBy("block", "at").agg(F.sum("x").alias("x"))
    flat = np.zeros(m * (classes + 1 + size + (size * size if curvature else 0)))
    for r in numbers.collect():  # as many as counts, losses, coefficients and, if they are few, their pairs
        flat[r["block"] * _BLOCK + r["at"]] = r["x"]
    counts, loss, gradient, curved = np.split(flat, np.cumsum([m * classes, m, m * size]))
    return _Sums(
        counts.reshape(m, classes), loss, gradient.reshape(m, outputs, width), curved.reshape(m, size, size) if curvature else None
    )


def _penalised(sums: _Sums, stacked: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Objective and gradient of each problem: mean loss plus half the penalty times the squared weights."""
    n = np.maximum(sums.counts.sum(axis=1), 1)
    weights = stacked.copy()
    weights[:, :, -1] = 0  # intercepts are free
    value = sums.loss / n + penalty / 2 * (weights**2).sum(axis=(1, 2))
    return value, sums.gradient / n[:, None, None] + penalty[:, None, None] * weights


def _newton(sums: _Sums, at: int, gradient: np.ndarray, penalty: float) -> np.ndarray:
    """The step to the minimum of the quadratic form; intercepts that only shift together stay put."""
    outputs, width = gradient.shape
    free = np.tile(np.arange(width) == width - 1, outputs)
    matrix = sums.curvature[at] / max(sums.counts[at].sum(), 1) + np.diag(np.where(free, 0, penalty))
    scale = 1 / np.sqrt(np.maximum(np.diag(matrix), 1e-300))
    scale[np.diag(matrix) <= 0] = 0
    solved = np.linalg.lstsq(matrix * scale[:, None] * scale, gradient.ravel() * scale, rcond=1e-13)[0]
    return (-solved * scale).reshape(outputs, width)


def _certificates(sums: _Sums, gradient: np.ndarray) -> list[Certificate]:
    out = []
    for counts, loss, g in zip(sums.counts, sums.loss, gradient):
        n = int(counts.sum())
        shares = counts[counts > 0] / max(n, 1)
        own = counts[1:] if len(g) == 1 else counts
        out.append(Certificate(
            n, float(np.sqrt((g**2).sum())), float(loss / max(n, 1)), float(-(shares * np.log(shares)).sum()),
            tuple((own / max(n, 1) + g[:, -1]).tolist()),
        ))
    return out


def certify(model: LinearModel, rows: DataFrame, features: str, label: str, penalty: float) -> Certificate:
    """One pass over the training rows."""
    one = rows.select(features, F.array(F.col(label).cast("int")).alias("_labels"))
    stacked = model.stacked[None]
    sums = _pass(one, features, "_labels", stacked, [0], max(2, len(model.weights)))
    return _certificates(sums, _penalised(sums, stacked, np.array([penalty]))[1])[0]


class _Descent:
    """One problem: proposes weights, is told value and gradient there."""

    def __init__(self, size: int):
        self.at = np.zeros(size)
        self.value, self.gradient, self.direction, self.step = None, None, None, 0.0
        self.steps: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=_MEMORY)

    def ask(self) -> np.ndarray:
        return self.at if self.value is None else self.at + self.step * self.direction

    def tell(self, value: float, gradient: np.ndarray, direction: np.ndarray | None = None) -> bool:
        """Whether the proposal is taken; otherwise the next one is nearer. `direction` is where to go from it, if known."""
        if self.value is not None:
            slope = self.step * float(self.gradient @ self.direction)
            if not value <= self.value + 1e-4 * slope + 1e-15 * abs(self.value):
                shorter = -slope / (2 * (value - self.value - slope)) if np.isfinite(value) else 0.1
                self.step *= min(0.5, max(0.1, shorter))
                return False
            moved = self.ask() - self.at
            change = gradient - self.gradient
            if moved @ change > 1e-14 * (moved @ moved):
                self.steps.append((moved, change))
            self.at = self.at + moved
        self.value, self.gradient = value, gradient
        if direction is not None and direction @ gradient < 0:
            self.direction, self.step = direction, 1.0
            return True
        self.direction, self.step = self._descend(), 1.0
        if not self.steps:
            self.step = 1 / max(1.0, float(np.linalg.norm(gradient)))
        return True

    def _descend(self) -> np.ndarray:
        d, used = -self.gradient, []
        for s, y in reversed(self.steps):
            a = (s @ d) / (s @ y)
            used.append(a)
            d = d - a * y
        if self.steps:
            s, y = self.steps[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(self.steps, reversed(used)):
            d = d + s * (a - (y @ d) / (s @ y))
        return d

    @property
    def stuck(self) -> bool:
        return self.step < 1e-12


def fit_stacked(
    rows: DataFrame,
    problems: int,
    classes: int,
    features: str = "input_ids",
    labels: str = "labels",
    penalty: float | None = None,
    tolerance: float = 1e-6,
    max_passes: int = 300,
) -> list[tuple[LinearModel, Certificate]]:
    """A penalised logistic regression for each problem, from shared passes over the rows.

    `labels` is an array with the training label of the row in each problem, -1 where it has none. Without
    `penalty` that of a problem is 1 / its training rows. A problem ends once the norm of its penalised
    gradient is below the tolerance. Two classes have one row of weights. Columns are centred and scaled
    inside, which changes the speed and not the result. A problem without rows has zero weights.
    """
    outputs = 1 if classes <= 2 else classes
    classes = max(classes, 2)
    vectors = rows.select(F.lit(0).alias("all"), array_to_vector(F.col(features).cast("array<double>")).alias("v"))
    described = vectors.groupBy("all").agg(
        Summarizer.metrics("mean", "variance").summary(F.col("v")).alias("s")
    ).select(vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance")).first()
    if described is None:
        empty = LinearModel(np.zeros((outputs, 0)), np.zeros(outputs))
        return [(empty, Certificate(0, 0.0, 0.0, 0.0))] * problems
    centre = np.array(described["mean"])
    scale = np.sqrt(np.nan_to_num(np.array(described["variance"])))
    scale[scale == 0] = 1
    width = len(centre) + 1

    def outer(at: np.ndarray) -> np.ndarray:
        weights = at.reshape(outputs, width).copy()
        weights[:, :-1] /= scale
        weights[:, -1] -= weights[:, :-1] @ centre
        return weights

    def inner_gradient(g: np.ndarray) -> np.ndarray:
        out = g.copy()
        out[:, :-1] = (g[:, :-1] - np.outer(g[:, -1], centre)) / scale
        return out.ravel()

    def inner(direction: np.ndarray) -> np.ndarray:
        out = direction.copy()
        out[:, -1] += direction[:, :-1] @ centre
        out[:, :-1] *= scale
        return out.ravel()

    curvature = outputs * width <= _NEWTON
    found: dict[int, tuple[LinearModel, Certificate]] = {}
    descents = {p: _Descent(outputs * width) for p in range(problems)}
    for _ in range(max_passes):
        moving = sorted(descents)
        stacked = np.stack([outer(descents[p].ask()) for p in moving])
        sums = _pass(rows, features, labels, stacked, moving, classes, curvature)
        n = np.maximum(sums.counts.sum(axis=1), 1)
        penalties = 1 / n if penalty is None else np.full(len(moving), penalty)
        value, gradient = _penalised(sums, stacked, penalties)
        proofs = _certificates(sums, gradient)
        for at, p in enumerate(moving):
            step = inner(_newton(sums, at, gradient[at], penalties[at])) if curvature else None
            taken = descents[p].tell(float(value[at]), inner_gradient(gradient[at]), step)
            if taken:
                found[p] = LinearModel(stacked[at][:, :-1], stacked[at][:, -1]), proofs[at]
            if (taken and proofs[at].gradient_norm <= tolerance) or proofs[at].n_rows == 0 or descents[p].stuck:
                del descents[p]
        if not descents:
            break
    return [found[p] for p in range(problems)]


def predict_stacked(rows: DataFrame, models: Sequence[LinearModel], features: str = "input_ids", name: str = "predictions") -> DataFrame:
    """Add an array with the class of the row in each model. Arrow batches in and out, no shuffle."""

    @F.pandas_udf("array<int>")
    def classes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            x = np.stack(column.to_list()).astype(np.float64) if len(column) else np.zeros((0, models[0].weights.shape[1]))
            yield pd.Series(list(np.column_stack([m.classify(x) for m in models])), index=column.index)

    return rows.withColumn(name, classes(features))


def class_mean_model(rows: DataFrame, features: str, label: str, classes: int) -> LinearModel:
    """The linear form of the nearest class mean: one aggregation, no solver. A class without rows is never chosen."""
    means = rows.groupBy(F.col(label).alias("label")).agg(
        Summarizer.metrics("mean").summary(array_to_vector(F.col(features).cast("array<double>"))).alias("s")
    )
    found = {r["label"]: np.array(r["m"]) for r in means.select("label", vector_to_array("s.mean").alias("m")).collect()}
    width = len(next(iter(found.values()))) if found else 0
    weights, intercepts = np.zeros((classes, width)), np.full(classes, -np.inf)
    for c, mean in found.items():
        weights[c], intercepts[c] = mean, -(mean @ mean) / 2
    return LinearModel(weights, intercepts)
