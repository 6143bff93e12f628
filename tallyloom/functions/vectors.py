"""Vector and logit expressions over array columns, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _double(values: Column) -> Column:
    return values.cast("array<double>")


def squared_l2(x: Column, y: Column) -> Column:
    """Squared Euclidean distance; fails on vectors of different length."""
    total = F.aggregate(
        F.zip_with(_double(x), _double(y), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v
    )
    return F.when(F.size(x) == F.size(y), total).otherwise(
        F.raise_error(F.lit("vectors differ in length")).cast("double")
    )


def dot(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(_double(x), _double(y), lambda a, b: a * b))


def cosine_distance(x: Column, y: Column) -> Column:
    return F.lit(1.0) - dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def distance(name: str, x: Column, y: Column) -> Column:
    """Distance chosen by name, as used by the triplet loss."""
    if name == "l2":
        return squared_l2(x, y)
    if name in ("cosine", "cosine_distance"):
        return cosine_distance(x, y)
    raise ValueError(f"unknown distance {name!r}")


def argmax(values: Column) -> Column:
    """0-based position of the largest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax_cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax(logits)[label], shifted by the maximum; null for labels outside the logits."""
    top = F.array_max(logits)
    log_sum = top + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v - top)))
    return log_sum - F.when(label >= 0, F.get(logits, label.cast("int")))


def triplet_hinge(d_pos: Column, d_neg: Column, threshold: float) -> Column:
    return F.greatest(F.lit(0.0), d_pos - d_neg + F.lit(float(threshold)))


def linear_logits(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """xW + b with W given as one weight list per output class."""
    return F.array(
        *[
            dot(x, F.array(*[F.lit(float(w)) for w in row])) + F.lit(float(b))
            for row, b in zip(weights, bias, strict=True)
        ]
    )
