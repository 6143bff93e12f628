"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct character n-grams (3 to 7 bytes of the lower-cased text, white
space squeezed to one space) that it holds, hashed to `2 ** bits` buckets. Document counts of every bucket
are taken over the labelled training rows of both classes (`count_rows` at most), in parallel, and give the smoothed log-count
ratio r of each bucket. Buckets are ranked by how far their counts differ from chance; the `kept` best
are features with value r, and a logistic regression on a bounded sample of training rows (`sample_rows`)
gives their weights. A score is the logistic function of the sum of weight times ratio over the features
present in the whole text.

Only the text enters a score. A null text counts as the empty text: its score is that of the intercept.
Repeated rows get equal scores. Without labels, or with one class only, every score is the smoothed share
of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import bounded_sample, tidy
from tallyloom.llm.labelled import held_out, training_labels
from tallyloom.operators.staging import stage

ORDERS = (3, 4, 5, 6, 7)
_PIECE = 1 << 20  # bytes hashed at a time, so that a long text needs bounded memory


@dataclass
class NgramModel:
    bits: int
    intercept: float
    slot: np.ndarray  # bucket -> feature, -1: none
    weights: np.ndarray  # weight times ratio of each feature

    def present(self, text: str | None) -> np.ndarray:
        """Distinct features of a whole text."""
        found = [np.unique(f[f >= 0]) for f in (self.slot[h] for h in ngram_buckets(text, self.bits))]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)

    def score(self, text: str | None) -> float:
        total = self.intercept + float(self.weights[self.present(text)].sum()) if len(self.weights) else self.intercept
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def ngram_buckets(text: str | None, bits: int) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text, piece by piece; pieces overlap so that no n-gram is missed."""
    words = (text or "").lower().split()
    if not words:
        return
    raw = np.frombuffer(f" {' '.join(words)} ".encode("utf-8", "replace"), dtype=np.uint8)
    longest = max(ORDERS)
    shift = np.uint64(64 - bits)
    for start in range(0, len(raw), _PIECE):
        part = raw[start:start + _PIECE + longest - 1].astype(np.uint64)
        rolling = part.copy()
        for n in range(2, longest + 1):
            if len(part) < n:
                break
            rolling = (rolling[:-1] << np.uint64(8)) | part[n - 1:]
            if n in ORDERS:
                fresh = rolling[: _PIECE] if start + _PIECE < len(raw) else rolling
                yield (((fresh + np.uint64(n << 48)) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)


def ngram_document_counts(labelled: DataFrame, bits: int, text: str = "text") -> DataFrame:
    """(bucket, negative, positive): documents of each class that hold an n-gram of the bucket; -1: all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << bits), dtype=np.int32)
        seen = np.zeros(2, dtype=np.int64)
        for batch in batches:
            for value, y in zip(batch.column(0), batch.column(1).to_pylist()):
                found = [np.unique(h) for h in ngram_buckets(value.as_py(), bits)]
                if found:
                    counts[y][np.unique(np.concatenate(found))] += 1
                seen[y] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), *(pa.array(np.append(counts[y][at], seen[y]), pa.int64()) for y in (0, 1))],
            names=["bucket", "negative", "positive"],
        )

    parts = labelled.select(text, "y").mapInArrow(tidy(run), "bucket long, negative long, positive long")
    return parts.groupBy("bucket").agg(F.sum("negative").alias("negative"), F.sum("positive").alias("positive"))


def _fit_weights(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, ridge: float, steps: int) -> tuple[float, np.ndarray]:
    """Logistic regression by accelerated gradient steps on the scaled presence features."""
    n, width = len(rows), len(ratio)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    column = np.concatenate(rows)
    value = ratio[column]
    times = lambda w: np.bincount(row, weights=w[column] * value, minlength=n) + w[width]
    back = lambda z: np.append(np.bincount(column, weights=z[row] * value, minlength=width), z.sum())
    direction = np.ones(width + 1)
    for _ in range(20):  # the largest curvature of the loss, by power iteration
        direction = back(times(direction / np.linalg.norm(direction)))
    step = 1 / (1.1 * np.linalg.norm(direction) / 4 + ridge)
    w = np.zeros(width + 1)
    look, speed = w, 1.0
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-np.clip(times(look), -35, 35))) - y
        new = look - step * (back(miss) + ridge * np.append(look[:width], 0.0))
        after = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        look = new + (speed - 1) / after * (new - w)
        w, speed = new, after
    bias, w = float(w[width]), w[:width]
    return bias, w


def fit_toxicity(
    documents: DataFrame, labels: DataFrame, target: str = "toxic", key: str = "doc_id", text: str = "text", bits: int = 20,
    kept: int = 4096, count_rows: int = 200_000, sample_rows: int = 6_000, ridge: float = 1.0, steps: int = 300,
) -> NgramModel:
    """Ratios from at most `count_rows` labelled training rows, weights from at most `sample_rows` of them.

    The chosen labels are few enough to broadcast, so no text is moved. For the weights an id that repeats counts
    once, by its smallest n-grams, so the bound on ids is one on rows; ratios count every row.
    """
    known = training_labels(labels, target, key)
    labelled = documents.select(key, text).join(F.broadcast(bounded_sample(known, count_rows, key)), key)
    table = stage(ngram_document_counts(labelled, bits, text))
    total = table.filter("bucket = -1").first()
    negative, positive = (int(total["negative"]), int(total["positive"])) if total else (0, 0)
    share = (positive + 1) / (negative + positive + 2)
    intercept = float(np.log(share / (1 - share)))
    empty = NgramModel(bits, intercept, np.full(1 << bits, -1, dtype=np.int32), np.zeros(0))
    if not negative or not positive:
        return empty
    # Squared deviation of the positive count from what chance expects, over its variance.
    rate = positive / (negative + positive)
    seen = F.col("negative") + F.col("positive")
    surprise = F.pow(F.col("positive") - seen * rate, 2) / (seen * rate * (1 - rate) + 1)
    best = (
        table.filter("bucket >= 0").withColumn("surprise", surprise).orderBy(F.desc("surprise"), "bucket").limit(kept).toPandas()
    )
    p = (best["positive"].to_numpy() + 0.5) / (positive + 1)
    q = (best["negative"].to_numpy() + 0.5) / (negative + 1)
    ratio = np.log(p / q)
    slot = empty.slot.copy()
    slot[best["bucket"].to_numpy()] = np.arange(len(best))
    shape = NgramModel(bits, intercept, slot, np.zeros(len(best)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shape.present(v.as_py()) for v in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found, batch.column(2)], names=[key, "found", "y"])

    kind = dict(documents.dtypes)[key]
    chosen = bounded_sample(known, sample_rows, key)
    rows = (
        documents.select(key, text).join(F.broadcast(chosen), key).select(key, text, "y")
        .mapInArrow(tidy(find), f"{key} {kind}, found array<int>, y int").groupBy(key, "y").agg(F.min("found").alias("found")).toPandas()
    )
    rows = rows.sort_values(key, kind="stable").reset_index(drop=True)
    found = [np.asarray(f, dtype=np.int64) for f in rows["found"]]
    if not found:
        return empty
    bias, w = _fit_weights(found, rows["y"].to_numpy(dtype=float), ratio, ridge, steps)
    return NgramModel(bits, bias, slot, w * ratio)


def classify_toxicity(
    documents: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text", **fit
) -> DataFrame:
    """(key, held_out, score, predicted) of every document."""
    model = fit_toxicity(documents, labels, key=key, text=text, **fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([model.score(v.as_py()) for v in batch.column(1)], dtype=float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[key, "score", "predicted"]
            )

    source = documents.select(key, text)
    scored = source.mapInArrow(tidy(run), f"{key} {dict(source.dtypes)[key]}, score double, predicted int")
    return scored.select(key, held_out(key).alias("held_out"), "score", "predicted")
