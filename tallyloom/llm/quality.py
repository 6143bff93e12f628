"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a whole text (shares of character kinds, word lengths, repetition, line structure) are cut
into quantile bins. Boosting cycles over the features; each step fits a shallow tree (at most four
leaves) on one feature's bins and adds it to that feature's lookup table. Then the pairs that best explain
what is left get two-dimensional tables in the same way. A score is the logistic function of a sum of
table entries, one gather per table.

Only the text enters a score. The tables are fitted on a bounded sample of labelled rows (`sample_rows`);
features and scores are computed for every row where it lies, without a shuffle. A null text counts as the
empty text, which has features and a score like any other. Repeated rows get equal scores. Without any
training label, or with one class only, every score is the smoothed share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import bounded_sample, tidy
from tallyloom.llm.labelled import held_out, training_labels
from tallyloom.operators.staging import stage

FEATURES = (
    "log_words", "log_chars", "word_length", "word_length_spread", "upper", "digit", "white", "sentence_marks", "commas",
    "marks", "symbols", "exclaim", "bars", "non_ascii", "char_entropy", "distinct_words", "top_word", "repeated_next",
    "symbol_words", "upper_words", "log_line_words", "repeated_lines", "short_words", "longest_word",
)
_CLASS = np.zeros(256, dtype=np.int64)  # kind of a byte
for _kind, _chars in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".?", b",;:", b"'\"-()/", b"#$%&*+<=>@[\\]^_`{}~", b"!", b"|"), 1
):
    _CLASS[list(_chars)] = _kind
_CLASS[128:] = 10
_SYMBOL = re.compile(r"[#$%&*+<=>@\[\\\]^_`{}~|!]{2,}")


def text_features(text: str | None) -> np.ndarray:
    """The feature vector of a whole text."""
    out = np.zeros(len(FEATURES))
    text = text or ""
    raw = text.encode("utf-8", "replace")
    if not raw:
        return out
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=seen, minlength=11) / len(raw)
    share = seen[seen > 0] / len(raw)
    words = text.split()
    n = len(words)
    out[0], out[1] = np.log1p(n), np.log1p(len(text))
    out[4:14] = kinds[[1, 2, 3, 4, 5, 6, 7, 8, 9, 10]]
    out[14] = -(share * np.log2(share)).sum()
    if n:
        lengths = np.fromiter(map(len, words), dtype=np.int32, count=n)
        counts = Counter(words)
        out[2], out[3] = lengths.mean(), lengths.std()
        out[15] = len(counts) / n**0.8  # distinct words grow slower than words
        out[16] = max(counts.values()) / n
        out[17] = sum(map(str.__eq__, words, words[1:])) / n
        out[18] = len(_SYMBOL.findall(text)) / n
        out[19] = sum(map(str.isupper, words)) / n
        out[22] = float((lengths <= 3).mean())
        out[23] = np.log1p(lengths.max())
    lines = [x for x in text.split("\n") if x.strip()]
    if lines:
        out[20] = np.log1p(n / len(lines))
        out[21] = 1 - sum(map(len, set(lines))) / sum(map(len, lines))
    return out


def with_features(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, features) of every row."""
    source = documents.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [text_features(x.as_py()) for x in batch.column(1)]
            flat = pa.array(np.concatenate(made) if made else np.zeros(0))
            offsets = pa.array(np.arange(len(made) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=[key, "features"])

    return source.mapInArrow(tidy(run), f"{key} {dict(source.dtypes)[key]}, features array<double>")


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables; `pairs` names the features of each two-dimensional table."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if self.edges:
            b = self.bins(x)
            for j, values in enumerate(self.tables):
                total += values[b[:, j]]
            for (i, j), values in zip(self.pairs, self.pair_tables):
                total += values[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _cut(gradient: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, int]:
    """Best gain and cut of a row of bins into a left and a right side; cut 0: none."""
    g, h = np.cumsum(gradient), np.cumsum(weight)
    if len(g) < 2:
        return 0.0, 0
    left = g[:-1] ** 2 / (h[:-1] + ridge)
    right = (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge)
    gain = left + right - g[-1] ** 2 / (h[-1] + ridge)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1 if gain[at] > 1e-9 else 0


def _tree(gradient: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values of a tree of depth two over one feature's bins, spread over the bins."""
    cuts = [0, len(gradient)]
    for _ in range(2):
        new = []
        for a, b in zip(cuts, cuts[1:]):
            _, at = _cut(gradient[a:b], weight[a:b], ridge)
            if at:
                new.append(a + at)
        cuts = sorted(set(cuts + new))
    values = np.zeros(len(gradient))
    for a, b in zip(cuts, cuts[1:]):
        values[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + ridge)
    return values


def _pair_tree(gradient: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The tree that cuts one feature and then, on each side, the other: the best of all first cuts, both ways round."""
    best = (-np.inf, np.zeros_like(gradient))
    for flip in (False, True):
        g, h = (gradient.T, weight.T) if flip else (gradient, weight)
        if len(g) < 2 or g.shape[1] < 2:
            continue
        sides = []
        for x in (g, h):  # running sums over both features: above and below each first cut, left and right of each second
            over = np.cumsum(np.cumsum(x, axis=0), axis=1)
            sides.append((over[:-1], over[-1:] - over[:-1]))
        total, cuts = np.zeros(len(g) - 1), []
        for gs, hs in zip(*sides):
            left, right = gs[:, :-1], gs[:, -1:] - gs[:, :-1]
            gain = left**2 / (hs[:, :-1] + ridge) + right**2 / (hs[:, -1:] - hs[:, :-1] + ridge)
            cut = np.argmax(gain, axis=1)
            cuts.append(cut)
            total += gain[np.arange(len(gain)), cut]
        at = int(np.argmax(total))
        gain = float(total[at] - g.sum() ** 2 / (h.sum() + ridge))
        if gain > best[0]:
            values = np.zeros_like(g)
            for (lo, hi), cut in zip(((0, at + 1), (at + 1, len(g))), cuts):
                for c, d in ((0, cut[at] + 1), (cut[at] + 1, g.shape[1])):
                    values[lo:hi, c:d] = g[lo:hi, c:d].sum() / (h[lo:hi, c:d].sum() + ridge)
            best = (gain, values.T if flip else values)
    return best


def fit_additive(
    x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, bins: int = 32, pairs: int = 8,
    pair_rounds: int = 60, ridge: float = 2.0,
) -> AdditiveModel:
    """Cyclic boosting of single features, then of the strongest pairs."""
    share = (y.sum() + 1) / (len(y) + 2)
    intercept = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return AdditiveModel(intercept, [], [], [], [])
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    model = AdditiveModel(intercept, edges, [np.zeros(len(e) + 1) for e in edges], [], [])
    b = model.bins(x)
    total = np.full(len(y), intercept)
    for _ in range(rounds):
        for j in range(width):
            p = 1 / (1 + np.exp(-total))
            n = len(model.tables[j])
            step = rate * _tree(
                np.bincount(b[:, j], weights=y - p, minlength=n), np.bincount(b[:, j], weights=p * (1 - p), minlength=n), ridge
            )
            model.tables[j] += step
            total += step[b[:, j]]

    def grids(i, j):
        p = 1 / (1 + np.exp(-total))
        shape = (len(model.tables[i]), len(model.tables[j]))
        cell = b[:, i] * shape[1] + b[:, j]
        make = lambda w: np.bincount(cell, weights=w, minlength=shape[0] * shape[1]).reshape(shape)
        return make(y - p), make(p * (1 - p))

    gains = [(-_pair_tree(*grids(i, j), ridge)[0], i, j) for i in range(width) for j in range(i + 1, width)]
    model.pairs = [(i, j) for _, i, j in sorted(gains)[:pairs]]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for at, (i, j) in enumerate(model.pairs):
            step = rate * _pair_tree(*grids(i, j), ridge)[1]
            model.pair_tables[at] += step
            total += step[b[:, i], b[:, j]]
    return model


def fit_quality(
    documents: DataFrame, labels: DataFrame, target: str = "quality", key: str = "doc_id", text: str = "text", sample_rows: int = 20_000
) -> AdditiveModel:
    """Fit on the labelled rows outside the held-out fold, at most `sample_rows` of them.

    Only the chosen rows get features here; their labels are few enough to broadcast, so no text is moved.
    An id that repeats counts once, by its smallest features, so the bound on ids is one on rows.
    """
    chosen = stage(bounded_sample(training_labels(labels, target, key), sample_rows, key))
    rows = with_features(documents.select(key, text).join(F.broadcast(chosen), key, "left_semi"), key, text)
    once = rows.groupBy(key).agg(F.min("features").alias("features"))
    got = once.toPandas().merge(chosen.toPandas(), on=key).sort_values(key, kind="stable")
    x = np.array(got["features"].tolist(), dtype=float).reshape(len(got), len(FEATURES))
    return fit_additive(x, got["y"].to_numpy(dtype=float))


def _scores(model: AdditiveModel, texts: pa.Array) -> np.ndarray:
    x = np.array([text_features(v.as_py()) for v in texts]).reshape(len(texts), len(FEATURES))
    return model.score(x)


def classify_quality(
    documents: DataFrame, labels: DataFrame, threshold: float = 0.7, key: str = "doc_id", text: str = "text",
    sample_rows: int = 20_000,
) -> DataFrame:
    """(key, held_out, score, predicted) of every document."""
    model = fit_quality(documents, labels, "quality", key, text, sample_rows)
    source = documents.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scores(model, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[key, "score", "predicted"]
            )

    scored = source.mapInArrow(tidy(run), f"{key} {dict(source.dtypes)[key]}, score double, predicted int")
    return scored.select(key, held_out(key).alias("held_out"), "score", "predicted")


def keep_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the classifier accepts, with their columns."""
    model = fit_quality(documents, labels, "quality", key, text)
    at = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(at)) >= threshold))

    return documents.mapInArrow(tidy(run), documents.schema)
