"""Language-model scores from a hidden Markov model.

Words are counted over all training texts. The most frequent ones, at most `vocabulary` and words of equal
count together, are symbols of the model; every other word, seen or not, belongs to one of `rare` classes by
a hash, and its probability inside the class follows its own smoothed count, so every word of every text has
its exact probability. States are trained by Baum-Welch: each task runs scaled forward and backward passes
over its texts and adds up expected counts, which are summed by symbol over all tasks; the new tables come
from those sums and a Dirichlet prior proportional to the word frequencies. A score is the log10 likelihood of the whole word sequence with its
end token, from the scaled forward recursion.

Texts are encoded once into symbol numbers and written; passes read those. Texts of similar length advance
together through the recursion; their tokens are laid out by time, so a step works on consecutive rows of
arrays that are looked up and added up once for the whole batch. What a task holds is bounded: the tables have
(vocabulary + rare) rows of `states` numbers, and long texts are worked off piece by piece in the forward
direction; the backward pass keeps the values of one text at a time at most, or of a batch of bounded size.
Expected counts are taken in single precision and added up in double; scores are in double. Counts of words
outside the vocabulary reach the documents by a join on the word, with a document's repeats counted before.

Defined cases: a null text is the empty text: one token, its end. Without training texts counts are zero,
and every word has the same smoothed probability. Rows that repeat an id are scored each. A row without an
id is hashed as the empty text. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import crc_remainder, tidy
from tallyloom.operators.staging import stage

END = 0  # symbol of the end of a text
_TOKENS = 400_000  # tokens of a batch in the recursions


def words_of(text: str | None) -> list[bytes]:
    """Words without ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


def word_key(word: bytes) -> int:
    """A word as a signed 64-bit hash, the form in which words are counted and joined."""
    return xxhash.xxh64_intdigest(word) - (1 << 63)


class Codes(dict):
    """Symbol of a word: its own if it is frequent, else that of its class. Words met before are remembered."""

    def __init__(self, code: dict[int, int], symbols: int, rare: int):
        super().__init__()
        self.code, self.symbols, self.rare = code, symbols, rare

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        key = word_key(word)
        self[word] = found = self.code.get(key) or self.symbols + key % self.rare
        return found


def word_counts(documents: DataFrame, text: str, training: str) -> DataFrame:
    """(word, n): occurrences of every word (by key) in the training texts; sums are combined in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush():
            keys = np.fromiter(map(word_key, counts), dtype=np.int64, count=len(counts))
            out = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                counts.update(words_of(value.as_py()))
                if len(counts) > 500_000:
                    yield flush()
        yield flush()

    parts = documents.filter(training).select(text).mapInArrow(tidy(run), "word long, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Tables of the model: start (S), move (S x S), emit (symbols x S), all probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def batches_of(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in batches of similar length, longest first, each of bounded size."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, min(len(order) - at, int(_TOKENS // max(1, lengths[order[at]]))))
        yield order[at:at + n]
        at += n


class Layout:
    """Tokens of rows sorted by falling length, by time and then by row: step t holds rows 0 to alive[t] - 1."""

    def __init__(self, offsets: np.ndarray, rows: np.ndarray):
        lengths = offsets[rows + 1] - offsets[rows]
        self.starts = offsets[rows]
        self.alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
        self.first = np.concatenate(([0], np.cumsum(self.alive)))

    def pieces(self) -> Iterator[tuple[int, int]]:
        """Steps in runs of bounded numbers of tokens."""
        at, steps = 0, len(self.alive)
        while at < steps:
            end = max(at + 1, int(np.searchsorted(self.first, self.first[at] + _TOKENS, side="right")) - 1)
            yield at, min(end, steps)
            at = min(end, steps)

    def rows(self, at: int, end: int) -> np.ndarray:
        """Row of each token of some steps."""
        n = self.alive[at:end]
        return np.arange(self.first[at], self.first[end]) - np.repeat(self.first[at:end], n)

    def tokens(self, codes: np.ndarray, at: int, end: int) -> np.ndarray:
        """Symbols of some steps."""
        return codes[self.starts[self.rows(at, end)] + np.repeat(np.arange(at, end), self.alive[at:end])]


def _advance(model: Model, layout: Layout, at: int, end: int, emitted: np.ndarray, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(scaled forward values, scales) of some steps; `state` is that of the step before."""
    values, scales = np.empty_like(emitted), np.empty(len(emitted), dtype=emitted.dtype)
    ones = np.ones(emitted.shape[1], dtype=emitted.dtype)
    for t in range(at, end):
        own = slice(layout.first[t] - layout.first[at], layout.first[t + 1] - layout.first[at])
        value = values[own]
        if state is None:
            np.multiply(emitted[own], model.start, out=value)
        else:
            np.matmul(state[: len(value)], model.move, out=value)
            value *= emitted[own]
        value /= np.dot(value, ones, out=scales[own])[:, None]
        state = value
    return values, scales


def forward(model: Model, codes: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log likelihoods of rows sorted by falling length; codes[offsets[r]:offsets[r + 1]] are the symbols of row r."""
    layout, log, state = Layout(offsets, rows), np.zeros(len(rows)), None
    for at, end in layout.pieces():
        values, scales = _advance(model, layout, at, end, model.emit[layout.tokens(codes, at, end)], state)
        log += np.bincount(layout.rows(at, end), weights=np.log(scales), minlength=len(rows))
        state = values[len(values) - layout.alive[end - 1]:]
    return log


def expected_counts(model: Model, codes: np.ndarray, offsets: np.ndarray, rows: np.ndarray, emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> None:
    """Add the expected counts of some rows to the three tables, in the precision of the model's tables."""
    layout = Layout(offsets, rows)
    alive, first, steps = layout.alive, layout.first, len(layout.alive)
    symbols = layout.tokens(codes, 0, steps)
    ahead = model.emit[symbols]
    values, scales = _advance(model, layout, 0, steps, ahead, None)
    ahead /= scales[:, None]
    # Scaled backward values; a row that ends has ones. `ahead` becomes what a step sends to the one before.
    back, turned = np.ones_like(values), np.ascontiguousarray(model.move.T)
    for t in range(steps - 1, 0, -1):
        sent = ahead[first[t]:first[t + 1]]
        sent *= back[first[t]:first[t + 1]]
        np.matmul(sent, turned, out=back[first[t - 1]:first[t - 1] + alive[t]])
    back *= values
    norm = back @ np.ones(back.shape[1], dtype=back.dtype)  # 1 but for rounding
    back /= norm[:, None]
    values /= norm[:, None]
    start += back[: alive[0]].sum(axis=0, dtype=np.float64)
    before = np.arange(alive[0], len(symbols)) - np.repeat(alive[:-1], alive[1:])  # the same row, a step earlier
    for at in range(0, len(before), 1 << 16):
        move += model.move * (values[before[at:at + (1 << 16)]].T @ ahead[alive[0] + at:alive[0] + at + (1 << 16)])
    for s in range(back.shape[1]):
        emit[:, s] += np.bincount(symbols, weights=back[:, s], minlength=len(emit))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)


def train(encoded: DataFrame, weight: np.ndarray, states: int, rounds: int, prior: float, seed: int) -> Model:
    """Baum-Welch over the encoded training texts; `weight` holds the frequency of each symbol."""
    rng = np.random.default_rng(seed)
    share = (weight + 0.1) / (weight + 0.1).sum()
    emit = share[:, None] * rng.uniform(0.5, 1.5, (len(weight), states))
    model = Model(np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1)), emit / emit.sum(axis=0))
    np.fill_diagonal(model.move, 0.9 if states > 1 else 1.0)
    spark = encoded.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        size = len(weight)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = sent.value
            model = Model(*(x.astype(np.float32) for x in (tables.start, tables.move, tables.emit)))
            e, m, s = np.zeros((size, states)), np.zeros((states, states)), np.zeros(states)
            for batch in batches:
                codes, offsets = _lists(batch.column(0))
                for rows in batches_of(np.diff(offsets)):
                    expected_counts(model, codes, offsets, rows, e, m, s)
            seen = np.flatnonzero(e.any(axis=1))
            table = np.concatenate([e[seen], m, s[None, :]])
            names = np.concatenate([seen, size + np.arange(states + 1)])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1) * states, pa.int32()), pa.array(table.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(names), flat], names=["symbol", "counts"])

        parts = encoded.select("codes").mapInArrow(tidy(run, None), "symbol long, counts array<float>")
        sums = parts.groupBy("symbol").agg(F.array(*[F.sum(F.col("counts")[i].cast("double")) for i in range(states)]).alias("counts"))
        got = sums.toPandas()  # symbols + states + 1 rows at most
        total = np.zeros((size + states + 1, states))
        if len(got):
            total[got["symbol"].to_numpy()] = np.array(got["counts"].tolist())
        emit = total[:size] + prior * share[:, None]
        move = total[size:size + states] + 1
        start = total[size + states] + 1
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
        sent.unpersist()
    return model


def score_documents(
    documents: DataFrame, key: str = "doc_id", text: str = "text", states: int = 8, rounds: int = 4, vocabulary: int = 32_768,
    rare: int = 64, prior: float = 2_000.0, folds: int = 10, held_out: int = 0, seed: int = 5,
) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = documents.sparkSession
    source = documents.select(F.col(key).alias("id"), F.col(text).alias("text"), (crc_remainder(key, folds) == held_out).alias("held"))
    counts = stage(word_counts(source, "text", "NOT held"))
    seen = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = source.filter("NOT held").count()
    total, distinct = int(seen[0]) + ends, int(seen[1]) + (1 if ends else 0)
    floor = 0.1
    whole = total + floor * (distinct + 1)
    # The least count of a symbol: all words of that count or more fit into the vocabulary.
    spectrum = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(vocabulary + 1).collect()
    least, room = 1 << 62, vocabulary
    for row in spectrum:
        room -= row["words"]
        if room < 0:
            break
        least = row["n"]
    frequent = stage(counts.filter(F.col("n") >= least))
    top = frequent.toPandas().sort_values(["n", "word"], ascending=[False, True])  # `vocabulary` rows at most
    code = {int(w): i + 1 for i, w in enumerate(top["word"])}
    known = np.concatenate(([ends], top["n"].to_numpy(dtype=float)))
    # Rare words: those of the counts that are not frequent, by class.
    rest = counts.join(F.broadcast(frequent.select("word")), "word", "left_anti")
    classes = {int(r["class"]): (int(r["n"]), int(r["v"])) for r in rest.groupBy(F.pmod("word", F.lit(rare)).alias("class"))
               .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    held = np.array([classes.get(c, (0, 0)) for c in range(rare)], dtype=float)
    size = len(known) + rare
    logs = np.log10((known + floor) / whole)
    table = spark.sparkContext.broadcast((code, logs))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, logs = table.value
        find = Codes(code, len(logs), rare)
        for batch in batches:
            codes, known_score, rare_words, rare_counts, lengths = [], [], [], [], []
            for value in batch.column(1):
                words = words_of(value.as_py())
                row = np.full(len(words) + 1, END, dtype=np.int32)
                row[:-1] = np.fromiter(map(find.__getitem__, words), dtype=np.int32, count=len(words))
                frequent = row < len(logs)
                others = Counter(words[i] for i in np.flatnonzero(~frequent).tolist())
                usual = row[frequent]
                codes.append(row)
                lengths.append(len(row))
                known_score.append((float(logs[usual].sum()), len(usual) if ends else len(usual) - 1))
                rare_words.append(list(map(word_key, others)))
                rare_counts.append(list(others.values()))
            offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
            flat = pa.array(np.concatenate(codes) if codes else np.zeros(0, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.ListArray.from_arrays(offsets, flat), pa.array([k[0] for k in known_score], pa.float64()),
                    pa.array([k[1] for k in known_score], pa.int64()), pa.array(rare_words, pa.list_(pa.int64())), pa.array(rare_counts, pa.list_(pa.int32())),
                ],
                names=["id", "held", "codes", "base", "known", "words", "times"],
            )

    kind = dict(source.dtypes)["id"]
    encoded = stage(
        source.select("id", "text", "held").mapInArrow(
            tidy(encode), f"id {kind}, held boolean, codes array<int>, base double, known long, words array<long>, times array<int>"
        ).withColumn("row", F.monotonically_increasing_id())
    )
    # The rare words of each document: their counts, for the base score and for their place in the class.
    pairs = encoded.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    counted = pairs.join(rest, "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    mass = F.create_map(*[F.lit(x) for c in range(rare) for x in (c, float(held[c, 0] + floor * (held[c, 1] + 1)))])
    inside = F.log10((F.col("c") + floor) / mass[F.pmod("word", F.lit(rare)).cast("int")])
    per_row = counted.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.col("c") + floor) / whole)).alias("rare_base"),
        F.sum(F.col("times") * inside).alias("rare_inside"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    weight = np.concatenate([known, held[:, 0]])
    model = train(encoded.filter("NOT held"), weight, states, rounds, prior, seed)
    final = spark.sparkContext.broadcast(model)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, offsets = _lists(batch.column(1))
            out = np.zeros(batch.num_rows)
            for rows in batches_of(np.diff(offsets)):
                out[rows] = forward(final.value, codes, offsets, rows) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["row", "likelihood"])

    del size
    scored = encoded.select("row", "codes").mapInArrow(tidy(likelihood, None), "row long, likelihood double")
    plain = encoded.select("row", "id", "held", "base", "known", F.size("codes").cast("long").alias("n_tokens"))
    joined = plain.join(scored, "row").join(per_row, "row", "left")
    nought = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        F.col("id").alias(key), F.col("held").alias("held_out"), "n_tokens", (F.col("known") + nought("rare_known")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + nought("rare_base")).alias("base_score"),
        (F.col("likelihood") + nought("rare_inside")).alias("score"),
    )
