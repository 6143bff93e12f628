"""Substring dedup: repeated paragraphs and passages across documents.

Paragraphs are lines of at least `least` words, and runs of shorter lines without an empty line between them
that have as many words together. Each gets a MinHash signature over its distinct five-word shingles; the
signature is cut into bands that are tuned so that a pair at the similarity threshold shares a band with
probability `recall`. Paragraphs that collide in a band are joined: first every paragraph with the smallest of
its band group, then, where a group of three or more still spans several components, all members in blocks.
Every link is verified by the exact Jaccard similarity of the shingle sets, and removals are clustered by
connected components. The paragraphs of the smallest document id of a component stay, those of other
documents go.

A passage that lies inside different paragraphs leaves their similarity low, so band groups cannot show it.
Those are found exactly, over the word sequence of the whole text whatever its line breaks: a repeated passage
is a run of at least `least` words that a document with a smaller id holds word for word in one run. Every
window of `least` words has an anchor, the place in it where the hash of a word pair is smallest, so equal
windows have equal anchors. Anchors that no other document has exclude their windows; the windows of the
others are hashed whole, and an exact group-by finds the smallest document id of each. Windows that follow
each other in both documents are one passage.

Repeats inside one document are no repeats across documents and stay. Exact copies of a paragraph or
text are one entry, however many there are; counts are combined before the shuffle, groups are never
collected whole, and a band group returns at most one link per member and block.

Defined cases: null texts, empty texts and rows without an id take no part and stay as they are. Rows that
repeat an id are one document: what repeats among them stays. Texts shorter than `least` words have no
repeats. Ties go to the smallest id. An empty table gives an empty result. Further columns are kept as
they are by `remove_repeats` and ignored by `repeated_spans`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import connected_components, local_stars, tidy
from tallyloom.operators.skew import lookup_join
from tallyloom.operators.staging import release_shuffles, stage, unstage

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_GROUP_WORDS = 200_000  # words worked on at a time


def tune_bands(similarity: float, recall: float, permutations: int = 64) -> tuple[int, int]:
    """(bands, rows): the longest bands, and as few of them as give `recall` at `similarity`."""
    for rows in range(permutations, 0, -1):
        hit = similarity**rows
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - hit))) if hit < 1 else 1
        if bands * rows <= permutations:
            return bands, rows
    return permutations, 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class Words:
    """Word hashes of several texts, one after the other, with the starts of texts and paragraphs.

    Lines here are paragraphs: lines of at least `least` words, or runs of shorter ones up to an empty line.
    """

    def __init__(self, texts: list[str], least: int = 25):
        words: list[bytes] = []
        texts_at, lines_at, self.lines_of = [0], [], [0]
        for text in texts:
            open_run = False
            for line in text.encode("utf-8", "replace").lower().split(b"\n"):
                here = line.split()
                short = 0 < len(here) < least
                if here:
                    if not (short and open_run):
                        lines_at.append(len(words))
                    words += here
                open_run = short
            texts_at.append(len(words))
            self.lines_of.append(len(lines_at))
        n = len(words)
        self.hash = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n)
        self.text_starts = np.array(texts_at)
        self.line_starts = np.array(lines_at, dtype=np.int64)
        self.line_ends = np.append(self.line_starts[1:], n) if len(lines_at) else self.line_starts
        self.line = np.repeat(np.arange(len(lines_at)), self.line_ends - self.line_starts)

    def spans_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash for each of consecutive word spans that cover all words."""
        place = np.arange(len(self.hash)) - np.repeat(starts, ends - starts)
        longest = int(place.max()) + 1
        powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(longest - 1, _BASE))), dtype=np.uint64)
        sums = np.add.reduceat(_mix(self.hash) * powers[place], starts)
        return _mix(sums + (ends - starts).astype(np.uint64))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start word) of every run of `size` words inside a line."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        h = np.zeros(n, dtype=np.uint64)
        for i in range(size):
            h = h * _BASE + self.hash[i:i + n]
        at = np.flatnonzero(self.line[:n] == self.line[size - 1:])
        return _mix(h[at]), at

    def runs_hash(self, size: int) -> np.ndarray:
        """The hash of `size` words from every word on, whatever text they are in; too few are left at the end."""
        n = len(self.hash) - size + 1
        total, at, power, step, factor = np.zeros(max(n, 0), dtype=np.uint64), 0, self.hash, 1, np.array([_BASE])
        while n > 0:
            if size & step:
                total = total * factor + power[at:at + n]
                at += step
            if 2 * step > size:
                return _mix(total)
            power = power[:-step] * factor + power[step:]  # runs of twice the length
            step, factor = 2 * step, factor * factor
        return total

    def anchors(self, window: int) -> np.ndarray:
        """For every word the place, among `window` from it on, where the hash of the word pair is smallest; ties: the first.

        Only for places whose words are in the same text is it of use.
        """
        n = len(self.hash)
        pair = np.full(n, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        pair[:-1] = _mix(self.hash[:-1] * _BASE + self.hash[1:])
        best, reach = np.arange(n), 1
        while reach < window:
            step = min(reach, window - reach)
            ahead = best[step:]
            best[:n - step] = np.where(pair[best[:n - step]] <= pair[ahead], best[:n - step], ahead)
            reach += step
        return best

    def piece_starts(self, radius: int) -> np.ndarray:
        """The anchors of all runs of `radius` + 1 word pairs."""
        return np.unique(self.anchors(radius + 1)[:max(0, len(self.hash) - radius - 1)])

    def windows(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, anchor) of every window of `least` words inside a text."""
        starts = np.arange(len(self.hash))
        end = np.repeat(self.text_starts[1:], np.diff(self.text_starts))
        starts = starts[starts + least <= end]
        return starts, self.anchors(least - anchor_words(least) + 1)[starts] if len(starts) else starts


def anchor_words(least: int) -> int:
    """Words that an anchor is told by; two at least if a window has them, as anchors are chosen by word pairs."""
    return max(min(2, least), least // 3)


def _grouped(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts of a batch in groups of bounded size; (first row, texts). Null counts as empty."""
    start, group, size = 0, [], 0
    for n, value in enumerate(texts):
        text = value.as_py() or ""
        group.append(text)
        size += len(text) // 6
        if size >= _GROUP_WORDS:
            yield start, group
            start, group, size = n + 1, [], 0
    if group:
        yield start, group


def _lists(values: np.ndarray, cuts: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def text_units(rows: DataFrame, least: int, shingle: int, bands: int, band_rows: int) -> DataFrame:
    """Anchors and paragraphs of every text: hashes, word positions and the paragraphs' band keys."""
    rng = np.random.default_rng(3)
    factors = rng.integers(1, 1 << 62, bands * band_rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(0, 1 << 62, bands * band_rows, dtype=np.uint64)

    def keys_of(words: Words, lines: np.ndarray) -> np.ndarray:
        """Band keys (lines x bands)."""
        hashes, at = words.shingles(shingle)
        owner = words.line[at]
        chosen = np.isin(owner, lines)
        hashes, owner = hashes[chosen], owner[chosen]
        starts = np.searchsorted(owner, lines)
        keys = np.zeros((len(lines), bands), dtype=np.uint64)
        for k in range(bands * band_rows):
            low = np.minimum.reduceat(hashes * factors[k] + offsets[k], starts)
            keys[:, k // band_rows] = _mix(keys[:, k // band_rows] * _BASE + low)
        return _mix(keys + np.arange(bands, dtype=np.uint64)[None, :] * _BASE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _grouped(batch.column(2)):
                some = batch.slice(first, len(texts))
                words = Words(texts, least)
                none = np.zeros(0, dtype=np.int64)
                if not len(words.hash):
                    zero = np.zeros(len(texts) + 1, dtype=np.int32)
                    lists = [_lists(none, zero, pa.int64()), _lists(none, zero, pa.int64()), _lists(none, zero, pa.int32()), _lists(none, zero, pa.int32())]
                    nested = pa.ListArray.from_arrays(pa.array(zero), _lists(none, np.zeros(1, dtype=np.int32), pa.int64()))
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *lists, nested], names=names)
                    continue
                starts = np.unique(words.windows(least)[1])
                owner = np.searchsorted(words.text_starts, starts, side="right")
                # Each anchor once a text.
                once = np.unique(np.stack([owner.astype(np.uint64), words.runs_hash(anchor_words(least))[starts]], axis=1), axis=0)
                cuts = np.searchsorted(once[:, 0], np.arange(1, len(texts) + 2, dtype=np.uint64))
                hashes = np.ascontiguousarray(once[:, 1])
                long = np.flatnonzero(words.line_ends - words.line_starts >= max(least, shingle))
                line_cuts = np.searchsorted(long, words.lines_of)
                line_hash = words.spans_hash(words.line_starts, words.line_ends)[long]
                line_local = words.line_starts[long] - np.repeat(words.text_starts[:-1], np.diff(line_cuts))
                keys = keys_of(words, long) if len(long) else np.zeros((0, bands), dtype=np.uint64)
                inner = _lists(keys.ravel().view(np.int64), np.arange(len(long) + 1) * bands, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0), some.column(1), _lists(hashes.view(np.int64), cuts, pa.int64()),
                        _lists(line_hash.view(np.int64), line_cuts, pa.int64()),
                        _lists(line_local, line_cuts, pa.int32()), _lists((words.line_ends - words.line_starts)[long], line_cuts, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(line_cuts, pa.int32()), inner),
                    ],
                    names=names,
                )

    names = ["id", "row", "anchor", "line", "line_start", "line_words", "keys"]
    return rows.mapInArrow(
        tidy(run), "id long, row long, anchor array<long>, line array<long>, "
        "line_start array<int>, line_words array<int>, keys array<array<long>>",
    )


def repeated_windows(rows: DataFrame, units: DataFrame, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """(row, low, high, start, kept, kept_row, shift) of every window of `least` words that several documents hold, and the staged tables it reads.

    `low` and `high` are the smallest and the largest id of the text, `kept` the smallest id that holds the window, in
    the text `kept_row`, `shift` words further on. Anchors and windows are shuffled once each.
    """
    # The same text in several documents is one entry.
    ends = stage(units.groupBy("row").agg(F.min("id").alias("low"), F.max("id").alias("high")))
    texts = lookup_join(units, ends, "row", "inner", spread=("id",)).filter("id = low")
    by_anchor = W.partitionBy("anchor")
    shared = (
        texts.select("row", "low", "high", F.explode("anchor").alias("anchor"))
        .withColumn("first", F.min("low").over(by_anchor)).withColumn("last", F.max("high").over(by_anchor)).filter("first != last")
    )
    asked = stage(shared.groupBy("row").agg(F.first("low").alias("low"), F.first("high").alias("high"), F.collect_set("anchor").alias("asked")))
    release_shuffles(units.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, group in _grouped(batch.column(0)):
                words = Words(group, least)
                starts, anchors = words.windows(least)
                owner = np.searchsorted(words.text_starts, starts, side="right") - 1
                keys, hashes = words.runs_hash(anchor_words(least)), words.runs_hash(least)
                cuts = np.searchsorted(owner, np.arange(len(group) + 1))
                for n in range(len(group)):
                    some = slice(cuts[n], cuts[n + 1])
                    wanted = batch.column(2)[first + n].values.to_numpy().view(np.uint64)
                    at = starts[some][np.isin(keys[anchors[some]], wanted)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.repeat(batch.column(c)[first + n], len(at)) for c in (1, 3, 4)), pa.array(hashes[at].view(np.int64)),
                            pa.array((at - words.text_starts[n]).astype(np.int32)),
                        ],
                        names=["row", "low", "high", "window", "start"],
                    )

    # One row of each text is read; its windows are counted once.
    joined = lookup_join(rows, asked, "row", "inner", spread=("id",)).filter("id = low").select("text", "row", "asked", "low", "high")
    found = joined.mapInArrow(tidy(run), "row long, low long, high long, window long, start int")
    by_window = W.partitionBy("window")
    held = found.withColumn("keeper", F.min(F.struct("low", "row", "start")).over(by_window)).withColumn("last", F.max("high").over(by_window))
    again = held.filter("keeper.low != last AND (keeper.low != low OR keeper.low != high)").select(
        "row", "low", "high", "start", F.col("keeper.low").alias("kept"), F.col("keeper.row").alias("kept_row"),
        (F.col("keeper.start") - F.col("start")).alias("shift"),
    )
    return again, [ends, asked]


def repeated_passages(rows: DataFrame, units: DataFrame, least: int) -> DataFrame:
    """(id, row, start, words, kept): runs of at least `least` words that a smaller document id holds as they are."""
    again, read = repeated_windows(rows, units, least)
    by_place = W.partitionBy("row", "kept", "kept_row", "shift").orderBy("start")
    spans = stage(
        again.withColumn("run", F.col("start") - F.dense_rank().over(by_place))  # a repeated row has the same rank
        .groupBy("row", "kept", "kept_row", "shift", "run")
        .agg(F.min("start").alias("start"), (F.max("start") - F.min("start") + least).alias("words"))
        .groupBy("row", "start", "words").agg(F.sort_array(F.collect_set("kept")).alias("kept"))
        .groupBy("row").agg(F.collect_list(F.struct("start", "words", "kept")).alias("spans"))
    )
    unstage(*read)
    release_shuffles(units.sparkSession)
    owned = lookup_join(units.select("id", "row").distinct(), spans, "row", "inner", spread=("id",)).select("id", "row", F.explode("spans").alias("s"))
    own = owned.select("id", "row", "s.start", "s.words", F.filter("s.kept", lambda k: k < F.col("id")).alias("kept"))
    return own.filter(F.size("kept") > 0)


def covered_words(rows: DataFrame, units: DataFrame, least: int) -> DataFrame:
    """(id, row, spans): the stretches (start, words) of a text that its repeated windows cover, apart from each other.

    A further document of the same text has two such sets, which may overlap: what is kept before the text's
    smallest document, and what is kept there. Whatever documents hold them, there are no more stretches than a text has room for.
    """
    again, read = repeated_windows(rows, units, least)
    # The smallest document of a text loses what is kept before it, others everything.
    before = again.select("row", "low", (F.col("kept") < F.col("low")).alias("before"), "start")
    in_text = W.partitionBy("row", "before").orderBy("start")
    opens = F.coalesce(F.col("start") > F.lag("start").over(in_text) + least, F.lit(True)).cast("int")
    spans = stage(
        before.withColumn("opens", opens).withColumn("stretch", F.sum("opens").over(in_text))
        .groupBy("row", "before", "stretch")
        .agg(F.first("low").alias("low"), F.min("start").alias("start"), (F.max("start") - F.min("start") + least).alias("words"))
        .groupBy("row").agg(F.first("low").alias("low"), F.collect_list(F.struct("start", "words", "before")).alias("spans"))
    )
    unstage(*read)
    release_shuffles(units.sparkSession)
    owned = lookup_join(units.select("id", "row").distinct(), spans, "row", "inner", spread=("id",))
    own = F.transform(F.filter("spans", lambda s: s["before"] | (F.col("id") != F.col("low"))), lambda s: F.struct(s["start"].alias("start"), s["words"].alias("words")))
    return owned.select("id", "row", own.alias("spans")).filter(F.size("spans") > 0)


def shingle_sets(rows: DataFrame, wanted: DataFrame, shingle: int, least: int) -> DataFrame:
    """(line, shingles): the distinct shingle hashes of the wanted lines; `wanted` has line, id, row, start, words."""
    asked = wanted.groupBy("row").agg(F.collect_list(F.struct("id", "line", "start", "words")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for first, texts in _grouped(batch.column(0)):
                words = Words(texts, least)
                hashes, at = words.shingles(shingle)
                names, sets = [], []
                for n in range(len(texts)):
                    for a in asks[first + n]:
                        if a["id"] != ids[first + n]:
                            continue
                        low = words.text_starts[n] + a["start"]
                        inside = slice(np.searchsorted(at, low), np.searchsorted(at, low + a["words"] - shingle, side="right"))
                        names.append(a["line"])
                        sets.append(np.unique(hashes[inside]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["line", "shingles"])

    joined = lookup_join(rows, asked, "row", "inner", spread=("id",)).select("text", "id", "asked")
    return joined.mapInArrow(tidy(run), "line long, shingles array<long>").dropDuplicates(["line"])


def paragraph_components(rows: DataFrame, lines: DataFrame, similarity: float, shingle: int, least: int, block: int = 256) -> DataFrame:
    """(id, component) of the distinct lines with a near-duplicate; `lines` has line, keys and owner."""
    banded = lines.select("line", F.explode("keys").alias("key"))
    by_key = W.partitionBy("key")
    met = banded.withColumn("low", F.min("line").over(by_key)).withColumn("high", F.max("line").over(by_key))
    members = stage(met.filter("low != high").select("key", "line", "low"))
    release_shuffles(lines.sparkSession)
    pairs = stage(members.filter("line != low").select("line", "low").distinct())
    touched = pairs.select("line").union(pairs.select("low")).distinct()
    owners = lines.select("line", "owner.*").join(touched, "line")
    sets = stage(shingle_sets(rows, owners, shingle, least))
    both = F.size(F.array_intersect("shingles", "other"))
    links = stage(
        pairs.join(sets, "line").join(sets.select(F.col("line").alias("low"), F.col("shingles").alias("other")), "low")
        .withColumn("both", both)
        .filter(F.col("both") >= similarity * (F.size("shingles") + F.size("other") - F.col("both")))
        .select(F.col("line").alias("a"), F.col("low").alias("b"))
    )
    unstage(pairs)
    found = stage(connected_components(links))
    # Groups of three or more that still span several components: compare all their members, block by block.
    placed = members.join(found.withColumnRenamed("id", "line"), "line", "left").withColumn("component", F.coalesce("component", "line"))
    open_groups = (
        placed.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1"),
            F.expr("bit_xor(xxhash64(line))").alias("digest"),
        )
        .filter("n > 2 AND c0 != c1").groupBy("n", "digest").agg(F.min("key").alias("key"))  # the same members once
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    )
    cut = (
        placed.select("key", "line").join(open_groups.select("key", "blocks"), "key")
        .withColumn("own", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "line", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
        .join(sets, "line")
    )

    def compare(group: pa.Table) -> pa.Table:
        lists = group["shingles"].combine_chunks()
        lengths = lists.value_lengths().to_numpy()
        names = group["line"].to_numpy()
        seen, column = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        held = np.zeros((len(names), len(seen)), dtype=np.float32)
        held[np.repeat(np.arange(len(names)), lengths), column] = 1
        inter = (held @ held.T).astype(np.float64)
        near = inter >= similarity * (lengths[:, None] + lengths[None, :] - inter)
        i, j = np.nonzero(np.triu(near, 1))
        a, b = local_stars(i, j, names)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    more = stage(cut.groupBy("key", "low", "high").applyInArrow(compare, "a long, b long"))
    unstage(members, sets)
    release_shuffles(lines.sparkSession)
    if more.isEmpty():
        return found
    return connected_components(links.union(more))


def _repeats(
    documents: DataFrame, key: str, text: str, passages, least: int = 25, shingle: int = 5, similarity: float = 0.8, recall: float = 0.995
) -> tuple[DataFrame, DataFrame]:
    """Repeated paragraphs (id, row, start, words, stay), and what `passages` makes of the texts."""
    rows = documents.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("row"), F.col(text).alias("text")
    )
    bands, band_rows = tune_bands(similarity, recall)
    units = stage(text_units(rows, least, shingle, bands, band_rows))
    runs = stage(passages(rows, units.select("id", "row", "anchor"), least))
    zipped = ["line", "line_start", "line_words"]
    keyed = units.filter(F.size("line") > 0).select("id", "row", F.explode(F.arrays_zip(*zipped, "keys")).alias("x"))
    distinct = stage(
        keyed.select("x.line", F.struct("id", "row", F.col("x.line_start").alias("start"), F.col("x.line_words").alias("words")).alias("owner"), "id", "x.keys")
        .groupBy("line").agg(F.min("owner").alias("owner"), F.max("id").alias("last"), F.first("keys").alias("keys"))
    )
    # Without anchors and keys, which are most of the table.
    slim = stage(units.filter(F.size("line") > 0).select("id", "row", *zipped))
    unstage(units)
    release_shuffles(documents.sparkSession)
    lines = slim.select("id", "row", F.explode(F.arrays_zip(*zipped)).alias("x")).select(
        "id", "row", "x.line", F.col("x.line_start").alias("start"), F.col("x.line_words").alias("words")
    )
    groups = paragraph_components(rows, distinct, similarity, shingle, least)
    named = distinct.select("line", F.col("owner.id").alias("first"), "last").join(groups, F.col("line") == F.col("id"), "left").select(
        "line", "first", "last", F.coalesce("component", "line").alias("group")
    )
    stays = named.groupBy("group").agg(F.min("first").alias("stay"), F.max("last").alias("end")).filter("stay != end")
    decided = named.join(stays, "group").select("line", "stay")
    return lines.join(decided, "line").filter("id != stay").select("id", "row", "start", "words", "stay").distinct(), runs


def repeated_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(key, row, start, words, kind, component, kept): what is repeated, by word position in its text.

    `row` is the hash of the text, `kept` the ids of the documents where the passage stays, `component` the
    smallest of them. `how`: least words of a passage, words of a shingle, similarity of paragraphs, recall.
    """
    lines, passages = _repeats(documents, key, text, repeated_passages, **how)
    paragraphs = lines.select("id", "row", "start", "words", F.lit("paragraph").alias("kind"), F.array("stay").alias("kept"))
    spans = paragraphs.unionByName(passages.withColumn("kind", F.lit("passage")))
    return spans.select(F.col("id").alias(key), "row", "start", "words", "kind", F.col("kept")[0].alias("component"), "kept")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (start, count), which may overlap; lines that become empty go."""
    if not spans:
        return text
    drop = set()
    for start, n in spans:
        drop.update(range(start, start + n))
    out, at = [], 0
    for line in text.split("\n"):
        words = line.encode("utf-8", "replace").split()
        here = range(at, at + len(words))
        at += len(words)
        if not words or drop.isdisjoint(here):
            out.append(line)
        else:
            kept = [w.decode() for n, w in zip(here, words) if n not in drop]
            if kept:
                out.append(" ".join(kept))
    return "\n".join(out)


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents without their repeated passages, with their columns; n_chars follows the text.

    A document of which nothing is left goes.
    """
    lines, covered = _repeats(documents, key, text, covered_words, **how)
    paragraphs = lines.groupBy("id", "row").agg(F.collect_list(F.struct("start", "words")).alias("spans"))
    per_text = stage(
        paragraphs.unionByName(covered).groupBy(F.col("row").alias("__row"), F.col("id").alias("__id"))
        .agg(F.flatten(F.collect_list("spans")).alias("__spans"))
        .groupBy(F.xxhash64("__id", "__row").alias("__key"))  # a map, should two documents share the hash
        .agg(F.map_from_entries(F.collect_list(F.struct("__id", "__spans"))).alias("__cuts"))
    )
    own = F.xxhash64(F.col(key).cast("long"), F.xxhash64(text))
    marked = lookup_join(documents.withColumn("__key", own), per_text, "__key", "left", spread=(key,))
    spans_of = F.try_element_at("__cuts", F.col(key).cast("long")).alias("__spans")
    chosen = marked.select(*documents.columns, F.when(F.col(key).isNotNull(), spans_of).alias("__spans"))
    at = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, spans = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            new = [t if t is None else cut_words(t, [(s["start"], s["words"]) for s in cuts or ()]) for t, cuts in zip(old, spans)]
            columns = batch.columns[:-1]
            columns[at] = pa.array(new, batch.schema.field(at).type)
            names = batch.schema.names[:-1]
            if "n_chars" in names:
                n = names.index("n_chars")
                columns[n] = pa.array([c if a == b else len(b) for a, b, c in zip(old, new, columns[n].to_pylist())], columns[n].type)
            out = pa.RecordBatch.from_arrays(columns, names=names)
            yield out.filter(pa.array([bool(not s or (b and b.strip())) for b, s in zip(new, spans)], pa.bool_()))

    return chosen.mapInArrow(tidy(run), documents.schema)
