"""Importance resampling towards a target distribution, with bit-sliced weights.

Features of a text are its runs of words; each falls into one of `buckets` buckets by a checksum. Two
passes over the texts: the first counts the buckets of all documents (one count vector a task, added up by
bucket), the second scores. The gain of a bucket is an integer, so the weight of a document is an exact sum.
It is taken bit by bit: the counts of a document become planes of as many bits as there are buckets, one
plane for each binary digit of the counts; the gains become planes of their digits in two's complement, the
last one negative. Each pair of planes adds popcount(counts AND gains) times a power of two.

Documents are then drawn without replacement by the largest score, weight plus Gumbel noise that is a hash of
the id. Ranks come from positions in one range-partitioned order, so no task sees more than its range.

Defined cases: a null or empty text has no words and weight 0; a null id counts as the empty text in the noise
and comes last among ties; repeated rows are documents of their own; an empty target leaves gains that
follow from the counts alone; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import tidy
from tallyloom.operators.rowindex import row_index
from tallyloom.operators.staging import stage

# Words are runs of digits, letters a-z and anything beyond ASCII; A-Z are lower-cased.
_CLEAN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_CACHED_WORDS = 200_000  # distinct features whose bucket a task remembers
_GROUP_WORDS = 1 << 20  # features that are counted in one go, whole documents each


class Buckets(dict):
    """Bucket of a feature: checksum of its bytes modulo the number of buckets."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(self) < _CACHED_WORDS:
            self[feature] = bucket
        return bucket


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_CLEAN).split()


def features_of(words: list[bytes], run: int) -> list[bytes]:
    """All runs of 1 to `run` consecutive words."""
    found = list(words)
    for n in range(2, run + 1):
        found += map(b" ".join, zip(*(words[at:] for at in range(n))))
    return found


def _groups(texts: list[bytes | None], run: int, find: Buckets) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(first document, words of each, buckets of each) for some documents at a time."""
    first, sizes, found, total = 0, [], [], 0
    for at, text in enumerate(texts):
        words = words_of(text)
        features = features_of(words, run)
        sizes.append(len(words))
        found.append(np.fromiter(map(find.__getitem__, features), np.int64, len(features)))
        total += len(features)
        if total >= _GROUP_WORDS or at + 1 == len(texts):
            yield first, np.array(sizes), found
            first, sizes, found, total = at + 1, [], [], 0


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


def bucket_counts(texts: DataFrame, run: int, buckets: int) -> np.ndarray:
    """Features in each bucket over a whole table; as long as the number of buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, totals = Buckets(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, found in _groups(_texts(batch), run, find):
                totals += np.bincount(np.concatenate(found), minlength=buckets)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_pydict({"bucket": used.astype(np.int32), "n": totals[used]})

    parts = texts.select("text").mapInArrow(tidy(count), "bucket int, n long")
    counts = np.zeros(buckets, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Integer gain of each bucket: a thousand times the log ratio of the smoothed shares, floored."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    size = float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def _packed(bits: np.ndarray) -> np.ndarray:
    """A 0/1 vector as 64-bit words."""
    padded = np.zeros(-(-len(bits) // 64) * 64, dtype=np.uint8)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").view(np.uint64)


def gain_planes(gains: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(factor, plane) for each digit of the gains in two's complement; the last factor is negative."""
    digits = int(np.abs(gains).max(initial=0)).bit_length() + 1
    return [
        (-(1 << k) if k == digits - 1 else 1 << k, _packed((gains >> k & 1).astype(np.uint8))) for k in range(digits)
    ]


def count_planes(document: np.ndarray, bucket: np.ndarray, count: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(factor, documents, their planes) for each binary digit of the counts; pairs come sorted, each once."""
    width = -(-buckets // 64)
    for j in range(int(count.max(initial=0)).bit_length()):
        has = np.flatnonzero(count >> j & 1)
        rows, place = np.unique(document[has], return_inverse=True)
        word = place * width + (bucket[has] >> 6)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        planes = np.zeros(len(rows) * width, dtype=np.uint64)
        planes[word[starts]] = np.bitwise_or.reduceat(np.uint64(1) << (bucket[has] & 63).astype(np.uint64), starts)
        yield 1 << j, rows, planes.reshape(len(rows), width)


def summed_gains(found: list[np.ndarray], planes: list[tuple[int, np.ndarray]], buckets: int) -> np.ndarray:
    """Sum of the gains over the features of each document, from bit planes."""
    sizes = [len(f) for f in found]
    pairs = np.repeat(np.arange(len(found)), sizes) * buckets + np.concatenate(found)
    pair, count = np.unique(pairs, return_counts=True)
    total = np.zeros(len(found), dtype=np.int64)
    for power, rows, counted in count_planes(pair // buckets, pair % buckets, count, buckets):
        for factor, plane in planes:
            total[rows] += power * factor * np.bitwise_count(counted & plane).sum(axis=1, dtype=np.int64)
    return total


def weigh(documents: DataFrame, gains: np.ndarray, run: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`(key, n_words, n_features, weight)`: the floored mean of the gains of each document's features."""
    planes, buckets = gain_planes(gains), len(gains)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Buckets(buckets)
        for batch in batches:
            for first, words, found in _groups(_texts(batch), run, find):
                n = np.array([len(f) for f in found], dtype=np.int64)
                weight = summed_gains(found, planes, buckets) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(first, len(n)), pa.array(words, pa.int64()), pa.array(n), pa.array(weight)],
                    names=["key", "n_words", "n_features", "weight"],
                )

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(tidy(score), f"key {kind}, n_words long, n_features long, weight long")


def resample(
    documents: DataFrame,
    target: DataFrame,
    percent: int = 10,
    min_words: int = 20,
    run: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """`(key, n_features, weight, score, rank)` of every document; `rank` counts the drawn ones from 1."""
    source = bucket_counts(documents.select(F.col(text).alias("text")), run, buckets)
    wanted = bucket_counts(target.select(F.col(target_text).alias("text")), run, buckets)
    weighed = weigh(documents, gains_of(source, wanted), run, key, text)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stage(weighed.withColumn("score", F.col("weight") + noise))
    # Equal rows get an order too, so that a mass of them is dealt over several ranges.
    able = scored.filter(F.col("n_words") >= min_words).withColumn("tie", F.monotonically_increasing_id())
    draw = percent * able.count() // 100
    placed = row_index(able, F.desc("score"), F.asc_nulls_last("key"), "tie", name="place")
    rank = F.when(F.col("place") < draw, F.col("place") + 1)
    short = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    columns = [F.col("key").alias(key), "n_features", "weight", "score", "rank"]
    return placed.withColumn("rank", rank).select(*columns).unionByName(short.select(*columns))


# The checksum is the usual reflected one of polynomial 0xEDB88320, byte by byte over a table of 256.
RESAMPLE_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i AS b, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), dw AS (SELECT r, unnest(words) AS w FROM d
), bw AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), bytes AS (
  SELECT w, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT) AS x
  FROM (SELECT w FROM dw UNION SELECT w FROM bw)
), f AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, x), lambda a, v: xor(a >> 8, t[(xor(a, v) & 255) + 1])),
                4294967295) % 10000 AS bucket FROM bytes, crc
), s AS (SELECT bucket, count(*) AS n FROM dw JOIN f USING (w) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS n FROM bw JOIN f USING (w) GROUP BY bucket
), g AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE
    / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), weighed AS (
  SELECT r, count(*) AS n, sum(gain)::BIGINT AS gains FROM dw JOIN f USING (w) JOIN g USING (bucket) GROUP BY r
), scored AS (
  SELECT d.r, doc_id, coalesce(n, 0)::BIGINT AS n_features,
         CASE WHEN n IS NULL THEN 0 ELSE (gains - ((gains % n) + n) % n) // n END::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN weighed USING (r)
), noisy AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
         count(*) OVER (PARTITION BY n_features >= 20) AS n FROM noisy
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank
FROM placed
"""
