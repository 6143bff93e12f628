"""Line dedup: of a line that many documents share, one document keeps its copies.

Lines are compared by a key: ASCII white space stripped at both ends, A-Z lower-cased. The rows
(hash of the key, document, position) are range-partitioned by hash and sorted inside a range by
document, largest first, and position; a window streams over them and tells first occurrences from later
ones. What comes out is no text but a keep bitmap per document, run-length coded, which `keep_lines` applies.

A hash that many lines share would be one run of one range. Such hashes are found by a count that is
combined map-side; their documents are dealt over slices by a hash of the document id, each slice is
streamed on its own, and one row per slice settles the document that keeps the line.

All of it is built-in column functions. Defined cases: a null or empty text is one empty line; null document
ids count as one document whose id is smaller than any other; rows that repeat (document, text) get the
same bitmap; rows that share an id but not the text are one document with several texts; an empty table
gives an empty result; further columns are kept by `keep_lines`, whatever their names. Keys are
compared by two 64-bit hashes with different seeds, texts of one document id by one.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.config import LIMITS, SizeLimits
from tallyloom.operators.skew import fresh, heavy_keys, lookup_join
from tallyloom.operators.staging import stage

BLANKS = " \t\n\x0b\x0c\r"  # \x20\x09-\x0D
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_ROWS = 4_096  # lines of one hash that are streamed in one piece


def line_key(line: Column) -> Column:
    """What lines are compared by. Lower-casing a text of one byte a character touches A-Z only."""
    bare = F.trim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _row_key(key: str, text: str) -> Column:
    """Rows with this value equal have the same document id and, up to a 64-bit hash, the same text."""
    return F.struct(F.col(key).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("body"))


def _long_lines(documents: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc, body, at): one row per line whose key has enough characters; other lines always stay."""
    rows = documents.select(_row_key(key, text).alias("row"), F.posexplode(_lines(text)).alias("at", "line"))
    keyed = rows.select("row", "at", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    return keyed.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), F.col("row.doc").alias("doc"),
        F.col("row.body").alias("body"), "at",
    )


def _streamed(lines: DataFrame, min_docs: int, limits: SizeLimits, slice_rows: int) -> DataFrame:
    """(doc, body, at) of the lines to drop."""
    heavy = heavy_keys(lines, "h1", limits=replace(limits, group_rows=slice_rows, group_bytes=1 << 62))
    by = ["h1", "h2"]
    if heavy:
        fan = -(-heavy.max_rows // slice_rows)
        own = F.pmod(F.xxhash64("doc"), F.lit(fan)).cast("int")
        lines = heavy.mark(lines, "hot").withColumn("slice", F.when(F.col("hot"), own).otherwise(F.lit(0)))
        by = [*by, "slice"]
    ranged = lines.repartitionByRange(*by).sortWithinPartitions(*by, F.desc_nulls_last("doc"), "at")
    # The windows need neither a shuffle nor a sort: ranges never cut a slice, and its rows are in order.
    whole = W.partitionBy(*by)
    marked = ranged.withColumn("nth", F.dense_rank().over(whole.orderBy(F.desc_nulls_last("doc"))))
    marked = marked.withColumn("docs", F.max("nth").over(whole))
    drop = (F.col("docs") >= min_docs) & (F.col("nth") > 1)
    if not heavy:
        return marked.filter(drop).select("doc", "body", "at")
    ordinary = marked.filter(~F.col("hot") & drop)
    # The first occurrences of all slices of a hash settle the document that keeps it; a document is in one slice.
    table = stage(marked.filter("hot").select("h1", "h2", "doc", "body", "at", "nth", "docs"))
    firsts = table.filter("nth = 1").groupBy("h1", "h2", "doc", "docs").agg(F.lit(1).alias("one"))
    settled = firsts.groupBy("h1", "h2").agg(F.max("doc").alias("keeper"), F.sum("docs").alias("all"))
    repeated = settled.filter(F.col("all") >= min_docs).select(F.struct("h1", "h2").alias("hash"), "keeper")
    joined = lookup_join(
        table.select(F.struct("h1", "h2").alias("hash"), "doc", "body", "at"), repeated, "hash",
        spread=("doc", "body", "at"), limits=replace(limits, literal_keys=0),
    )
    spread = joined.filter(~F.col("doc").eqNullSafe(F.col("keeper")))
    return ordinary.select("doc", "body", "at").unionByName(spread.select("doc", "body", "at"))


def keep_bitmaps(
    documents: DataFrame,
    min_chars: int = 20,
    min_docs: int = 3,
    key: str = "doc_id",
    text: str = "text",
    limits: SizeLimits = LIMITS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """`(row, n_dropped, cuts)` of every row key that loses a line.

    `row` is a struct of the document id and a hash of the text. `cuts` is the bitmap of its lines as
    runs: an array of (first, last) of the 0-based positions that go, in order; all other lines are kept.
    """
    lines = stage(_long_lines(documents, key, text, min_chars))  # hashes only; read three times
    dropped = _streamed(lines, min_docs, limits, slice_rows)
    places = dropped.groupBy(F.struct("doc", "body").alias("row")).agg(F.array_sort(F.collect_set("at")).alias("at"))
    first = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1) != x - 1))
    last = F.filter("at", lambda x, i: F.coalesce(F.get("at", i + 1) != x + 1, F.lit(True)))
    return places.select("row", F.size("at").cast("long").alias("n_dropped"), F.arrays_zip(first.alias("first"), last.alias("last")).alias("cuts"))


def keep_lines(
    documents: DataFrame,
    min_chars: int = 20,
    min_docs: int = 3,
    key: str = "doc_id",
    text: str = "text",
    limits: SizeLimits = LIMITS,
    slice_rows: int = SLICE_ROWS,
    n_lines: str = "n_lines",
    n_dropped: str = "n_dropped",
) -> DataFrame:
    """The documents with the lines that stay, joined by line feeds, and two counts. Every row comes back.

    The counts are columns of the given names, which must not be those of columns of the documents.
    """
    bitmaps = stage(keep_bitmaps(documents, min_chars, min_docs, key, text, limits, slice_rows))
    row, cuts, lines, found = (fresh(f"_{n}", documents) for n in ("row", "cuts", "lines", "found"))
    lookup = bitmaps.select(F.col("row").alias(row), F.col("n_dropped").alias(found), F.col("cuts").alias(cuts))
    joined = lookup_join(
        documents.withColumn(row, _row_key(key, text)), lookup, row, "left", spread=(key, text), limits=replace(limits, literal_keys=0)
    )
    split = joined.withColumn(lines, _lines(text))
    # What lies between two cuts stays: as many runs as cuts, and the run after the last.
    starts = F.concat(F.array(F.lit(0)), F.transform(F.col(cuts)["last"], lambda x: x + 1))
    ends = F.concat(F.col(cuts)["first"], F.array(F.size(lines)))
    runs = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: r["a"] < r["b"])
    kept = F.transform(runs, lambda r: F.array_join(F.slice(F.col(lines), r["a"] + 1, r["b"] - r["a"]), "\n"))
    stays = F.when(F.col(cuts).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(kept, "\n"))
    rest = [F.col(f"`{c}`") if c != text else stays.alias(text) for c in documents.columns]
    return split.select(
        *rest, F.size(lines).cast("long").alias(n_lines), F.coalesce(F.col(found), F.lit(0)).cast("long").alias(n_dropped)
    )


def dedup_lines(documents: DataFrame, **options) -> DataFrame:
    """`(doc_id, n_lines, n_dropped, kept_sha256)` of every row."""
    kept = keep_lines(documents.select("doc_id", "text"), **options)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


# Texts are split and keyed as above; a null id sorts below all others.
LINES_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), s AS (
  SELECT key, count(DISTINCT coalesce(doc_id::VARCHAR, '')) AS n, max(doc_id) AS keeper FROM k
  WHERE length(key) >= 20 GROUP BY key
), m AS (
  SELECT k.*, coalesce(s.n >= 3 AND k.doc_id IS DISTINCT FROM s.keeper, false) AS gone
  FROM k LEFT JOIN s ON k.key = s.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
