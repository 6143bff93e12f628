"""Keyword counts per row and per user, without building the user's text.

Counting exact words is additive over texts that are joined by whitespace, so the counts of a user
are sums over posts: words are filtered to the keyword set and counted where they are read, and only
`(user, keyword, count)` partial sums are shuffled. The texts never move.

Short keyword lists are a hash set in the plan. Longer ones are a table `(keyword, positions)` that is looked up
word by word, and results can stay sparse: positions and counts of the keywords that occur.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.config import LIMITS
from tallyloom.functions.text import keyword_vector, leading_word, ones_like, trailing_word, words
from tallyloom.operators.skew import lookup_join
from tallyloom.operators.staging import stage

_RUN = 256  # neighbouring parts whose ends are put together in one task
_NO_WORD = ""  # stands for the text itself; no word is empty


def _asked(keywords: Sequence[str], normalize: bool) -> list[str]:
    if not keywords:
        raise ValueError("the keyword list is empty")
    return [k.lower() for k in keywords] if normalize else list(keywords)


def keyword_table(spark: SparkSession, keywords: Sequence[str], normalize: bool = False) -> DataFrame:
    """`(keyword, positions)`: every distinct keyword with its 0-based places in the list; empty ones cannot occur."""
    places: dict[str, list[int]] = {}
    for at, keyword in enumerate(_asked(keywords, normalize)):
        if keyword != _NO_WORD:
            places.setdefault(keyword, []).append(at)
    return spark.createDataFrame(list(places.items()), "keyword string, positions array<int>")


def keyword_counts(posts: DataFrame, keywords: Sequence[str], cap: int = -1, normalize: bool = False) -> DataFrame:
    """Add `input_ids` (counts in keyword order) and `attention_mask` (ones) to each row."""
    return posts.withColumn("input_ids", keyword_vector(F.col("text"), _asked(keywords, normalize), cap)).withColumn(
        "attention_mask", ones_like(F.col("input_ids"))
    )


def _hits(texts: DataFrame, keys: Sequence[str], keywords: Sequence[str] | DataFrame, text: Column, kept: Sequence[str] = ()) -> DataFrame:
    """`(keys..., _word)`: a row per occurrence of a keyword, and one with the empty word per text."""
    found = F.coalesce(words(text), F.array().cast("array<string>"))
    if not isinstance(keywords, DataFrame):
        distinct = list(dict.fromkeys(keywords))
        found = F.filter(found, lambda word: word.isin(distinct))
    rows = texts.select(*keys, *kept, F.explode(F.array_append(found, F.lit(_NO_WORD))).alias("_word"))
    if not isinstance(keywords, DataFrame):
        return rows
    nothing = keywords.sparkSession.createDataFrame([(_NO_WORD,)], "_word string")
    return lookup_join(rows, keywords.select(F.col("keyword").alias("_word")).union(nothing), "_word", "left_semi")


def _capped(n: Column, cap: int) -> Column:
    return (F.least(F.lit(cap).cast("long"), n) if cap >= 0 else n).cast("int")


def _dense(hits: DataFrame, keys: Sequence[str], chosen: Sequence[str], cap: int, *more: Column) -> DataFrame:
    """Counts in keyword order from `(keys..., _word, _n)`; at most one entry per distinct keyword is left in each group."""
    entries = F.collect_list(F.when(F.col("_word") != _NO_WORD, F.struct("_word", "_n")))
    counts = hits.groupBy(*keys).agg(F.map_from_entries(entries).alias("_counts"), *more)
    n = F.transform(
        F.array(*[F.lit(k) for k in chosen]), lambda k: _capped(F.coalesce(F.col("_counts")[k], F.lit(0)), cap)
    )
    return counts.withColumn("input_ids", n).drop("_counts")


def keyword_counts_by(
    posts: DataFrame, keys: Sequence[str], keywords: Sequence[str], cap: int = -1, normalize: bool = False,
    first: tuple[str, str] | None = None,
) -> DataFrame:
    """`(keys..., input_ids, attention_mask)`: keyword counts summed over the texts of each key.

    Keys whose texts hold no keyword, or only missing texts, get zeros. Repeated keywords are allowed. With
    `first=(column, order)` that column of the key's first row comes along, from the same aggregation.
    """
    chosen = _asked(keywords, normalize)
    long = len(set(chosen)) > LIMITS.literal_keys
    if long:
        sparse = sparse_keyword_counts_by(posts, keys, keyword_table(posts.sparkSession, chosen), cap, first)
        counts = sparse.withColumn("input_ids", densify(F.col("indices"), F.col("counts"), len(chosen)))
    else:
        hits, more = _summed(_hits(posts, keys, chosen, F.col("text"), first or ()), keys, first)
        counts = _dense(hits, keys, chosen, cap, *more)
    own = [first[0]] if first else []
    return counts.select(*keys, *own, "input_ids").withColumn("attention_mask", ones_like(F.col("input_ids")))


def _summed(hits: DataFrame, keys: Sequence[str], first: tuple[str, str] | None) -> tuple[DataFrame, list[Column]]:
    """`(keys..., _word, _n)`, and what picks the first row's column out of it."""
    count = F.count(F.lit(1)).alias("_n")
    if not first:
        return hits.groupBy(*keys, "_word").agg(count), []
    column, order = first
    place = F.when(F.col("_word") == _NO_WORD, F.struct(F.col(order).alias("o"), F.col(column).alias("v")))
    summed = hits.groupBy(*keys, "_word").agg(count, F.min(place).alias("_first"))
    return summed, [F.min("_first")["v"].alias(column)]


def sparse_keyword_counts_by(
    posts: DataFrame, keys: Sequence[str], keywords: DataFrame, cap: int = -1, first: tuple[str, str] | None = None
) -> DataFrame:
    """`(keys..., indices, counts)`: places in the keyword list, increasing, and how often the keyword occurs there.

    `keywords` is a `keyword_table`; it is broadcast where it is small enough and joined otherwise. Work and
    output of a key grow with the keywords it holds, not with the list. Keys without any have empty arrays.
    """
    hits, more = _summed(_hits(posts, keys, keywords, F.col("text"), first or ()), keys, first)
    return _sparse(hits, keys, keywords, cap, *more)


def _sparse(hits: DataFrame, keys: Sequence[str], keywords: DataFrame, cap: int, *more: Column) -> DataFrame:
    nothing = keywords.sparkSession.createDataFrame([(_NO_WORD, [])], "keyword string, positions array<int>")
    places = keywords.select("keyword", "positions").union(nothing).withColumnRenamed("keyword", "_word")
    placed = lookup_join(hits, places, "_word").select("*", F.explode_outer("positions").alias("_at"))
    pair = F.when(F.col("_at").isNotNull(), F.struct("_at", _capped(F.col("_n"), cap).alias("_n")))
    groups = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(pair)).alias("_pairs"), *more)
    return groups.withColumns({"indices": F.col("_pairs")["_at"], "counts": F.col("_pairs")["_n"]}).drop("_pairs")


def densify(indices: Column, counts: Column, size: int) -> Column:
    """The array of `size` counts that increasing positions and their counts stand for, in one walk."""
    before = F.concat(F.array(F.lit(-1)), indices)
    runs = F.transform(
        F.arrays_zip(indices.alias("i"), counts.alias("n"), F.slice(before, 1, F.size(indices)).alias("b")),
        lambda p: F.concat(F.array_repeat(F.lit(0), p["i"] - p["b"] - 1), F.array(p["n"])),
    )
    last = F.coalesce(F.get(indices, F.size(indices) - 1), F.lit(-1))
    return F.concat(F.flatten(runs), F.array_repeat(F.lit(0), F.lit(size - 1) - last))


def keyword_counts_of_parts(
    parts: DataFrame, keywords: Sequence[str], cap: int = -1, normalize: bool = False, run: int = _RUN
) -> DataFrame:
    """`(uid, tid, input_ids, attention_mask)` from the `(uid, part, tid, text)` rows of joined texts.

    Needed for delimiters that are not whitespace and so glue words of neighbouring texts. A stretch of text
    is its left open word, the counts of what is inside, and its right open word; two neighbouring stretches
    make one, so they are combined in levels: inner words are counted where they are, the open words of `run`
    neighbours are appended in order, and that is the text of one part of the next level. No task gets more
    than `run` pairs of open words of a user, however many parts the user has. An open word longer than every
    keyword can become none, so no more than that is kept of it.
    """
    chosen = _asked(keywords, normalize)
    longest = max(map(len, chosen)) + 1
    table = keyword_table(parts.sparkSession, chosen) if len(set(chosen)) > LIMITS.literal_keys else None
    asked = chosen if table is None else table
    parts = stage(parts)  # joined texts are read at two levels
    first = parts.groupBy("uid").agg(F.min_by("tid", "part").alias("tid"), F.max("part").alias("_last"))
    last = first.agg(F.max("_last")).first()[0] or 0
    text = F.col("text")
    level = parts.select("uid", "part", "text")
    levels = []
    while last > 0:
        left, right = leading_word(text), trailing_word(text)
        cut = level.withColumns({"_left": left, "_right": right})
        split = F.length("_left") < F.length(text)  # the part holds whitespace
        middle = F.substr(text, F.length("_left") + 1, F.length(text) - F.length("_left") - F.length("_right"))
        levels.append(_hits(cut, ["uid"], asked, F.when(split, middle).otherwise(F.lit(""))))
        # Without whitespace both ends are the same open word.
        short = F.when(split, F.concat(F.substring("_left", 1, longest), F.lit(" "), F.substring("_right", 1, longest)))
        ends = cut.select("uid", "part", short.otherwise(F.substring("_left", 1, longest)).alias("_ends"))
        ordered = F.array_sort(F.collect_list(F.struct("part", "_ends")))["_ends"]
        level = ends.groupBy("uid", F.expr(f"part div {run}L").alias("_run")).agg(F.array_join(ordered, "").alias("text"))
        level = stage(level.withColumnRenamed("_run", "part"))
        last //= run
    levels.append(_hits(level, ["uid"], asked, text))
    hits, _ = _summed(reduce(DataFrame.unionByName, levels), ["uid"], None)
    if table is None:
        counts = _dense(hits, ["uid"], chosen, cap)
    else:
        sparse = _sparse(hits, ["uid"], table, cap)
        counts = sparse.withColumn("input_ids", densify(F.col("indices"), F.col("counts"), len(chosen)))
    # One row per user on both sides.
    joined = counts.withColumnRenamed("uid", "_uid").join(first, F.col("_uid").eqNullSafe(F.col("uid")))
    return joined.select("uid", "tid", "input_ids").withColumn("attention_mask", ones_like(F.col("input_ids")))
