"""Text expressions: words, keyword counts, token ids. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.config import DELIMITERS
from tallyloom.functions.hashing import hash_int

# Fixed value: Unicode whitespace plus the four ASCII separators that count as whitespace.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def words(text: Column) -> Column:
    """Lower-cased whitespace-separated words, never empty strings."""
    return F.array_remove(F.split(F.lower(text), WHITESPACE), "")


def leading_word(text: Column) -> Column:
    """What stands before the first whitespace; the whole text if there is none."""
    return F.regexp_extract(text, r"(?U)^[^\s\x1c-\x1f]*", 0)


def trailing_word(text: Column) -> Column:
    """What stands after the last whitespace. Read backwards, so long texts are scanned once."""
    return F.reverse(leading_word(F.reverse(text)))


def delimiter_for(name: str) -> str:
    """The string of a delimiter name; an unknown name means no delimiter."""
    return DELIMITERS.get(name, "")


def delimiter_column(name: Column) -> Column:
    """Delimiter string chosen per row."""
    choice = F.when(F.lit(False), F.lit(""))
    for key, value in DELIMITERS.items():
        choice = choice.when(name == key, F.lit(value))
    return choice.otherwise(F.lit(""))


def is_blank(text: Column) -> Column:
    """True for texts that concatenation skips."""
    return text.isNull() | (text == "")


def null_text_fill(text: Column) -> Column:
    """A missing text becomes one space before tokenizing."""
    return F.coalesce(text, F.lit(" "))


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("int")


def token_length(text: Column, special_tokens: int = 2) -> Column:
    """Token count of one text under the default tokenizer."""
    return (word_count(text) + F.lit(special_tokens)).cast("int")


def keyword_vector(text: Column, keywords: Sequence[str], cap: int = -1) -> Column:
    """Exact-word counts in keyword order. Row-local: no shuffle.

    Words are first reduced to the keyword set by one hash lookup each; the counts then look at those
    few words only. The outer lambda binds them once, so the text is split a single time.
    """
    if not keywords:
        raise ValueError("the keyword list is empty")
    distinct = list(dict.fromkeys(keywords))
    asked = F.array(*[F.lit(k) for k in keywords])  # one literal, however long the list is

    def counts(found: Column) -> Column:
        def count(keyword: Column) -> Column:
            n = F.size(F.filter(found, lambda word: word == keyword))
            return (F.least(F.lit(cap), n) if cap >= 0 else n).cast("int")

        return F.transform(asked, count)

    hits = F.filter(words(text), lambda word: word.isin(distinct))
    return F.transform(F.array(hits), counts)[0]


def ones_like(values: Column) -> Column:
    """Mask of ones as long as `values`."""
    return F.transform(values, lambda _: F.lit(1))


def hashed_token_ids(text: Column, max_length: int | None, vocab_size: int) -> Column:
    """Ids 1..vocab_size-1 of all words, or of the first `max_length`; 0 stays free for padding."""
    return F.transform(
        words(text) if max_length is None else F.slice(words(text), 1, max_length),
        lambda word: (F.lit(1) + F.pmod(hash_int(word), F.lit(vocab_size - 1))).cast("int"),
    )


def windows_of(values: Column, length: int) -> Column:
    """Consecutive slices of at most `length` values; an empty array has one empty slice."""
    last = F.greatest(F.ceil(F.size(values) / length).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * length + 1, length))


def pad_to(values: Column, length: int, fill: int = 0) -> Column:
    """Right-pad an int array to a fixed length."""
    return F.concat(values, F.array_repeat(F.lit(fill), F.lit(length) - F.size(values)))
