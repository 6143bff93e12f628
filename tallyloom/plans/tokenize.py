"""Token ids and attention masks: a built-in hashed tokenizer, or a plugged one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.config import TextConfig
from tallyloom.functions.text import hashed_token_ids, null_text_fill, pad_to, windows_of

# A factory builds the tokenizer once per Python worker; the tokenizer maps texts to id lists.
TokenizerFactory = Callable[[], Callable[[list[str]], list[list[int]]]]


def _plugged_ids(factory: TokenizerFactory, max_length: int | None) -> Callable[[Column], Column]:
    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = factory()
        for texts in batches:
            yield pd.Series([row[:max_length] for row in tokenizer(texts.tolist())], index=texts.index)

    return ids


def plugged_token_count(factory: TokenizerFactory) -> Callable[[Column], Column]:
    """Token count of a text by a plugged tokenizer, for packing."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = factory()
        for texts in batches:
            yield pd.Series([len(row) for row in tokenizer(texts.fillna("").tolist())], index=texts.index)

    return count


def tokenize(
    posts: DataFrame, config: TextConfig = TextConfig(), factory: TokenizerFactory | None = None, windows: bool = False
) -> DataFrame:
    """Add fixed-length `input_ids` and `attention_mask`. Row-local.

    A text of more than `max_seq_length` tokens is cut there. With `windows` it is not: the text becomes
    consecutive rows, numbered in `window`, that together hold all its tokens.
    """
    text = null_text_fill(F.col("text"))
    size = config.max_seq_length
    most = None if windows else size
    ids = hashed_token_ids(text, most, config.vocab_size) if factory is None else _plugged_ids(factory, most)(text)
    if windows:
        # The outer transform binds the ids, so that the text is tokenized once.
        cut = F.transform(F.array(ids), lambda all_ids: windows_of(all_ids, size))[0]
        rows = posts.select("*", F.posexplode(cut).alias("window", "_ids"))
    else:
        rows = posts.withColumn("_ids", ids)
    return (
        rows.withColumn("input_ids", pad_to(F.col("_ids"), size))
        .withColumn("attention_mask", pad_to(F.transform("_ids", lambda _: F.lit(1)), size))
        .drop("_ids")
    )
