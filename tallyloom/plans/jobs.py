"""Whole jobs, composed from operators. Each is one lazy plan around a few sized lookups."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.config import UNKNOWN_LABEL, LabelConfig, MiningConfig, TextConfig
from tallyloom.functions.text import DELIMITERS, word_count
from tallyloom.operators.keywords import keyword_counts_by, keyword_counts_of_parts
from tallyloom.operators.labels import (
    assign_label_ids,
    exclude_users,
    label_dictionary,
    labels_last_wins,
    nonempty_labels,
    report_split,
    slice_labels_by_fold,
    three_way_split,
    true_label_split,
)
from tallyloom.operators.packing import pack_by_uid
from tallyloom.operators.posts import concat_by_uid, filter_posts_by_uid
from tallyloom.operators.skew import lookup_join, stage_measured
from tallyloom.operators.staging import stage, stage_counted
from tallyloom.operators.triplets import mine, triplet_loss, triplet_vectors
from tallyloom.plans.linear import Certificate, fit_stacked, predict_stacked
from tallyloom.plans.models import EmbedderFactory, embed_texts
from tallyloom.plans.tokenize import TokenizerFactory, plugged_token_count, tokenize


def prepare_labels(
    rows: DataFrame,
    config: LabelConfig = LabelConfig(),
    true_rows: DataFrame | None = None,
    existing: DataFrame | None = None,
    map_test: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Label file to `(label rows with ids and split, dictionary)`.

    At random, or with hand-made labels as test split. Hand-made labels get ids from the same
    dictionary unless `map_test` is off.
    """
    dictionary = label_dictionary(rows, existing)
    # The filtered label file is written once: counting, cutting and joining all start from it.
    filtered, n = stage_counted(assign_label_ids(rows, dictionary))
    if true_rows is None:
        return three_way_split(filtered, config, total=n), dictionary
    if map_test:
        dictionary = label_dictionary(true_rows, dictionary)
        test = assign_label_ids(true_rows, dictionary)
    else:
        test = nonempty_labels(true_rows)
    return true_label_split(filtered, test, config.validation_ratio), dictionary


def report_labels(rows: DataFrame, true_rows: DataFrame, fold_entries: DataFrame) -> DataFrame:
    """Report split of one fold with label ids, all from one dictionary of both label files."""
    dictionary = label_dictionary(true_rows, label_dictionary(rows))
    known = stage(assign_label_ids(true_rows, dictionary))
    chosen = slice_labels_by_fold(fold_entries, known).select(*known.columns)
    return report_split(assign_label_ids(rows, dictionary), known, chosen)


def selected_test_split(
    rows: DataFrame, true_rows: DataFrame, test_uids: DataFrame, config: LabelConfig = LabelConfig()
) -> DataFrame:
    """Label rows with the listed users' hand-made labels as test split; ids from one dictionary of both files."""
    dictionary = label_dictionary(true_rows, label_dictionary(rows))
    known = stage(assign_label_ids(true_rows, dictionary))
    chosen = stage(slice_labels_by_fold(test_uids, known).select(*known.columns))
    return true_label_split(stage(assign_label_ids(rows, dictionary)), chosen, config.validation_ratio)


def user_split(split_rows: DataFrame) -> DataFrame:
    """Users of each split."""
    return split_rows.select("uid", "split").distinct()


def _label_rank() -> Column:
    rank = F.when(F.col("split") == "test", 2).when(F.col("split") == "validation", 1).otherwise(0)
    return F.struct(rank.alias("r"), F.col("row_idx"))


def user_label(split_rows: DataFrame) -> DataFrame:
    """One integer label per user; rows of later splits win: train, validation, test."""
    ranked = split_rows.withColumn("_order", _label_rank())
    return labels_last_wins(ranked, "_order").withColumn("label", F.col("label").cast("int"))


def user_table(split_rows: DataFrame) -> DataFrame:
    """`(uid, splits, label)`: the splits of a user, at most one entry per split name, and the label."""
    return split_rows.groupBy("uid").agg(
        F.collect_set("split").alias("splits"), F.max_by("label", _label_rank()).cast("int").alias("label")
    )


def place(rows: DataFrame, users: DataFrame, measured: tuple[int, int] | None = None) -> DataFrame:
    """Add split and label of each row's user in one join; a user in two splits is in both."""
    joined = lookup_join(rows, users, "uid", measured=measured, expensive=True).withColumn("split", F.explode("splits")).drop("splits")
    return joined.withColumn("label", F.coalesce("label", F.lit(UNKNOWN_LABEL)))


def preprocess(
    posts: DataFrame,
    split_rows: DataFrame,
    config: TextConfig = TextConfig(),
    concatenate: bool = True,
    overflow: str = "carry",
    tokenizer: TokenizerFactory | None = None,
    size: Column | None = None,
    truncate: bool = False,
) -> DataFrame:
    """Posts to model inputs: pack, split by user, label, tokenize.

    Columns `split, uid, tid, chunk_idx, window, text, label, input_ids, attention_mask`. Posts of users
    outside every split are dropped before their texts are packed. A chunk that holds more tokens than an
    input, a single long text, continues on further windows; with `truncate` its end is left out.
    """
    users, size_of_users = stage_measured(user_table(split_rows))
    wanted = filter_posts_by_uid(posts, users, size_of_users)
    if concatenate:
        counter = word_count if tokenizer is None else plugged_token_count(tokenizer)
        rows = pack_by_uid(wanted, config, overflow, counter, size=size)
    else:
        rows = wanted.withColumn("chunk_idx", F.col("row_idx"))
    inputs = tokenize(place(rows, users, size_of_users), config, tokenizer, windows=not truncate)
    if truncate:
        inputs = inputs.withColumn("window", F.lit(0))
    return inputs.select("split", "uid", "tid", "chunk_idx", "window", "text", "label", "input_ids", "attention_mask")


def preprocess_keywords(
    posts: DataFrame, split_rows: DataFrame, keywords: Sequence[str], config: TextConfig = TextConfig(), order: str = "row_idx"
) -> DataFrame:
    """Users to keyword counts over all their texts: `(split, uid, tid, label, input_ids, attention_mask)`.

    With a delimiter that is whitespace, the counts of the joined text are the sums over posts, so
    the joined text is never built. Other delimiters glue words together and need it.
    """
    users, size_of_users = stage_measured(user_table(split_rows))
    counted = _count_users(filter_posts_by_uid(posts, users, size_of_users), keywords, config, order)
    return place(counted, users, size_of_users).select("split", "uid", "tid", "label", "input_ids", "attention_mask")


def _count_users(posts: DataFrame, keywords: Sequence[str], config: TextConfig, order: str) -> DataFrame:
    """`(uid, tid, input_ids, attention_mask)` over all texts of each user; the posts are read once."""
    glued = DELIMITERS.get(config.delimiter, "").strip() != "" or config.delimiter not in DELIMITERS
    if glued:
        return keyword_counts_of_parts(concat_by_uid(posts, config.delimiter, order), keywords, config.keyword_cap)
    return keyword_counts_by(posts, ["uid"], keywords, config.keyword_cap, first=("tid", order))


def fold_users(rows: DataFrame, true_rows: DataFrame, folds: DataFrame, names: Sequence[str]) -> DataFrame:
    """`(uid, places)`: the split and label of every user in each named fold, from one pass over the label files.

    What `report_labels` gives fold by fold: users with hand-made labels are in the test split of the folds that
    list them and in the validation split of the others, all other users are in the train split of every fold.
    """
    dictionary = label_dictionary(true_rows, label_dictionary(rows))
    known = stage(labels_last_wins(assign_label_ids(true_rows, dictionary)))
    at = F.array_position(F.array(*[F.lit(name) for name in names]), F.col("fold")).cast("int") - 1
    listed = folds.select("uid", at.alias("at")).filter("at >= 0").groupBy("uid").agg(F.collect_set("at").alias("listed"))
    every = F.sequence(F.lit(0), F.lit(len(names) - 1))

    def places(split: Callable[[Column], Column]) -> Column:
        def place(i: Column) -> Column:
            return F.struct(i.alias("fold"), F.array(split(i)).alias("splits"), F.col("label").cast("int").alias("label"))

        return F.transform(every, place).alias("places")

    tested = F.coalesce("listed", F.array().cast("array<int>"))
    tests = lookup_join(known, listed, "uid", "left").select(
        "uid", places(lambda i: F.when(F.array_contains(tested, i), "test").otherwise("validation"))
    )
    others = labels_last_wins(exclude_users(assign_label_ids(rows, dictionary), known))
    return others.select("uid", places(lambda i: F.lit("train"))).unionByName(tests)


def baseline_by_fold(
    posts: DataFrame,
    rows: DataFrame,
    true_rows: DataFrame,
    folds: DataFrame,
    names: Sequence[str],
    keywords: Sequence[str],
    model_path: str | None = None,
    config: TextConfig = TextConfig(),
    order: str = "row_idx",
    **fit,
) -> tuple[DataFrame, list[Certificate]]:
    """`(fold, split, uid, label, prediction)` and a certificate per fold: linear baselines on keyword counts.

    The posts are read once, whatever the number of folds: a user's counts are taken once and carry the
    user's place in each fold, all folds are fitted by shared passes, and one pass predicts for all of them.
    With `model_path` each fold's model is saved below it.
    """
    users, size_of_users = stage_measured(fold_users(rows, true_rows, folds, names))
    counted = _count_users(filter_posts_by_uid(posts, users, size_of_users), keywords, config, order)
    joined = lookup_join(counted.select("uid", "input_ids"), users, "uid", measured=size_of_users, expensive=True)

    def own(fold: Column) -> Column:
        trained = F.filter("places", lambda p: (p["fold"] == fold) & F.array_contains(p["splits"], "train"))
        return F.coalesce(F.get(trained, F.lit(0))["label"], F.lit(UNKNOWN_LABEL))

    every = F.sequence(F.lit(0), F.lit(len(names) - 1))
    table = stage(joined.withColumn("labels", F.transform(every, own)))
    top = table.agg(F.max(F.array_max("labels"))).first()[0]
    fitted = fit_stacked(table, len(names), max(1, (UNKNOWN_LABEL if top is None else top) + 1), **fit)
    models = [model for model, _ in fitted]
    if model_path:
        for name, model in zip(names, models):
            model.save(posts.sparkSession, f"{model_path}/{name}")
    placed = predict_stacked(table, models).select("uid", "predictions", F.explode("places").alias("p"))
    label = F.coalesce(F.col("p.label"), F.lit(UNKNOWN_LABEL))
    named = F.array(*[F.lit(name) for name in names])
    predicted = placed.select(
        F.get(named, F.col("p.fold")).alias("fold"), F.explode("p.splits").alias("split"), "uid", label.alias("label"),
        F.get("predictions", F.col("p.fold")).alias("prediction"),
    )
    return predicted, [proof for _, proof in fitted]


def mine_triplets(
    posts: DataFrame, config: MiningConfig = MiningConfig(), embedder: EmbedderFactory | None = None, text: TextConfig = TextConfig()
) -> tuple[DataFrame, DataFrame]:
    """Embed whole posts once, mine triplets, report the loss: `(triplets, loss)`.

    `posts` has `row_idx, uid, label, text`. The embedded posts and the triplets are written once; both feed
    several joins.
    """
    embedded = stage(embed_texts(posts, ("row_idx", "uid", "label"), text, factory=embedder))
    triplets = stage(mine(embedded, config))
    return triplets, triplet_loss(triplet_vectors(triplets, embedded), config)
