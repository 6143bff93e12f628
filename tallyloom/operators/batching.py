"""Fixed-size batches over a dense 0-based `row_idx`. Batch membership is arithmetic: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.config import UNKNOWN_LABEL
from tallyloom.operators.rowindex import hash_order_index


def _slot(rows: DataFrame, size: int, index: str) -> DataFrame:
    return rows.withColumn("batch_id", F.expr(f"`{index}` div {size}L")).withColumn(
        "pos", (F.col(index) % size).cast("long")
    )


def num_batches(rows: DataFrame, size: int) -> DataFrame:
    """Number of batches including a trailing short one."""
    return rows.agg(F.expr(f"(count(1) + {size - 1}) div {size}L").alias("n_batches"))


def batches_drop_last(rows: DataFrame, size: int, index: str = "row_idx", total: int | None = None) -> DataFrame:
    """Full batches only."""
    total = rows.count() if total is None else total
    return _slot(rows.filter(F.col(index) < total // size * size), size, index)


def batches_with_leftovers(
    rows: DataFrame, size: int, index: str = "row_idx", repeat: bool = True, total: int | None = None
) -> DataFrame:
    """Full batches and a batch for what is left.

    With `repeat` that batch is the last `size` rows, some of which were already returned; otherwise
    it holds just the rows that are left, so that each row occurs once.
    """
    total = rows.count() if total is None else total
    if not repeat:
        return _slot(rows, size, index)
    full = batches_drop_last(rows, size, index, total)
    first = max(0, total - size)
    tail = (
        rows.filter(F.col(index) >= first)
        .withColumn("batch_id", F.lit(total // size).cast("long"))
        .withColumn("pos", (F.col(index) - first).cast("long"))
    )
    return full.unionByName(tail)


def with_info_defaults(rows: DataFrame) -> DataFrame:
    """Batch info fields are never missing: absent ids become empty strings."""
    out = rows
    for name in ("uid", "tid"):
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit("")) if name in rows.columns else F.lit(""))
    return out


def padded_batches(
    rows: DataFrame, size: int, index: str = "row_idx", shuffle_seed: int | None = None, total: int | None = None
) -> DataFrame:
    """Classifier batches: every batch is full, and padding rows have `loss_mask` 0.

    Padding has zero ids and masks, label -1 and no user. `shuffle_seed` permutes the rows first.
    """
    total = rows.count() if total is None else total
    if shuffle_seed is not None:
        rows = hash_order_index(rows, index, shuffle_seed, "_perm")
        batches = _slot(rows, size, "_perm").drop("_perm")
    else:
        batches = _slot(rows, size, index)
    batches = batches.withColumn("loss_mask", F.lit(1))
    missing = -total % size
    if not missing:
        return batches
    fill = {"label": F.lit(UNKNOWN_LABEL), "loss_mask": F.lit(0)}
    padding = rows.sparkSession.range(size - missing, size).select(
        F.lit(total // size).cast("long").alias("batch_id"), F.col("id").alias("pos")
    )
    columns = []
    for field in batches.schema.fields:
        if field.name in ("batch_id", "pos"):
            columns.append(F.col(field.name))
            continue
        value = fill.get(field.name, F.lit(None))
        if field.name in ("input_ids", "attention_mask"):
            width = rows.select(F.size(field.name).alias("n")).first()["n"]
            value = F.array_repeat(F.lit(0), width)
        columns.append(value.cast(field.dataType).alias(field.name))
    return batches.unionByName(padding.select(*columns))
