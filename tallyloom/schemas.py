"""Schemas of the tables that move between jobs."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in columns.items()])


POSTS = _struct(row_idx=_L, uid=_S, tid=_S, text=_S, created_at=_S)
USER_LABELS = _struct(row_idx=_L, label=_S, screen_name=_S, uid=_S)
LABELS = _struct(uid=_S, label=_I)
FOLDS = _struct(fold=_S, pos=_I, uid=_S)
PROCESSED = _struct(
    split=_S, row_idx=_L, uid=_S, tid=_S, text=_S, label=_I,
    input_ids=T.ArrayType(_I), attention_mask=T.ArrayType(_I),
)
EMBEDDINGS = _struct(row_idx=_L, uid=_S, embedding=T.ArrayType(T.FloatType()), label=_I)
PREDICTIONS = _struct(uid=_S, batch_id=_L, pos=_L, prediction=_I)
LOGITS = _struct(batch_id=_L, pos=_L, uid=_S, logits=T.ArrayType(_D), label=_I, loss_mask=_I)
TRIPLETS = _struct(
    batch_id=_L, rank=_I, anc_idx=_I, neg_idx=_I, anc_row=_L, pos_row=_L, neg_row=_L, margin=_D,
)

# Raw posts as delivered: JSON lines carry other id names and a time as number or text.
POSTS_JSON = _struct(tweet_id=_S, user_id=_S, text=_S, created_at=_S)
