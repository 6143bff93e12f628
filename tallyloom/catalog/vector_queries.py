"""Embeddings, distances, pooling and triplet mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalog.bindings import embedded, order_posts, table
from tallyloom.catalog.post_queries import ORDER_POSTS_SQL
from tallyloom.catalog.registry import query
from tallyloom.config import MiningConfig
from tallyloom.functions import vectors as V
from tallyloom.operators import embeddings as EM
from tallyloom.operators import triplets as T

MASKED = MiningConfig(require_labels=True, enable_masking=True)
TIGHT = MiningConfig(threshold=0.5)

EMBEDDED_SQL = "SELECT vec_id AS row_idx, label::VARCHAR AS uid, label, embedding::DOUBLE[] AS e FROM embeddings"
L2 = "list_sum(list_transform(list_zip({x}, {y}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
DOT = "list_sum(list_transform(list_zip({x}, {y}), lambda p: p[1] * p[2]))"


def l2_sql(x: str, y: str) -> str:
    return L2.format(x=x, y=y)


def cosine_sql(x: str, y: str) -> str:
    return (
        f"1 - {DOT.format(x=x, y=y)} / (sqrt({DOT.format(x=x, y=x)}) * sqrt({DOT.format(x=y, y=y)}))"
    )


@query("""
SELECT uid, n_posts, dim, round(v, 6) + 0.0 AS value FROM (
  SELECT label::VARCHAR AS uid, count(*) AS n_posts, dim, avg(v) AS v
  FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
  GROUP BY label, dim
)
""")
def user_mean_embedding(spark, sf):
    means = EM.user_mean_embedding(embedded(spark, sf))
    return means.select("uid", "n_posts", F.posexplode("embedding").alias("dim", "v")).select(
        "uid", "n_posts", F.col("dim").cast("long").alias("dim"), (F.round("v", 6) + F.lit(0.0)).alias("value")
    )


@query("""
SELECT label::VARCHAR AS uid, vec_id AS row_idx, generate_subscripts(embedding, 1) - 1 AS dim,
       unnest(embedding)::DOUBLE AS value
FROM embeddings
""")
def user_all_embeddings(spark, sf):
    rows = EM.user_all_embeddings(embedded(spark, sf))
    return rows.select("uid", "row_idx", F.posexplode("embedding").alias("dim", "v")).select(
        "uid", "row_idx", F.col("dim").cast("long").alias("dim"), F.col("v").cast("double").alias("value")
    )


def _list_sql(part_rows):
    return f"""
WITH placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place FROM embeddings)
SELECT label::VARCHAR AS uid, place // {part_rows} AS part, place % {part_rows} AS at,
       unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS value
FROM placed
"""


def _list_values(lists):
    items = lists.select("uid", "part", F.posexplode("embeddings").alias("at", "embedding"))
    values = items.select("uid", "part", "at", F.posexplode("embedding").alias("dim", "value"))
    return values.select(
        "uid", "part", F.col("at").cast("long").alias("at"), F.col("dim").cast("long").alias("dim"), F.col("value").cast("double").alias("value")
    )


@query(_list_sql(4_096))
def user_embedding_lists(spark, sf):
    return _list_values(EM.user_embedding_lists(embedded(spark, sf)))


@query(_list_sql(16))
def user_embedding_lists_parts(spark, sf):
    """The same lists on rows of at most sixteen vectors."""
    return _list_values(EM.user_embedding_lists(embedded(spark, sf), part_rows=16))


# --- distances -------------------------------------------------------------------------------

PAIR_SQL = "FROM embeddings a JOIN (SELECT label, arg_min(embedding, vec_id) AS c FROM embeddings GROUP BY label) b USING (label)"


def _with_first(spark, sf):
    rows = table(spark, sf, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c"))
    return rows.join(first, "label")


@query(f"SELECT vec_id, round({l2_sql('a.embedding::DOUBLE[]', 'b.c::DOUBLE[]')}, 6) AS distance {PAIR_SQL}")
def squared_l2(spark, sf):
    return _with_first(spark, sf).select("vec_id", F.round(V.squared_l2(F.col("embedding"), F.col("c")), 6).alias("distance"))


@query(f"SELECT vec_id, round({cosine_sql('a.embedding::DOUBLE[]', 'b.c::DOUBLE[]')}, 6) + 0.0 AS distance {PAIR_SQL}")
def cosine_distance(spark, sf):
    return _with_first(spark, sf).select(
        "vec_id", (F.round(V.cosine_distance(F.col("embedding"), F.col("c")), 6) + F.lit(0.0)).alias("distance")
    )


# Fixed weights: class j of a linear head weighs component i by ((i + j) % 3 - 1) / 2.
WEIGHTS = [[((i + j) % 3 - 1) / 2 for i in range(64)] for j in range(2)]
BIAS = [0.25, -0.25]


def _linear_sql(vector: str, j: int) -> str:
    weights = "[" + ", ".join(str(w) for w in WEIGHTS[j]) + "]::DOUBLE[]"
    return f"{DOT.format(x=vector, y=weights)} + ({BIAS[j]})"


@query("SELECT vec_id, " + ", ".join(
    f"round({_linear_sql('embedding::DOUBLE[]', j)}, 6) + 0.0 AS logit_{j}" for j in range(2)) + " FROM embeddings")
def linear_logits(spark, sf):
    out = V.linear_logits(F.col("embedding"), WEIGHTS, BIAS)
    return table(spark, sf, "embeddings").select("vec_id", out.alias("z")).select(
        "vec_id", *[(F.round(F.col("z")[j], 6) + F.lit(0.0)).alias(f"logit_{j}") for j in range(2)]
    )


# --- pooling ---------------------------------------------------------------------------------


def _tokens(spark, sf):
    return table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("pos"), "embedding")


def _values(pooled):
    return pooled.select("label", F.posexplode("embedding").alias("dim", "v")).select(
        "label", F.col("dim").cast("long").alias("dim"), (F.round(F.col("v").cast("double"), 6) + F.lit(0.0)).alias("value")
    )


@query("""
SELECT label, generate_subscripts(e, 1) - 1 AS dim, round(unnest(e)::DOUBLE, 6) + 0.0 AS value
FROM (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY label)
""")
def pool_cls(spark, sf):
    return _values(EM.pool(_tokens(spark, sf), "label", "cls_embedding_only"))


@query("""
SELECT label, dim, round(avg(v), 6) + 0.0 AS value FROM (
  SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings
) GROUP BY label, dim
""")
def pool_mean(spark, sf):
    return _values(EM.pool(_tokens(spark, sf), "label", "word_embedding_mean"))


@query("""
SELECT label, generate_subscripts(z, 1) - 1 AS dim, round(unnest(z), 6) + 0.0 AS value FROM (
  SELECT label, [""" + ", ".join(f"tanh({_linear_sql('e', j)})" for j in range(2)) + """] AS z
  FROM (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS e FROM embeddings GROUP BY label)
)
""")
def pool_cls_dense(spark, sf):
    return _values(EM.pool(_tokens(spark, sf), "label", "cls_embedding_with_dense_layer", weights=WEIGHTS, bias=BIAS))


# --- sampling and batches --------------------------------------------------------------------


@query(f"""
SELECT p.row_idx AS anc_row, uid, n_candidates, first_row, last_row FROM ({ORDER_POSTS_SQL}) p
JOIN (SELECT uid, count(*) AS n_candidates, min(row_idx) AS first_row, max(row_idx) AS last_row
      FROM ({ORDER_POSTS_SQL}) GROUP BY uid) c USING (uid)
""")
def positive_candidates(spark, sf):
    return T.positive_candidates(order_posts(spark, sf)).select("anc_row", "uid", "n_candidates", "first_row", "last_row")


PAIRS_SQL = f"""
SELECT a.row_idx AS anc_row, uid, b.row_idx AS pos_row FROM ({ORDER_POSTS_SQL}) a JOIN ({ORDER_POSTS_SQL}) b USING (uid)
"""


@query(PAIRS_SQL)
def positive_pairs(spark, sf):
    """All candidate rows of every anchor."""
    return T.positive_pairs(order_posts(spark, sf))[0]


@query(PAIRS_SQL)
def positive_pairs_parts(spark, sf):
    """The same relation from parts of three rows, so that most users have several."""
    return T.positive_pairs(order_posts(spark, sf), part_rows=3)[0]


@query(f"""
WITH ranked AS (
  SELECT uid, row_idx, row_number() OVER (PARTITION BY uid ORDER BY row_idx) - 1 AS place, count(*) OVER (PARTITION BY uid) AS n
  FROM ({ORDER_POSTS_SQL})
)
SELECT a.row_idx AS anc_row, a.uid, p.part FROM ranked a JOIN (SELECT DISTINCT uid, place // 4 AS part FROM ranked) p USING (uid)
WHERE a.n * a.n > 200
""")
def positive_pairs_lazy(spark, sf):
    """Users with more than 200 pairs: each anchor with the parts of four rows that it may be paired with."""
    return T.positive_pairs(order_posts(spark, sf), part_rows=4, max_square=200)[1]


def positives_sql(posts: str, seed: str) -> str:
    return f"""
ranked AS (
  SELECT uid, row_idx, row_number() OVER (PARTITION BY uid ORDER BY row_idx) - 1 AS at, count(*) OVER (PARTITION BY uid) AS n
  FROM ({posts})
),
positives AS (
  SELECT a.row_idx AS anc_row, a.uid, b.row_idx AS pos_row FROM ranked a JOIN ranked b
  ON a.uid = b.uid AND b.at = ('0x' || substr(md5('{seed}|' || a.row_idx), 1, 15))::BIGINT % a.n
)
"""


@query(f"WITH {positives_sql(ORDER_POSTS_SQL, '0')} SELECT * FROM positives")
def sample_positives(spark, sf):
    return T.sample_positives(order_posts(spark, sf))


def windows_sql(posts: str) -> str:
    return f"""
n AS (SELECT count(*) AS n FROM ({posts})),
neg_perm AS (
  SELECT row_idx, row_number() OVER (ORDER BY md5('0/negative|' || row_idx), row_idx) - 1 AS p FROM ({posts})
),
slots AS (SELECT s // 128 AS batch_id, (s % 128)::INT AS slot, s % n AS p FROM n, range(0, n // 16 * 128) r(s)),
negatives AS (SELECT batch_id, slot, row_idx FROM slots JOIN neg_perm USING (p))
"""


@query(f"WITH {windows_sql(EMBEDDED_SQL)} SELECT * FROM negatives")
def negative_windows(spark, sf):
    rows = embedded(spark, sf).select("row_idx")
    return T.negative_windows(rows).select("batch_id", "slot", "row_idx")


def batch_sql(posts: str) -> str:
    return f"""
{windows_sql(posts)}, {positives_sql(posts, '0/positive')},
anc_perm AS (
  SELECT row_idx, row_number() OVER (ORDER BY md5('0/anchor|' || row_idx), row_idx) - 1 AS p FROM ({posts})
),
anchors AS (SELECT p // 16 AS batch_id, (p % 16)::INT AS slot, row_idx FROM anc_perm, n WHERE p < n // 16 * 16),
vecs AS ({posts}),
pairs AS (
  SELECT a.batch_id, n.slot AS neg_idx, a.slot AS anc_idx, a.row_idx AS anc_row, p.pos_row, n.row_idx AS neg_row,
         {l2_sql('av.e', 'nv.e')} AS d_neg, {l2_sql('av.e', 'pv.e')} AS d_pos, av.label = nv.label AS same
  FROM anchors a JOIN negatives n USING (batch_id) JOIN positives p ON p.anc_row = a.row_idx
  JOIN vecs av ON av.row_idx = a.row_idx JOIN vecs nv ON nv.row_idx = n.row_idx JOIN vecs pv ON pv.row_idx = p.pos_row
)
"""


BATCH_SQL = batch_sql(EMBEDDED_SQL)


@query(f"""
WITH {BATCH_SQL}
SELECT batch_id, 'anchor' AS role, slot, row_idx FROM anchors
UNION ALL SELECT batch_id, 'positive', slot, pos_row FROM anchors JOIN positives ON anc_row = row_idx
UNION ALL SELECT batch_id, 'negative', slot, row_idx FROM negatives
""")
def mining_batches(spark, sf):
    return T.mining_batches(embedded(spark, sf))


@query(f"WITH {BATCH_SQL} SELECT batch_id, neg_idx, anc_idx FROM pairs")
def neg_anc_index_grid(spark, sf):
    return T.neg_anc_index_grid(T.mining_batches(embedded(spark, sf)))


@query(f"WITH {BATCH_SQL} SELECT batch_id, neg_idx, anc_idx, round(d_neg, 6) AS distance FROM pairs")
def anc_neg_distance(spark, sf):
    rows = T.anc_neg_distance(T.embedded_batches(embedded(spark, sf)))
    return rows.withColumn("distance", F.round("distance", 6))


@query(f"WITH {BATCH_SQL} SELECT batch_id, neg_idx, anc_idx, round(d_neg - d_pos, 6) + 0.0 AS margin FROM pairs")
def margins(spark, sf):
    rows = T.margins(T.embedded_batches(embedded(spark, sf)))
    return rows.withColumn("margin", F.round("margin", 6) + F.lit(0.0))


@query(f"""
WITH {BATCH_SQL}
SELECT batch_id, neg_idx, anc_idx, round(d_neg - d_pos, 6) + 0.0 AS margin,
       row_number() OVER (ORDER BY round(d_neg - d_pos, 6), batch_id, neg_idx, anc_idx) AS rank,
       row_number() OVER (PARTITION BY batch_id ORDER BY round(d_neg - d_pos, 6), neg_idx, anc_idx)::INT AS batch_rank
FROM pairs
""")
def sorted_margins(spark, sf):
    """Margins are rounded before they are ranked, as sums of another engine differ in the last digits."""
    rows = T.margins(T.embedded_batches(embedded(spark, sf)))
    return T.sorted_margins(rows.withColumn("margin", F.round("margin", 6) + F.lit(0.0)))


@query(f"""
WITH {BATCH_SQL}
SELECT batch_id, neg_idx, anc_idx, CASE WHEN same THEN 'Infinity'::DOUBLE ELSE 0.0::DOUBLE END AS penalty FROM pairs
""")
def eligibility_mask(spark, sf):
    return T.eligibility_mask(T.embedded_batches(embedded(spark, sf)), MASKED)


def top_sql(masked: bool) -> str:
    margin = "CASE WHEN same THEN 'Infinity'::DOUBLE ELSE d_neg - d_pos END" if masked else "d_neg - d_pos"
    return f"""
top AS (
  SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY {margin}, neg_idx, anc_idx)::INT AS rank,
         anc_idx, neg_idx, anc_row, pos_row, neg_row, {margin} AS margin
  FROM pairs QUALIFY rank <= 16
)
"""


@query(f"WITH {BATCH_SQL}, {top_sql(False)} SELECT * REPLACE (round(margin, 6) + 0.0 AS margin) FROM top")
def top_triplets(spark, sf):
    rows = T.mine(embedded(spark, sf))
    return rows.withColumn("margin", F.round("margin", 6) + F.lit(0.0))


@query(f"WITH {BATCH_SQL}, {top_sql(True)} SELECT * REPLACE (round(margin, 6) + 0.0 AS margin) FROM top")
def top_triplets_masked(spark, sf):
    rows = T.top_triplets(T.embedded_batches(embedded(spark, sf)), MASKED)
    return rows.withColumn("margin", F.round("margin", 6) + F.lit(0.0))


@query(f"""
WITH {BATCH_SQL}, {top_sql(False)},
roles AS (
  SELECT batch_id, rank, 'anchor' AS role, anc_row AS row_idx FROM top
  UNION ALL SELECT batch_id, rank, 'positive', pos_row FROM top
  UNION ALL SELECT batch_id, rank, 'negative', neg_row FROM top
)
SELECT batch_id, rank, role, row_idx, row_idx || ',' || label AS ids FROM roles JOIN vecs USING (row_idx)
""")
def triplet_token_rows(spark, sf):
    rows = embedded(spark, sf)
    tokens = rows.select(
        "row_idx", F.array(F.col("row_idx"), F.col("label").cast("long")).alias("input_ids"), F.array(F.lit(1), F.lit(1)).alias("attention_mask")
    )
    top = T.top_triplets(T.embedded_batches(rows))
    found = T.triplet_token_rows(top, tokens)
    return found.select(
        "batch_id", "rank", "role", "row_idx",
        F.array_join(F.transform("input_ids", lambda v: v.cast("string")), ",").alias("ids"),
    )


def hinges_sql(threshold: float, cosine: bool) -> str:
    metric = cosine_sql if cosine else l2_sql
    return f"""
hinges AS (
  SELECT greatest(0.0::DOUBLE, ({metric('a.e', 'p.e')}) - ({metric('a.e', 'n.e')}) + {threshold}::DOUBLE) AS h
  FROM top JOIN vecs a ON a.row_idx = anc_row JOIN vecs p ON p.row_idx = pos_row JOIN vecs n ON n.row_idx = neg_row
)
"""


def _loss_sql(threshold: float, cosine: bool) -> str:
    return f"""
WITH {BATCH_SQL}, {top_sql(False)}, {hinges_sql(threshold, cosine)}
SELECT count(*) AS n_triplets, round(avg(h), 6) AS loss, round(avg(h) - {threshold}::DOUBLE, 6) + 0.0 AS net_loss FROM hinges
"""


def _loss(spark, sf, config):
    rows = embedded(spark, sf)
    loss = T.triplet_loss(T.triplet_vectors(T.top_triplets(T.embedded_batches(rows), config), rows), config)
    return loss.select(
        "n_triplets", F.round("loss", 6).alias("loss"), (F.round("net_loss", 6) + F.lit(0.0)).alias("net_loss")
    )


@query(_loss_sql(100.0, cosine=False))
def triplet_loss_l2(spark, sf):
    return _loss(spark, sf, MiningConfig())


@query(_loss_sql(0.5, cosine=False))
def triplet_loss_l2_tight(spark, sf):
    return _loss(spark, sf, TIGHT)


@query(_loss_sql(0.5, cosine=True))
def triplet_loss_cosine(spark, sf):
    return _loss(spark, sf, MiningConfig(threshold=0.5, distance="cosine"))
