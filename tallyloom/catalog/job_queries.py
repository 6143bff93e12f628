"""Whole jobs and model-facing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalog.bindings import (
    KEYWORDS,
    document_posts,
    embedded,
    join_ints,
    single_posts,
    string,
    table,
    turn_posts,
)
from tallyloom.catalog.post_queries import counts_sql, ids_sql, pack_sql, padded_sql, words_sql
from tallyloom.catalog.registry import query
from tallyloom.catalog.vector_queries import batch_sql, hinges_sql, top_sql
from tallyloom.config import MiningConfig
from tallyloom.functions.hashing import hash_int
from tallyloom.operators.keywords import keyword_counts
from tallyloom.operators.staging import stage
from tallyloom.plans import models as M
from tallyloom.plans.jobs import baseline_by_fold, mine_triplets, prepare_labels, preprocess, preprocess_keywords
from tallyloom.plans.linear import class_mean_model


def _split_sql(rows: str) -> str:
    """Label file to `split_rows(uid, label, split)` as the label job does it."""
    return f"""
rows_in AS ({rows}),
firsts AS (SELECT label, min(row_idx) AS f FROM rows_in GROUP BY label),
dict AS (SELECT label AS label_text, (row_number() OVER (ORDER BY f) - 1)::INT AS label_id FROM firsts),
mapped AS (SELECT r.row_idx, d.label_id, r.uid FROM rows_in r JOIN dict d ON r.label = d.label_text),
sized AS (SELECT count(*) AS n, floor(count(*) * 0.2::DOUBLE)::BIGINT AS t FROM mapped),
cuts AS (SELECT n, t, floor((n - t) * (0.2::DOUBLE / (1 - 0.2::DOUBLE)))::BIGINT AS v FROM sized),
placed AS (SELECT *, row_number() OVER (ORDER BY md5('0|' || row_idx), row_idx) AS p FROM mapped),
split_rows AS (
  SELECT uid, label_id AS label,
         CASE WHEN p > n - t THEN 'test' WHEN p > n - t - v THEN 'validation' ELSE 'train' END AS split
  FROM placed, cuts
)
"""


def source_labels(spark, sf):
    """Label file of the document sources: source k has the region of nation k as class."""
    region = table(spark, sf, "region")
    return (
        table(spark, sf, "nation")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_nationkey").cast("long").alias("row_idx"), F.col("r_name").alias("label"),
            F.col("n_name").alias("screen_name"), F.concat(F.lit("src"), string("n_nationkey")).alias("uid"),
        )
    )


SOURCE_LABELS_SQL = """
SELECT n_nationkey::BIGINT AS row_idx, r_name AS label, 'src' || n_nationkey AS uid
FROM nation JOIN region ON n_regionkey = r_regionkey
"""


@query(f"""
WITH {_split_sql(SOURCE_LABELS_SQL)},
users AS (
  SELECT source AS uid, doc_id, doc_id::VARCHAR AS tid, {words_sql('text')} AS w FROM documents
),
joined AS (SELECT uid, flatten(list(w)) AS w, arg_min(tid, doc_id) AS tid FROM users GROUP BY uid)
SELECT split, uid, tid, label, {counts_sql('w')} AS counts FROM joined JOIN split_rows USING (uid)
""")
def preprocess_keywords_job(spark, sf):
    split_rows, _ = prepare_labels(source_labels(spark, sf))
    users = preprocess_keywords(document_posts(spark, sf), split_rows, KEYWORDS)
    return users.select("split", "uid", "tid", "label", join_ints(F.col("input_ids")).alias("counts"))


QUALITY_LABELS_SQL = """
SELECT doc_id AS row_idx, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS label, doc_id::VARCHAR AS uid FROM labels
"""


def quality_labels(spark, sf):
    """Label file by document quality; users are documents or conversations of that number."""
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("row_idx"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"),
        string("doc_id").alias("screen_name"), string("doc_id").alias("uid"),
    )


@query(f"""
WITH RECURSIVE {pack_sql('carry')}, {_split_sql(QUALITY_LABELS_SQL)},
tokens AS (
  SELECT uid, chunk_idx, tid, text, k AS win, {ids_sql('w[k * 128 + 1:k * 128 + 128]')} AS ids
  FROM (
    SELECT *, unnest(range(0, greatest(1, ceil(len(w) / 128.0)::BIGINT))) AS k
    FROM (SELECT *, {words_sql('text')} AS w FROM chunks JOIN users USING (uid))
  )
)
SELECT split, uid, tid, chunk_idx, win::INT AS "window", text, label, {padded_sql('ids')} AS input_ids, len(ids)::INT AS n_mask
FROM tokens JOIN split_rows USING (uid)
""")
def preprocess_job(spark, sf):
    split_rows, _ = prepare_labels(quality_labels(spark, sf))
    rows = preprocess(turn_posts(spark, sf), split_rows)
    return rows.select(
        "split", "uid", "tid", "chunk_idx", "window", "text", "label", join_ints(F.col("input_ids")).alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, v: a + v).alias("n_mask"),
    )


# --- embedding -------------------------------------------------------------------------------

# All words of a text, in windows of 128; the text's vector is the mean of its windows by their words.
BAG_SQL = f"""
texts AS (SELECT doc_id, source, {words_sql("coalesce(text, ' ')")} AS w FROM documents),
windows AS (SELECT doc_id, source, w, unnest(range(0, greatest(1, ceil(len(w) / 128.0)::BIGINT))) AS k FROM texts),
tokens AS (SELECT doc_id, source, k, {ids_sql("w[k * 128 + 1:k * 128 + 128]")} AS ids FROM windows),
bags AS (
  SELECT doc_id, source, k, greatest(len(ids), 1) AS n,
         list_transform(range(32), lambda d: len(list_filter(ids, lambda i: i % 32 = d))) AS c
  FROM tokens
),
parts AS (
  SELECT doc_id, source, n, list_transform(c, lambda v: v / sqrt(list_sum(list_transform(c, lambda u: u * u)))) AS e FROM bags
),
means AS (SELECT doc_id, source, d, sum(e[d + 1] * n) / sum(n) AS v FROM parts, range(32) r(d) GROUP BY doc_id, source, d),
vecs AS (SELECT doc_id, source, list(v ORDER BY d) AS e FROM means GROUP BY doc_id, source)
"""


@query(f"""
WITH {BAG_SQL}
SELECT doc_id AS row_idx, generate_subscripts(e, 1) - 1 AS dim, round(unnest(e), 4) AS value FROM vecs
""")
def embed_posts(spark, sf):
    rows = M.embed_texts(document_posts(spark, sf))
    return rows.select("row_idx", F.posexplode("embedding").alias("dim", "v")).select(
        "row_idx", F.col("dim").cast("long").alias("dim"), F.round(F.col("v").cast("double"), 4).alias("value")
    )


@query(f"""
WITH {BAG_SQL}
SELECT uid, dim, n_posts, round(v, 4) AS value FROM (
  SELECT source AS uid, dim, count(*) AS n_posts, avg(v) AS v
  FROM (SELECT source, generate_subscripts(e, 1) - 1 AS dim, unnest(e) AS v FROM vecs) GROUP BY source, dim
)
""")
def user_embedding_job(spark, sf):
    means = M.user_embeddings(M.embed_texts(document_posts(spark, sf)))
    return means.select("uid", "n_posts", F.posexplode("embedding").alias("dim", "v")).select(
        "uid", F.col("dim").cast("long").alias("dim"), "n_posts", F.round("v", 4).alias("value")
    )


# --- linear models ---------------------------------------------------------------------------


def _labelled_counts(spark, sf):
    split_rows, _ = prepare_labels(quality_labels(spark, sf))
    labels = split_rows.select("uid", "split", F.col("label").cast("int").alias("label"))
    # The join comes first: only labelled documents are counted.
    return keyword_counts(single_posts(spark, sf).join(labels, "uid"), KEYWORDS)


def _proven(rows, features="input_ids", **options):
    """What shows that a baseline is fitted, per split.

    The gradient is that of the only optimum, the loss is below that of the class shares, the mean probability of
    the last class is its share, and the accuracy is at least that of the largest class: exactly so in training, and
    less three standard errors elsewhere, as held-out rows owe a model nothing. No constant model passes.
    """
    result, proof = M.certified_baseline(rows, features, max_iter=120, tolerance=1e-9, **options)
    error = F.sqrt(F.col("majority") * (1 - F.col("majority")) / F.col("n_rows"))
    least = F.col("majority") - F.when(F.col("split") == "train", 0.0).otherwise(3 * error)
    return result.select(
        "split", "n_rows", F.round("majority", 6).alias("majority"), F.lit(round(proof.prior_loss, 6)).alias("prior_loss"),
        F.lit(round(proof.mean_probabilities[-1], 4)).alias("last_share"), F.lit(proof.gradient_norm < 1e-3).alias("optimal"),
        F.lit(proof.loss < proof.prior_loss).alias("beats_prior"), (F.col("accuracy") >= least).alias("holds"),
    )


def _proof_sql(rows: str) -> str:
    """Facts of `(split, label)` rows that a fitted model has to meet."""
    return f"""
classes AS (SELECT split, label, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY split) AS share FROM ({rows}) GROUP BY split, label),
trained AS (SELECT -sum(share * ln(share)) AS loss, arg_max(share, label) AS last FROM classes WHERE split = 'train')
SELECT split, sum(n)::BIGINT AS n_rows, round(max(share), 6) AS majority, round(any_value(loss), 6) AS prior_loss,
       round(any_value(last), 4) AS last_share, true AS optimal, true AS beats_prior, true AS holds
FROM classes, trained GROUP BY split
"""


BASELINE_SQL = f"""
WITH {_split_sql(QUALITY_LABELS_SQL)}, {_proof_sql("SELECT split, label FROM split_rows JOIN documents ON uid = doc_id::VARCHAR")}
"""


@query(BASELINE_SQL)
def lr_baseline(spark, sf):
    return _proven(_labelled_counts(spark, sf))


@query(BASELINE_SQL)
def softmax_baseline(spark, sf):
    return _proven(_labelled_counts(spark, sf), family="multinomial", reg_param=1e-3)


def _probe_rows(spark, sf):
    rows = embedded(spark, sf)
    bucket = hash_int(string("row_idx")) % 5
    split = F.when(bucket == 0, "test").when(bucket == 1, "validation").otherwise("train")
    return rows.withColumn("split", split)


PROBE_SQL = """
probe AS (
  SELECT *, CASE ('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split
  FROM embeddings
)
"""


@query(f"WITH {PROBE_SQL}, {_proof_sql('SELECT split, label FROM probe')}")
def linear_probe(spark, sf):
    return _proven(_probe_rows(spark, sf), "embedding", family="multinomial", reg_param=1e-5)


@query(f"""
WITH {PROBE_SQL},
dims AS (SELECT vec_id, label, split, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM probe),
means AS (SELECT label AS class, d, avg(x) AS m FROM dims WHERE split = 'train' GROUP BY 1, 2),
scores AS (SELECT vec_id, label, class, sum(x * m) - sum(m * m) / 2 AS s FROM dims JOIN means USING (d) WHERE split = 'test' GROUP BY 1, 2, 3),
chosen AS (SELECT vec_id, label, class, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, class) AS r FROM scores),
votes AS (
  SELECT label::VARCHAR AS uid, class AS prediction, count(*) AS n_votes, max(vec_id // 128) AS newest,
         arg_min(vec_id % 128, row(-(vec_id // 128), vec_id % 128)) AS place
  FROM chosen WHERE r = 1 GROUP BY 1, 2
)
SELECT uid, prediction, n_votes FROM (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n_votes DESC, newest DESC, place) AS r FROM votes
) WHERE r = 1
""")
def predict_users_job(spark, sf):
    """Votes of the users of the test split by a linear model that SQL can fit, too: the nearest class mean."""
    rows = _probe_rows(spark, sf)
    model = class_mean_model(rows.filter(F.col("split") == "train"), "embedding", "label", 10)
    return M.user_predictions(model, rows.filter(F.col("split") == "test"), "embedding")


@query(f"""
WITH {_split_sql(QUALITY_LABELS_SQL)},
folds AS (SELECT *, 'f' || (row_idx % 6) AS own FROM mapped WHERE row_idx % 3 = 0),
named AS (SELECT unnest(['f0', 'f3']) AS fold),
members AS (
  SELECT fold, CASE WHEN own = fold THEN 'test' WHEN own IS NOT NULL THEN 'validation' ELSE 'train' END AS split, m.uid, m.label_id AS label
  FROM mapped m JOIN documents ON m.uid = doc_id::VARCHAR CROSS JOIN named LEFT JOIN folds f ON f.uid = m.uid
),
trained AS (SELECT fold, count(*) AS n_train, avg(label) AS share FROM members WHERE split = 'train' GROUP BY fold)
SELECT fold, split, uid, label, n_train, round(-(share * ln(share) + (1 - share) * ln(1 - share)), 6) AS prior_loss,
       round(share, 4) AS last_share, true AS optimal, true AS beats_prior, true AS plausible
FROM members JOIN trained USING (fold)
""")
def baseline_fold_predictions(spark, sf):
    """For both folds every user's split and label, and what shows that the fold's model is fitted."""
    rows = quality_labels(spark, sf)
    true = rows.filter(F.col("row_idx") % 3 == 0)
    folds = true.select(F.concat(F.lit("f"), (F.col("row_idx") % 6).cast("string")).alias("fold"), F.col("row_idx").alias("pos"), "uid")
    names = ["f0", "f3"]
    found, proofs = baseline_by_fold(single_posts(spark, sf), rows, true, folds, names, KEYWORDS)
    facts = [
        (name, p.n_rows, round(p.prior_loss, 6), round(p.mean_probabilities[-1], 4), p.gradient_norm < 1e-3, p.loss < p.prior_loss)
        for name, p in zip(names, proofs)
    ]
    proven = spark.createDataFrame(
        facts, "fold string, n_train long, prior_loss double, last_share double, optimal boolean, beats_prior boolean"
    )
    checked = found.withColumn("plausible", F.col("prediction").between(0, 1)).drop("prediction")
    return checked.join(F.broadcast(proven), "fold")  # a row per fold


@query(f"""
WITH bags_of AS (
  WITH {BAG_SQL} SELECT doc_id AS row_idx, source AS uid, -1 AS label, e FROM vecs
),
{batch_sql("SELECT * FROM bags_of")}, {top_sql(False)}, {hinges_sql(100.0, cosine=False)}
SELECT count(*) AS n_triplets, round(avg(h), 4) AS loss, round(avg(h) - 100.0::DOUBLE, 4) + 0.0 AS net_loss FROM hinges
""")
def mining_job(spark, sf):
    posts = document_posts(spark, sf).withColumn("label", F.lit(-1))
    loss = mine_triplets(posts, MiningConfig())[1]
    return loss.select("n_triplets", F.round("loss", 4).alias("loss"), (F.round("net_loss", 4) + F.lit(0.0)).alias("net_loss"))
