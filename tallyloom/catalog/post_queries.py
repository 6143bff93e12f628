"""Posts: shards, filters, splits, indexes, counts, concatenation, packing, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalog.bindings import (
    CUSTOMER_LABELS_SQL,
    KEYWORDS,
    LABEL_ROWS_SQL,
    SPARSE_SQL,
    customer_labels,
    document_posts,
    join_ints,
    label_rows,
    order_posts,
    single_posts,
    sparse_posts,
    string,
    table,
    turn_posts,
)
from tallyloom.catalog.label_queries import DICTIONARY_SQL, THREE_WAY_SQL
from tallyloom.catalog.registry import query
from tallyloom.config import SizeLimits, TextConfig
from tallyloom.functions import text as X
from tallyloom.operators import batching, packing, posts as P
from tallyloom.operators.keywords import keyword_counts as count_keywords, keyword_counts_of_parts, sparse_keyword_counts_by
from tallyloom.operators.rowindex import file_row_index, row_index
from tallyloom.operators.staging import stage
from tallyloom.plans.jobs import prepare_labels, user_split
from tallyloom.plans.tokenize import tokenize

# Whitespace as the engine splits it: the ASCII class, vertical tab, the four ASCII separators, next
# line and the Unicode separators.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{SPACE}'), lambda w: w <> '')"


def counts_sql(words: str, cap: int | None = None) -> str:
    """Comma-joined keyword counts of a word list."""
    parts = []
    for keyword in KEYWORDS:
        n = f"len(list_filter({words}, lambda w: w = '{keyword}'))"
        parts.append(f"(least({cap}, {n}))::VARCHAR" if cap is not None else f"({n})::VARCHAR")
    return "concat_ws(',', " + ", ".join(parts) + ")"


@query("""
SELECT o_orderkey, row_idx FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders
) WHERE row_idx % 4 = 3
""")
def strided_shard(spark, sf):
    indexed = file_row_index(spark, f"{sf}/orders.parquet").select("o_orderkey", "row_idx")
    return P.strided_shard(indexed, 4)


@query("SELECT doc_id AS row_idx, source AS uid, doc_id::VARCHAR AS tid, text FROM documents ORDER BY doc_id LIMIT 302")
def head_sample(spark, sf):
    return P.head_sample(document_posts(spark, sf).drop("n_chars"), 302)


@query("""
SELECT d.doc_id AS row_idx, d.doc_id::VARCHAR AS uid, d.doc_id::VARCHAR AS tid, d.text
FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels)
""")
def filter_posts_by_uid(spark, sf):
    return P.filter_posts_by_uid(single_posts(spark, sf), table(spark, sf, "labels").select(string("doc_id").alias("uid")))


@query(f"SELECT row_idx, uid, tid, coalesce(text, ' ') AS text FROM ({SPARSE_SQL})")
def null_text_fill(spark, sf):
    return sparse_posts(spark, sf).select("row_idx", "uid", "tid", X.null_text_fill(F.col("text")).alias("text"))


ORDER_POSTS_SQL = """
SELECT o_orderkey AS row_idx, o_custkey::VARCHAR AS uid, o_orderkey::VARCHAR AS tid, o_orderpriority AS text FROM orders
"""


@query(f"""
WITH {DICTIONARY_SQL}, {THREE_WAY_SQL}, posts AS ({ORDER_POSTS_SQL})
SELECT s.split, p.row_idx, p.uid, p.tid, p.text FROM posts p JOIN (SELECT DISTINCT uid, split FROM split_rows) s USING (uid)
""")
def split_posts_by_uid(spark, sf):
    return P.split_posts_by_uid(order_posts(spark, sf), _split(spark, sf))


def _split(spark, sf):
    return user_split(prepare_labels(label_rows(spark, sf))[0])


@query("""
SELECT d.doc_id AS row_idx, d.doc_id::VARCHAR AS uid, d.doc_id::VARCHAR AS tid, d.text, coalesce(l.quality, -1)::INT AS label
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def label_posts(spark, sf):
    marks = table(spark, sf, "labels").select(string("doc_id").alias("uid"), F.col("quality").alias("label"))
    return P.label_posts(single_posts(spark, sf), marks)


@query(f"""
SELECT p.row_idx, p.uid, p.tid, p.text, l.label FROM ({ORDER_POSTS_SQL}) p JOIN ({CUSTOMER_LABELS_SQL}) l USING (uid)
""")
def label_posts_required(spark, sf):
    return P.label_posts(order_posts(spark, sf), customer_labels(spark, sf), require_labels=True)


@query("""
SELECT o_custkey::VARCHAR AS uid, 0::BIGINT AS part, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS row_idxs
FROM orders GROUP BY 1
""")
def uid_lookup(spark, sf):
    parts = P.uid_lookup(order_posts(spark, sf)).select("uid", "part", join_ints(F.col("row_idxs")).alias("row_idxs"))
    return P.join_parts(parts, "row_idxs", ",")


@query("""
SELECT uid, part, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS row_idxs FROM (
  SELECT o_custkey::VARCHAR AS uid, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 3 AS part
  FROM orders
) GROUP BY uid, part
""")
def uid_lookup_parts(spark, sf):
    """The same index on rows of at most three posts."""
    return P.uid_lookup(order_posts(spark, sf), part_rows=3).select("uid", "part", join_ints(F.col("row_idxs")).alias("row_idxs"))


@query("SELECT o_custkey::VARCHAR AS uid, count(*) AS n_posts FROM orders GROUP BY 1")
def posts_per_user(spark, sf):
    return P.posts_per_user(order_posts(spark, sf))


@query("""
SELECT uid, count(*) AS n_posts FROM (
  SELECT o_custkey::VARCHAR AS uid FROM orders
  UNION ALL SELECT user_id::VARCHAR FROM events UNION ALL SELECT conv_id::VARCHAR FROM conversations
) GROUP BY uid
""")
def posts_per_user_all_splits(spark, sf):
    events = table(spark, sf, "events").select(string("user_id").alias("uid"))
    return P.posts_per_user_all_splits(order_posts(spark, sf), events, turn_posts(spark, sf))


@query("SELECT o_orderpriority AS split, count(DISTINCT o_custkey) AS n_users FROM orders GROUP BY 1")
def unique_users_per_split(spark, sf):
    return P.unique_users_per_split(order_posts(spark, sf).withColumnRenamed("text", "split"))


@query("SELECT DISTINCT o_custkey::VARCHAR AS uid FROM orders")
def distinct_users(spark, sf):
    return P.distinct_users(order_posts(spark, sf))


@query("""
SELECT doc_id::VARCHAR AS tid, source AS uid, text FROM documents
UNION ALL SELECT conv_id || '-' || turn, conv_id::VARCHAR, text FROM conversations
""")
def union_splits(spark, sf):
    documents = document_posts(spark, sf).select("tid", "uid", "text")
    return P.union_splits(documents, turn_posts(spark, sf).select("tid", "uid", "text"))


@query(f"""
SELECT uid, 0::BIGINT AS part, arg_min(tid, row_idx) AS tid,
       coalesce(string_agg(text || chr(10), '' ORDER BY row_idx) FILTER (WHERE text <> ''), '') AS text
FROM ({SPARSE_SQL}) GROUP BY uid
""")
def concat_by_uid(spark, sf):
    return P.join_parts(P.concat_by_uid(sparse_posts(spark, sf)), "text")


@query(f"""
WITH placed AS (
  SELECT *, (row_number() OVER (PARTITION BY uid ORDER BY row_idx) - 1) // 7 AS part,
         first_value(tid) OVER (PARTITION BY uid ORDER BY row_idx) AS first_tid
  FROM ({SPARSE_SQL})
)
SELECT uid, part, any_value(first_tid) AS tid,
       coalesce(string_agg(text || chr(10), '' ORDER BY row_idx) FILTER (WHERE text <> ''), '') AS text
FROM placed GROUP BY uid, part
""")
def concat_by_uid_parts(spark, sf):
    """The same texts on rows of at most seven posts."""
    return P.concat_by_uid(sparse_posts(spark, sf), part_rows=7)


@query("""
SELECT doc_id, text || (CASE source WHEN 'src0' THEN ' ' WHEN 'src1' THEN chr(10) WHEN 'src2' THEN '</s></s>' ELSE '' END)
  AS text
FROM documents
""")
def concat_delimiters(spark, sf):
    name = (
        F.when(F.col("source") == "src0", "space")
        .when(F.col("source") == "src1", "newline")
        .when(F.col("source") == "src2", "sep")
        .otherwise("none")
    )
    return table(spark, sf, "documents").select(
        "doc_id", F.concat("text", X.delimiter_column(name)).alias("text")
    )


@query(f"SELECT doc_id, {counts_sql('w')} AS counts, {len(KEYWORDS)} AS n_mask FROM "
       f"(SELECT doc_id, {words_sql('text')} AS w FROM documents)")
def keyword_counts(spark, sf):
    counted = count_keywords(table(spark, sf, "documents").select("doc_id", "text"), KEYWORDS)
    return counted.select(
        "doc_id", join_ints(F.col("input_ids")).alias("counts"),
        F.aggregate("attention_mask", F.lit(0), lambda a, v: a + v).alias("n_mask"),
    )


@query(f"SELECT doc_id, {counts_sql('w', 1)} AS counts FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)")
def keyword_counts_capped(spark, sf):
    counted = count_keywords(table(spark, sf, "documents").select("doc_id", "text"), KEYWORDS, cap=1)
    return counted.select("doc_id", join_ints(F.col("input_ids")).alias("counts"))


@query(f"""
WITH asked AS (
  SELECT word, row_number() OVER (ORDER BY word) - 1 AS place
  FROM (SELECT DISTINCT unnest({words_sql('text')}) AS word FROM benchmark)
),
hits AS (
  SELECT source AS uid, place, least(count(*), 50) AS n
  FROM (SELECT source, unnest({words_sql('text')}) AS word FROM documents) JOIN asked USING (word) GROUP BY source, place
)
SELECT uid, string_agg(place::VARCHAR, ',' ORDER BY place) AS indices, string_agg(n::VARCHAR, ',' ORDER BY place) AS counts FROM hits GROUP BY uid
""")
def keyword_counts_sparse(spark, sf):
    """Counts per source of every word of the benchmark: a keyword list that is a table, up to 50 of each."""
    distinct = table(spark, sf, "benchmark").select(F.explode(X.words(F.col("text"))).alias("keyword")).distinct()
    asked = row_index(distinct, "keyword", name="at").select("keyword", F.array(F.col("at").cast("int")).alias("positions"))
    found = sparse_keyword_counts_by(document_posts(spark, sf), ["uid"], stage(asked), cap=50).filter(F.size("indices") > 0)
    return found.select("uid", join_ints(F.col("indices")).alias("indices"), join_ints(F.col("counts")).alias("counts"))


@query(f"""
WITH joined AS (
  SELECT source AS uid, arg_min(doc_id::VARCHAR, doc_id) AS tid,
         string_agg(text || '</s></s>', '' ORDER BY doc_id) FILTER (text <> '') AS text
  FROM documents GROUP BY source
)
SELECT uid, tid, {counts_sql('w')} AS counts FROM (SELECT uid, tid, {words_sql("coalesce(text, '')")} AS w FROM joined)
""")
def keyword_counts_glued(spark, sf):
    """A delimiter that glues words: parts of three texts are combined four by four, in as many levels as it takes."""
    parts = P.concat_by_uid(document_posts(spark, sf), "sep", part_rows=3)
    counted = keyword_counts_of_parts(parts, KEYWORDS, run=4)
    return counted.select("uid", "tid", join_ints(F.col("input_ids")).alias("counts"))


@query(f"SELECT conv_id, turn, (len({words_sql('text')}) + 2)::INT AS n_tokens FROM conversations")
def token_lengths(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", X.token_length(F.col("text")).alias("n_tokens")
    )


def ids_sql(words: str, size: int = 128, vocab: int = 32768) -> str:
    return (
        f"list_transform({words}[1:{size}], lambda w: 1 + ('0x' || substr(md5(w), 1, 8))::BIGINT % {vocab - 1})"
    )


def padded_sql(ids: str, size: int = 128) -> str:
    return f"array_to_string(list_concat({ids}, list_transform(range({size} - len({ids})), lambda i: 0)), ',')"


@query(f"""
SELECT row_idx, uid, {padded_sql('ids')} AS input_ids, len(ids)::INT AS n_mask
FROM (SELECT row_idx, uid, {ids_sql('w')} AS ids FROM
       (SELECT row_idx, uid, {words_sql("coalesce(text, ' ')")} AS w FROM ({SPARSE_SQL})))
""")
def tokenize_pad(spark, sf):
    return tokenize(sparse_posts(spark, sf)).select(
        "row_idx", "uid", join_ints(F.col("input_ids")).alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, v: a + v).alias("n_mask"),
    )


# Packing as a recursion over the turns of a conversation.
def pack_sql(overflow: str, limit: int = 128) -> str:
    full = f"s.n + t.k + 2 >= {limit}" + (" AND s.n > 0" if overflow == "carry" else "")
    n = f"CASE WHEN {full} THEN {'t.k' if overflow == 'carry' else '0'} ELSE s.n + t.k END"
    buf = f"CASE WHEN {full} THEN {'t.piece' if overflow == 'carry' else repr('')} ELSE s.buf || t.piece END"
    return f"""
turns AS (
  SELECT conv_id::VARCHAR AS uid, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, text || chr(10) AS piece,
         len({words_sql('text')})::INT AS k
  FROM conversations WHERE text <> ''
),
users AS (SELECT conv_id::VARCHAR AS uid, conv_id || '-' || arg_min(turn, turn) AS tid FROM conversations GROUP BY conv_id),
states AS (
  SELECT uid, 0::BIGINT AS p, 0 AS n, 0::BIGINT AS chunk_idx, '' AS buf, NULL::VARCHAR AS closed FROM users
  UNION ALL
  SELECT s.uid, t.p, {n}, s.chunk_idx + CASE WHEN {full} THEN 1 ELSE 0 END, {buf}, CASE WHEN {full} THEN s.buf END
  FROM states s JOIN turns t ON t.uid = s.uid AND t.p = s.p + 1
),
chunks AS (
  SELECT uid, chunk_idx - 1 AS chunk_idx, closed AS text FROM states WHERE closed IS NOT NULL
  UNION ALL
  (SELECT uid, chunk_idx, buf FROM states QUALIFY row_number() OVER (PARTITION BY uid ORDER BY p DESC) = 1)
)
"""


@query(f"WITH RECURSIVE {pack_sql('carry')} SELECT uid, chunk_idx, tid, text FROM chunks JOIN users USING (uid)")
def pack_by_uid(spark, sf):
    return packing.pack_by_uid(turn_posts(spark, sf))


@query(f"WITH RECURSIVE {pack_sql('drop')} SELECT uid, chunk_idx, tid, text FROM chunks JOIN users USING (uid)")
def pack_by_uid_compat(spark, sf):
    return packing.pack_by_uid(turn_posts(spark, sf), TextConfig(), overflow="drop")


_SMALL = SizeLimits(group_rows=5)


@query(f"WITH RECURSIVE {pack_sql('carry')} SELECT uid, chunk_idx, tid, text FROM chunks JOIN users USING (uid)")
def pack_by_uid_parts(spark, sf):
    """The same chunks, with every user of more than five turns packed in parts of five."""
    return packing.pack_by_uid(turn_posts(spark, sf), limits=_SMALL)


@query(f"WITH RECURSIVE {pack_sql('drop')} SELECT uid, chunk_idx, tid, text FROM chunks JOIN users USING (uid)")
def pack_by_uid_compat_parts(spark, sf):
    return packing.pack_by_uid(turn_posts(spark, sf), TextConfig(), overflow="drop", limits=_SMALL)


_NARROW = SizeLimits(group_bytes=500)


@query(f"WITH RECURSIVE {pack_sql('carry')} SELECT uid, chunk_idx, tid, text FROM chunks JOIN users USING (uid)")
def pack_by_uid_bytes(spark, sf):
    """The same chunks, with every user of more than 500 bytes packed in parts of 500 bytes and one text."""
    return packing.pack_by_uid(turn_posts(spark, sf), limits=_NARROW)


@query(f"WITH RECURSIVE {pack_sql('drop')} SELECT uid, chunk_idx, tid, text FROM chunks JOIN users USING (uid)")
def pack_by_uid_compat_bytes(spark, sf):
    return packing.pack_by_uid(turn_posts(spark, sf), TextConfig(), overflow="drop", limits=_NARROW)


EXPORT_SQL = f"""
posts AS (
  SELECT d.doc_id AS row_idx, d.source AS uid, {counts_sql('w')} AS input_ids,
         CASE WHEN l.quality IS NULL THEN 'train' WHEN l.quality = 1 THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, {words_sql('text')} AS w FROM documents) d LEFT JOIN labels l USING (doc_id)
)
"""


@query(f"""
WITH {EXPORT_SQL}
SELECT uid, arg_max(input_ids, row(CASE split WHEN 'validation' THEN 0 ELSE 1 END, row_idx)) AS input_ids
FROM posts WHERE split IN ('validation', 'test') GROUP BY uid
""")
def export_last_by_uid(spark, sf):
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("row_idx"), "quality")
    split = F.when(F.col("quality").isNull(), "train").when(F.col("quality") == 1, "validation").otherwise("test")
    counted = count_keywords(document_posts(spark, sf).join(marks, "row_idx", "left"), KEYWORDS)
    rows = P.export_last_by_uid(counted.withColumn("split", split), ["validation", "test"])
    return rows.select("uid", join_ints(F.col("input_ids")).alias("input_ids"))


# --- batches ---------------------------------------------------------------------------------


@query("SELECT ceil(count(*) / 128)::BIGINT AS n_batches FROM orders")
def num_batches(spark, sf):
    return batching.num_batches(order_posts(spark, sf), 128)


@query("""
SELECT doc_id AS row_idx, source AS uid, doc_id::VARCHAR AS tid, doc_id // 128 AS batch_id, doc_id % 128 AS pos
FROM documents WHERE doc_id < (SELECT count(*) // 128 * 128 FROM documents)
""")
def batches_drop_last(spark, sf):
    rows = batching.with_info_defaults(document_posts(spark, sf).select("row_idx", "uid", "tid"))
    return batching.batches_drop_last(rows, 128)


@query("""
WITH n AS (SELECT count(*) AS n FROM documents)
SELECT doc_id AS row_idx, source AS uid, doc_id // 128 AS batch_id, doc_id % 128 AS pos FROM documents, n
WHERE doc_id < n // 128 * 128
UNION ALL SELECT doc_id, source, n // 128, doc_id - (n - 128) FROM documents, n WHERE doc_id >= n - 128
""")
def batches_with_leftovers(spark, sf):
    return batching.batches_with_leftovers(document_posts(spark, sf).select("row_idx", "uid"), 128)


@query("""
WITH n AS (SELECT count(*) AS n FROM documents),
perm AS (SELECT doc_id, source, row_number() OVER (ORDER BY md5('0|' || doc_id), doc_id) - 1 AS p FROM documents)
SELECT p.doc_id AS row_idx, p.source AS uid, coalesce(l.quality, -1)::INT AS label, p // 128 AS batch_id, p % 128 AS pos,
       1 AS loss_mask
FROM perm p LEFT JOIN labels l USING (doc_id)
UNION ALL
SELECT NULL, NULL, -1, n // 128, i, 0 FROM n, range(0, 128) r(i) WHERE n % 128 > 0 AND i >= n % 128
""")
def padded_batches(spark, sf):
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("row_idx"), F.col("quality").alias("label"))
    rows = document_posts(spark, sf).select("row_idx", "uid").join(marks, "row_idx", "left")
    rows = rows.withColumn("label", F.coalesce("label", F.lit(-1)).cast("int"))
    return batching.padded_batches(rows, 128, shuffle_seed=0)
