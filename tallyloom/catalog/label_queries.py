"""Label files: filters, joins, ids, splits, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalog.bindings import (
    CUSTOMER_LABELS_SQL,
    LABEL_ROWS_SQL,
    TRUE_ROWS_SQL,
    customer_labels,
    label_rows,
    order_folds,
    string,
    table,
    true_label_rows,
)
from tallyloom.catalog.registry import query
from tallyloom.config import LabelConfig
from tallyloom.operators import labels as L
from tallyloom.operators.rowindex import row_index
from tallyloom.plans.jobs import prepare_labels, report_labels, selected_test_split

DICTIONARY_SQL = f"""
label_rows AS ({LABEL_ROWS_SQL}),
kept AS (SELECT * FROM label_rows WHERE label <> ''),
firsts AS (SELECT label, min(row_idx) AS f FROM kept GROUP BY label),
dict AS (SELECT label AS label_text, (row_number() OVER (ORDER BY f) - 1)::INT AS label_id FROM firsts),
mapped AS (
  SELECT k.row_idx, d.label_id::VARCHAR AS label, k.screen_name, k.uid FROM kept k JOIN dict d ON k.label = d.label_text
)
"""

TRUE_DICTIONARY_SQL = f"""
{DICTIONARY_SQL},
true_rows AS ({TRUE_ROWS_SQL}),
true_firsts AS (
  SELECT label, min(row_idx) AS f FROM true_rows WHERE label NOT IN (SELECT label_text FROM dict) GROUP BY label
),
full_dict AS (
  SELECT * FROM dict UNION ALL
  SELECT label, (row_number() OVER (ORDER BY f) - 1 + (SELECT max(label_id) + 1 FROM dict))::INT FROM true_firsts
),
true_mapped AS (
  SELECT t.row_idx, d.label_id::VARCHAR AS label, t.screen_name, t.uid
  FROM true_rows t JOIN full_dict d ON t.label = d.label_text
)
"""


@query(f"SELECT * FROM ({LABEL_ROWS_SQL}) WHERE label <> ''")
def filter_nonempty_labels(spark, sf):
    return L.nonempty_labels(label_rows(spark, sf))


@query("""
SELECT o_custkey::VARCHAR AS uid, arg_max(o_orderpriority, o_orderkey) AS label FROM orders GROUP BY 1
""")
def labels_last_wins(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_idx"), string("o_custkey").alias("uid"), F.col("o_orderpriority").alias("label")
    )
    return L.labels_last_wins(rows)


@query("""
SELECT c_custkey::BIGINT AS row_idx, c_mktsegment AS label, c_custkey::VARCHAR AS uid FROM customer
""")
def uid_from_label_line(spark, sf):
    lines = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("long").alias("row_idx"),
        F.concat(F.concat_ws(",", "c_mktsegment", "c_name", string("c_custkey")), F.lit("\n")).alias("line"),
    )
    return lines.select("row_idx", L.label_of_line(F.col("line")).alias("label"), L.uid_of_line(F.col("line")).alias("uid"))


@query(f"SELECT * FROM ({LABEL_ROWS_SQL}) WHERE uid NOT IN (SELECT uid FROM ({TRUE_ROWS_SQL}))")
def exclude_users(spark, sf):
    return L.exclude_users(label_rows(spark, sf), true_label_rows(spark, sf))


@query("""
SELECT CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS true_label, c_name AS screen_name,
       c_custkey::VARCHAR AS user_id
FROM customer WHERE c_acctbal >= 0
""")
def merge_true_labels(spark, sf):
    return _merged(spark, sf)


def _merged(spark, sf):
    rows = table(spark, sf, "customer")
    names = rows.select(F.col("c_name").alias("screen_name"), string("c_custkey").alias("user_id"))
    true = rows.select(
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("true_label"), F.col("c_name").alias("screen_name")
    )
    return L.merge_true_labels(names, true)


@query("SELECT c_mktsegment AS true_label, count(*) AS n FROM customer WHERE c_acctbal >= 0 GROUP BY 1")
def true_label_counts(spark, sf):
    return L.true_label_counts(_merged(spark, sf))


@query(f"WITH {DICTIONARY_SQL} SELECT * FROM mapped")
def assign_label_ids(spark, sf):
    rows = label_rows(spark, sf)
    return L.assign_label_ids(rows, L.label_dictionary(rows))


@query(f"""
WITH RECURSIVE label_rows AS ({LABEL_ROWS_SQL}),
kept AS (SELECT *, lag(label) OVER (ORDER BY row_idx) AS prev FROM label_rows WHERE label <> ''),
links AS (SELECT label, arg_min(coalesce(prev, ''), row_idx) AS up FROM kept GROUP BY label),
ids AS (
  SELECT label, 0 AS label_id FROM links WHERE up = ''
  UNION ALL
  SELECT l.label, i.label_id + 1 FROM links l JOIN ids i ON l.up = i.label
)
SELECT k.row_idx, i.label_id::VARCHAR AS label, k.screen_name, k.uid FROM kept k JOIN ids i ON k.label = i.label
""")
def assign_label_ids_compat(spark, sf):
    rows = label_rows(spark, sf)
    return L.assign_label_ids(rows, L.label_dictionary_compat(rows))


@query(f"WITH {DICTIONARY_SQL} SELECT count(*) AS n_classes FROM dict")
def num_classes(spark, sf):
    from tallyloom.operators.evaluation import num_classes as classes

    return classes(L.label_dictionary(label_rows(spark, sf)))


@query("""
SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_idx FROM orders
""")
def row_index_by_order(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return row_index(orders, "o_totalprice", "o_orderkey").drop("o_totalprice")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders", name="row_index")
def row_index_in_file(spark, sf):
    return row_index(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(f"""
SELECT row_idx, uid, row_number() OVER (ORDER BY md5('0|' || row_idx), row_idx) - 1 AS shuffled_idx
FROM ({LABEL_ROWS_SQL})
""")
def shuffle_labels(spark, sf):
    return L.shuffle_labels(label_rows(spark, sf)).select("row_idx", "uid", "shuffled_idx")


@query(f"""
SELECT row_idx, uid, CASE WHEN row_number() OVER (ORDER BY row_idx) > n - floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END
  AS split
FROM ({LABEL_ROWS_SQL}), (SELECT count(*) AS n FROM customer)
""")
def split_labels(spark, sf):
    return L.split_labels(label_rows(spark, sf), 0.2).select("row_idx", "uid", "split")


THREE_WAY_SQL = """
sized AS (SELECT count(*) AS n, floor(count(*) * 0.2::DOUBLE)::BIGINT AS t FROM mapped),
cuts AS (SELECT n, t, floor((n - t) * (0.2::DOUBLE / (1 - 0.2::DOUBLE)))::BIGINT AS v FROM sized),
placed AS (SELECT *, row_number() OVER (ORDER BY md5('0|' || row_idx), row_idx) AS p FROM mapped),
split_rows AS (
  SELECT row_idx, label, screen_name, uid,
         CASE WHEN p > n - t THEN 'test' WHEN p > n - t - v THEN 'validation' ELSE 'train' END AS split
  FROM placed, cuts
)
"""


@query(f"WITH {DICTIONARY_SQL}, {THREE_WAY_SQL} SELECT * FROM split_rows")
def three_way_split(spark, sf):
    return prepare_labels(label_rows(spark, sf))[0]


@query(f"WITH {DICTIONARY_SQL}, {THREE_WAY_SQL} SELECT split, count(*) AS n FROM split_rows GROUP BY split")
def label_split_counts(spark, sf):
    return L.label_split_counts(prepare_labels(label_rows(spark, sf))[0])


def _true_split_sql(source: str, true: str, ratio: str = "0.2::DOUBLE") -> str:
    return f"""
others AS (SELECT * FROM {source} WHERE uid NOT IN (SELECT uid FROM {true})),
positions AS (SELECT *, row_number() OVER (ORDER BY row_idx) AS p, count(*) OVER () AS n FROM others),
split_rows AS (
  SELECT row_idx, label, screen_name, uid, CASE WHEN p > n - floor(n * {ratio}) THEN 'validation' ELSE 'train' END AS split
  FROM positions
  UNION ALL SELECT row_idx, label, screen_name, uid, 'test' FROM {true}
)
"""


@query(f"""
WITH label_rows AS ({LABEL_ROWS_SQL}), true_rows AS ({TRUE_ROWS_SQL}), {_true_split_sql("label_rows", "true_rows")}
SELECT * FROM split_rows
""")
def true_label_split(spark, sf):
    return L.true_label_split(label_rows(spark, sf), true_label_rows(spark, sf), 0.2)


@query(f"WITH {TRUE_DICTIONARY_SQL}, {_true_split_sql('mapped', 'true_mapped')} SELECT * FROM split_rows")
def label_split_true_test(spark, sf):
    return prepare_labels(label_rows(spark, sf), LabelConfig(), true_label_rows(spark, sf))[0]


@query(f"""
WITH label_rows AS ({LABEL_ROWS_SQL}), true_rows AS ({TRUE_ROWS_SQL}),
fold_rows AS (SELECT * FROM true_rows WHERE label = 'NATION_3')
SELECT *, 'test' AS split FROM fold_rows
UNION ALL SELECT *, 'validation' FROM true_rows WHERE uid NOT IN (SELECT uid FROM fold_rows)
UNION ALL SELECT *, 'train' FROM label_rows WHERE uid NOT IN (SELECT uid FROM true_rows)
""")
def report_split(spark, sf):
    true = true_label_rows(spark, sf)
    folds = true.select(F.col("label").alias("fold"), F.col("row_idx").alias("pos"), "uid")
    chosen = L.slice_labels_by_fold(folds.filter(F.col("fold") == "NATION_3"), true)
    return L.report_split(label_rows(spark, sf), true, chosen.select(*true.columns))


@query(f"""
WITH {TRUE_DICTIONARY_SQL},
fold_rows AS (SELECT * FROM true_mapped WHERE uid IN (SELECT uid FROM true_rows WHERE label = 'NATION_3'))
SELECT *, 'test' AS split FROM fold_rows
UNION ALL SELECT *, 'validation' FROM true_mapped WHERE uid NOT IN (SELECT uid FROM fold_rows)
UNION ALL SELECT *, 'train' FROM mapped WHERE uid NOT IN (SELECT uid FROM true_mapped)
""")
def report_split_ids(spark, sf):
    true = true_label_rows(spark, sf)
    entries = true.filter(F.col("label") == "NATION_3").select(F.lit("f").alias("fold"), F.col("row_idx").alias("pos"), "uid")
    return report_labels(label_rows(spark, sf), true, entries)


@query(f"""
WITH {TRUE_DICTIONARY_SQL},
chosen AS (SELECT t.* FROM orders JOIN true_mapped t ON t.uid = o_custkey::VARCHAR WHERE o_orderpriority = '1-URGENT'),
{_true_split_sql('mapped', 'chosen')}
SELECT * FROM split_rows
""")
def selected_test_rows(spark, sf):
    """Users of a list of ids, repeats kept, as test split."""
    listed = order_folds(spark, sf).filter(F.col("fold") == "1-URGENT")
    return selected_test_split(label_rows(spark, sf), true_label_rows(spark, sf), listed)


@query(f"""
WITH {DICTIONARY_SQL}, {THREE_WAY_SQL}
SELECT * FROM split_rows WHERE split <> 'validation'
UNION ALL SELECT row_idx, label, screen_name, uid, 'validation' FROM ({TRUE_ROWS_SQL})
""")
def override_split_source(spark, sf):
    rows = prepare_labels(label_rows(spark, sf))[0]
    return L.override_split_source(rows, "validation", true_label_rows(spark, sf))


@query(f"""
WITH merged AS (
  SELECT uid, label, 0 AS p FROM ({CUSTOMER_LABELS_SQL})
  UNION ALL SELECT doc_id::VARCHAR, quality::INT, 1 FROM labels
  UNION ALL SELECT s_suppkey::VARCHAR, s_nationkey::INT, 2 FROM supplier
)
SELECT uid, arg_max(label, p) AS label FROM merged GROUP BY uid
""")
def label_precedence(spark, sf):
    quality = table(spark, sf, "labels").select(string("doc_id").alias("uid"), F.col("quality").cast("int").alias("label"))
    nation = table(spark, sf, "supplier").select(
        string("s_suppkey").alias("uid"), F.col("s_nationkey").cast("int").alias("label")
    )
    return L.label_precedence(customer_labels(spark, sf), quality, nation)


@query(f"""
SELECT o_orderpriority AS fold, o_orderkey AS pos, t.uid, t.row_idx, t.label, t.screen_name
FROM orders o JOIN ({TRUE_ROWS_SQL}) t ON t.uid = o.o_custkey::VARCHAR
""")
def slice_labels_by_fold(spark, sf):
    return L.slice_labels_by_fold(order_folds(spark, sf), true_label_rows(spark, sf))


@query("""
SELECT o_orderpriority AS fold, o_orderkey AS pos, o_custkey::VARCHAR AS uid
FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)
""")
def fold_uids_without_label(spark, sf):
    return L.fold_uids_without_label(order_folds(spark, sf), true_label_rows(spark, sf))
