"""Line dedup against a plain version, on both paths of the operator."""

from __future__ import annotations

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.config import LIMITS, SizeLimits
from tallyloom.llm.line_dedup import LINES_SQL, dedup_lines, keep_bitmaps, keep_lines

SMALL = SizeLimits(broadcast_rows=0, group_rows=3, literal_keys=0)


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, min_chars=20, min_docs=3):
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key_of(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            docs = holders[key_of(line)]
            keeper = max(docs, key=lambda d: (d is not None, d or 0))
            if len(key_of(line)) < min_chars or len(docs) < min_docs or doc == keeper:
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def made(n=90, seed=5):
    rng = random.Random(seed)
    shared = [f"  Shared LINE number {i} of everyone\t" for i in range(12)] + ["short", "", "É" * 20, "é" * 20, "x" * 19, "X" * 20, "x" * 20]
    rows = [(i, "\n".join(rng.choice(shared) if rng.random() < 0.7 else f"an own line {i} {j} of this text" for j in range(rng.randint(1, 12))))
            for i in range(n)]
    rows += [(i, "The line that nearly all have\n" * rng.randint(1, 3)) for i in range(n, 2 * n)]
    rows += [(None, None), (None, shared[0]), (500, ""), (501, "\n"), (502, shared[1] + "\r\n" + shared[1].upper()), (7, shared[2]), (7, shared[2])]
    rows += [(600, "\n".join([shared[3]] * 4000 + ["end"]))]
    return rows


@pytest.mark.parametrize("limits,slice_rows", [(LIMITS, 20_000), (LIMITS, 4), (SMALL, 4)])
def test_equals_plain_version(documents, limits, slice_rows):
    rows = made()
    got = dedup_lines(documents(rows).repartition(5), limits=limits, slice_rows=slice_rows).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_sql_equals_plain_version(documents):
    docs = documents(made()).select("doc_id", "text").toPandas()
    with duckdb.connect() as con:
        con.register("documents", docs)
        got = con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({LINES_SQL})").fetchall()
    assert sorted(got, key=str) == brute(made())


def test_all_columns_and_rows_stay(documents):
    rows = made(20)
    docs = documents(rows).withColumn("_row", F.lit("own")).withColumn("_lines", F.lit(1)).withColumn("cuts", F.lit(2))
    kept = keep_lines(docs, slice_rows=4)
    assert kept.columns == docs.columns + ["n_lines", "n_dropped"] and kept.count() == len(rows)
    assert kept.filter("_row != 'own' or _lines != 1 or cuts != 2").count() == 0


def test_bitmaps_are_runs(documents):
    line = "a line of enough characters"
    rows = [(1, f"{line}\n{line}\nmine\n{line}"), (2, line), (3, line)]
    got = {r["row"]["doc"]: (r["n_dropped"], [tuple(c) for c in r["cuts"]]) for r in keep_bitmaps(documents(rows)).collect()}
    assert got == {1: (3, [(0, 1), (3, 3)]), 2: (1, [(0, 0)])}


def test_empty_table(documents):
    empty = documents([(1, "x")]).filter("doc_id = 2")
    assert dedup_lines(empty).count() == 0


def test_windows_stream_over_ranges_without_another_shuffle(documents):
    from tallyloom.llm.line_dedup import _long_lines, _streamed

    plan = _streamed(_long_lines(documents(made(9)), "doc_id", "text", 20), 3, LIMITS, 20_000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan and plan.count("Sort [") == 1
    assert "Python" not in plan and "Arrow" not in plan
