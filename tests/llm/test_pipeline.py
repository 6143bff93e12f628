import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tallyloom.llm.common import tidy
from tallyloom.llm.html_extraction import main_text


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    counts = []
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, sf))
        assert docs.columns == columns
        left = {r[0] for r in docs.select("doc_id").collect()}
        assert left <= ids and left
        ids = left
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r[0] for r in last.select("doc_id").distinct().collect()} == ids
    whole = corpus_pipeline.run(spark, sf)
    assert whole.columns == last.columns and sorted(map(str, whole.collect())) == sorted(map(str, last.collect()))


def test_the_queries_are_registered(spark, sf):
    names = set(contract.queries())
    assert {"pipeline"} <= names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    pages = duckdb.sql(f"SELECT page_id, html FROM read_parquet('{sf}/pages.parquet')").fetchall()
    got = {r["page_id"]: r["text"] for r in contract.queries()["op10_html"](spark, sf).collect()}
    assert got == {k: main_text(h) for k, h in pages}


@pytest.mark.skipif(not os.path.exists("/proc/self/statm"), reason="reads the memory of the process from /proc")
def test_tasks_give_memory_back():
    def resident():
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    pins, high = [], []

    def run(batches):
        for batch in batches:
            parts = [np.ones(12_000) for _ in range(2_000)]
            pins.append(parts[-1])  # what lies last keeps the heap from shrinking by itself
            high.append(resident())
            del parts
            yield batch

    before = resident()
    assert len(list(tidy(run)(iter([pa.RecordBatch.from_pydict({"x": [1]})])))) == 1
    assert high[0] - before > 100e6 and resident() - before < 0.3 * (high[0] - before)
