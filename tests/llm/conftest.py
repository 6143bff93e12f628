import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # names that the operators use themselves
        *(T.StructField(c, T.StringType()) for c in ("id", "row", "fp", "score", "size", "component", "copies", "features", "y", "word")),
    ]
)


@pytest.fixture
def documents(spark):
    """A table of (doc_id, text[, source]) rows with further columns whose names clash with those of the operators."""

    def make(rows):
        full = [
            (r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1]), *["x"] * 10) for r in rows
        ]
        return spark.createDataFrame(full, DOCUMENT)

    return make


@pytest.fixture
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, score string")

    return make


@pytest.fixture
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, id string")

    return make


@pytest.fixture
def components():
    """Smallest reachable item of each item, by brute force."""

    def solve(items, edges):
        label = {i: i for i in items}
        changed = True
        while changed:
            changed = False
            for a, b in edges:
                low = min(label[a], label[b])
                if label[a] != low or label[b] != low:
                    label[a] = label[b] = low
                    changed = True
        return label

    return solve
