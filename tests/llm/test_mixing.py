import numpy as np
import pytest

from tallyloom.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, limit=2):
    """Targets by sharing the excess again until none is above its limit."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), {s for s in names if sizes[s]}, dict.fromkeys(names, 0.0)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > limit * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = float(limit * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def corpus(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for n, source in enumerate(["a", "b", "Z", "é", None, "one", "none"]):
        for i in range({"one": 1, "none": 2}.get(source, 60)):
            words = 0 if source == "none" else int(rng.lognormal(3, 1))
            rows.append((1000 * n + i, " ".join(["w"] * words), source))
    rows += [(None, "a b c", "a"), (77, None, "b"), (1, rows[1][1], "a"), (1, rows[1][1], "a"), (78, "x y z", "a")]
    return rows


def test_targets_and_copies(documents):
    rows = corpus()
    got = mixing.balance(documents(rows), group_rows=1_000).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    want = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["taken"]
    for source, words in sizes.items():
        if source != "one" and words:
            assert abs(taken[source] - want[source]) <= 0.01 * want[source] + 3
    again = mixing.balance(documents(list(reversed(rows))), group_rows=1_000).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_tilts_solve_the_dual(spark):
    sizes = spark.createDataFrame([("a", s, 1) for s in (1, 5, 9, 30, 200)] + [("b", s, 3) for s in (2, 4, 60)], "source string, size long, docs long")
    targets = spark.createDataFrame([("a", 5, 245, 400.0), ("b", 9, 198, 50.0)], "source string, docs long, source_size long, target double")
    for r in mixing.solve_tilts(sizes, targets).collect():
        docs = {"a": [(s, 1) for s in (1, 5, 9, 30, 200)], "b": [(s, 3) for s in (2, 4, 60)]}[r["source"]]
        total = sum(n * s * min(2.0, np.exp(r["tilt"] * s / r["scale"])) for s, n in docs)
        assert total == pytest.approx({"a": 400.0, "b": 50.0}[r["source"]], rel=2e-4)


def test_rounding_keeps_the_sum():
    rng = np.random.default_rng(0)
    size = np.sort(rng.integers(1, 900, 500))[::-1]
    rate = rng.uniform(0, 2, 500)
    copies = mixing.round_copies(size, rate, 2)
    assert abs((copies * size).sum() - (rate * size).sum()) <= size.min() / 2 and copies.max() <= 2


def test_mix_repeats_rows(documents):
    rows = corpus()
    table = documents(rows)
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    copies = {}
    for r in mixing.balance(table).collect():
        k = (r["doc_id"], r["source"], r["size"])
        copies[k] = copies.get(k, 0) + r["copies"]
    seen = {}
    for r in mixed.collect():
        k = (r["doc_id"], r["source"], len(r["text"].encode().split()) if r["text"] else 0)
        seen[k] = seen.get(k, 0) + 1
    assert seen == {k: n for k, n in copies.items() if n}


def test_empty_table(documents):
    assert mixing.balance(documents([])).collect() == []
    assert mixing.mix(documents([])).collect() == []
    assert [r["taken"] for r in mixing.balance(documents([(1, None), (2, "")])).collect()] == [0, 0]
