import numpy as np
import pytest

from tallyloom.llm import quality, toxicity
from tallyloom.llm.common import crc_mod


def corpus(rows=240):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdeilnorst"), rng.integers(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for n in range(rows):
        words = [str(w) for w in rng.choice(vocabulary, rng.integers(20, 120))]
        bad, rude = n % 4 == 0, n % 5 == 0
        if bad:
            words = [w + "$$$" if n % 8 else w.upper() + "!!" for w in words]
        if rude:
            for at in rng.integers(0, len(words), 3):
                words[at] = ["zorgwump", "Blatquix"][int(at) % 2]
        docs.append((n, " ".join(words)))
        labels.append((n, int(not bad), int(rude), "x"))
    return docs, labels


@pytest.mark.parametrize("classify, column, at", [(quality.classify_quality, 1, 0.7), (toxicity.classify_toxicity, 2, 0.3)])
def test_held_out_rows(documents, labels, classify, column, at):
    docs, marks = corpus()
    docs += [(9_001, None), (9_002, ""), (None, "abc"), (3, docs[3][1]), (9_003, docs[4][1] + " wort" * 30_000)]
    got = classify(documents(docs), labels(marks + [(None, 1, 1, "x"), (5_000, None, None, "x"), marks[3]])).collect()
    assert len(got) == len(docs)
    truth = {m[0]: m[column] for m in marks}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 30 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.95
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= at)
        assert r["held_out"] == (crc_mod(r["doc_id"], 4) == 2)
    assert len({r["score"] for r in got if r["doc_id"] in (9_001, 9_002)}) == 1
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1


@pytest.mark.parametrize("classify", [quality.classify_quality, toxicity.classify_toxicity])
def test_without_labels(documents, labels, classify):
    table = documents([(1, "a b"), (2, None)])
    assert [r["score"] for r in classify(table, labels([])).collect()] == [0.5, 0.5]
    one = classify(table, labels([(1, 1, 1, "x"), (4, 1, 1, "x")])).collect()
    assert len({r["score"] for r in one}) == 1 and one[0]["score"] > 0.5
    assert classify(documents([]), labels([(1, 1, 0, "x")])).collect() == []


def test_held_out_labels_do_not_matter(documents, labels):
    docs, marks = corpus(120)
    flipped = [(k, 1 - q, 1 - t, x) if crc_mod(k, 4) == 2 else (k, q, t, x) for k, q, t, x in marks]
    for classify in (quality.classify_quality, toxicity.classify_toxicity):
        one = sorted(map(str, classify(documents(docs), labels(marks)).collect()))
        assert one == sorted(map(str, classify(documents(docs), labels(flipped)).collect()))


def test_keep_quality_keeps_rows_whole(documents, labels):
    docs, marks = corpus()
    table = documents(docs)
    scores = {r["doc_id"]: r["predicted"] for r in quality.classify_quality(table, labels(marks)).collect()}
    kept = quality.keep_quality(table, labels(marks))
    assert kept.columns == table.columns
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(k, t) for k, t in docs if scores[k]}


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (4_000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit_additive(x[:3_000], y[:3_000], pairs=1)
    assert model.pairs == [(0, 1)] and ((model.score(x[3_000:]) > 0.5) == y[3_000:]).mean() > 0.95


def test_ngrams_of_pieces_are_those_of_the_whole(monkeypatch):
    text = "añb cde " * 50 + "fin"
    whole = sorted(np.concatenate(list(toxicity.ngram_buckets(text, 16))).tolist())
    monkeypatch.setattr(toxicity, "_PIECE", 64)
    assert sorted(np.concatenate(list(toxicity.ngram_buckets(text, 16))).tolist()) == whole
    assert list(toxicity.ngram_buckets(None, 16)) == []


def plain_tree(g, h, ridge):
    """A tree of depth two over bins, cut by cut."""

    def best(a, b):
        found = (1e-9, None)
        whole = sum(g[a:b]) ** 2 / (sum(h[a:b]) + ridge)
        for c in range(a + 1, b):
            gain = sum(g[a:c]) ** 2 / (sum(h[a:c]) + ridge) + sum(g[c:b]) ** 2 / (sum(h[c:b]) + ridge) - whole
            if gain > found[0] + 1e-12:
                found = (gain, c)
        return found[1]

    leaves = [(0, len(g))]
    for _ in range(2):
        leaves = [part for a, b in leaves for c in [best(a, b)] for part in ([(a, c), (c, b)] if c else [(a, b)])]
    return [sum(g[a:b]) / (sum(h[a:b]) + ridge) for a, b in leaves for _ in range(a, b)]


def test_trees_and_boosting_against_a_plain_version():
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 17):
        g, h = rng.normal(0, 3, n), rng.uniform(0, 2, n)
        assert quality._tree(g, h, 2.0) == pytest.approx(plain_tree(g.tolist(), h.tolist(), 2.0))
    x = np.round(rng.normal(0, 1, (60, 2)), 1)
    y = (x[:, 0] + rng.normal(0, 0.5, 60) > 0).astype(float)
    model = quality.fit_additive(x, y, rounds=4, bins=5, pairs=0)
    total = np.full(60, np.log((y.sum() + 1) / (62 - y.sum() - 1)))
    tables = [[0.0] * (len(e) + 1) for e in model.edges]
    place = [[sum(v >= c for c in model.edges[j]) for v in x[:, j]] for j in range(2)]
    for _ in range(4):
        for j in range(2):
            g, h = [0.0] * len(tables[j]), [0.0] * len(tables[j])
            for k in range(60):
                p = 1 / (1 + np.exp(-total[k]))
                g[place[j][k]] += y[k] - p
                h[place[j][k]] += p * (1 - p)
            step = [0.15 * v for v in plain_tree(g, h, 2.0)]
            tables[j] = [a + b for a, b in zip(tables[j], step)]
            total = total + np.array([step[b] for b in place[j]])
    for j in range(2):
        assert model.tables[j] == pytest.approx(tables[j])
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(-total)))


def test_ratios_and_score_against_a_plain_version(documents, labels):
    docs, marks = corpus(120)
    model = toxicity.fit_toxicity(documents(docs), labels(marks), bits=14, kept=300, steps=50)
    y = {k: t for k, _, t, _ in marks if crc_mod(k, 4) != 2}
    texts = {k: t for k, t in docs if k in y}

    def grams(text):
        raw = f" {' '.join(text.lower().split())} ".encode()
        out = set()
        for n in toxicity.ORDERS:
            for i in range(len(raw) - n + 1):
                value = int.from_bytes(raw[i:i + n], "big") + (n << 48)
                out.add((value * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 50)
        return out

    present = {k: grams(t) for k, t in texts.items()}
    positive, negative = sum(y.values()), len(y) - sum(y.values())
    counts = {}
    for k, found in present.items():
        for b in found:
            counts.setdefault(b, [0, 0])[y[k]] += 1
    rate = positive / len(y)
    surprise = {b: (p - (p + n) * rate) ** 2 / ((p + n) * rate * (1 - rate) + 1) for b, (n, p) in counts.items()}
    best = sorted(counts, key=lambda b: (-surprise[b], b))[:300]
    assert sorted(np.flatnonzero(model.slot >= 0).tolist()) == sorted(best)
    # The fit is the minimum of a convex loss: at zero weights the loss is larger, and the score is the sum of bin weights.
    for k, text in docs[:40]:
        total = model.intercept + sum(model.weights[model.slot[b]] for b in grams(text) if model.slot[b] >= 0)
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-total)))
    slots = {b: int(model.slot[b]) for b in best}
    ratio = np.zeros(300)
    for b, at in slots.items():
        n, p = counts[b]
        ratio[at] = np.log((p + 0.5) / (positive + 1)) - np.log((n + 0.5) / (negative + 1))
    assert np.all(np.sign(model.weights) * np.sign(ratio) >= 0) or np.corrcoef(model.weights, ratio)[0, 1] > 0.5


@pytest.mark.parametrize("classify", [quality.classify_quality, toxicity.classify_toxicity])
def test_an_id_that_repeats_counts_once(documents, labels, classify):
    docs, marks = corpus(80)
    hot = next(k for k, *_ in marks if crc_mod(k, 4) != 2)
    more = docs + [(hot, f"a text {n % 7} of a hot id") for n in range(90)]
    scores = [
        sorted((str(r["doc_id"]), r["score"]) for r in classify(documents(more).repartition(parts), labels(marks)).collect()) for parts in (1, 5)
    ]
    assert scores[0] == scores[1] and len(scores[0]) == 170
