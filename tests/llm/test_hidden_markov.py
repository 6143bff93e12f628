import itertools
import math
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import hidden_markov as hm
from tallyloom.llm.common import crc_mod


def model_of(states, symbols, seed):
    rng = np.random.default_rng(seed)
    start, move, emit = rng.random(states), rng.random((states, states)), rng.random((symbols, states))
    return hm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def plain_likelihood(model, codes):
    total = 0.0
    for path in itertools.product(range(len(model.start)), repeat=len(codes)):
        p = model.start[path[0]] * model.emit[codes[0], path[0]]
        for t in range(1, len(codes)):
            p *= model.move[path[t - 1], path[t]] * model.emit[codes[t], path[t]]
        total += p
    return total


def test_forward_against_all_state_paths():
    model = model_of(3, 5, 1)
    texts = [[0], [1, 2, 0], [4, 4, 3, 2, 0], [3, 0]]
    codes = np.array([c for t in texts for c in t])
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    for rows in hm.batches_of(np.diff(offsets)):
        log = hm.forward(model, codes, offsets, rows)
        for r, value in zip(rows, log):
            assert value == pytest.approx(math.log(plain_likelihood(model, texts[r])))


def test_expected_counts_against_all_state_paths():
    model = model_of(2, 4, 2)
    texts = [[1, 2, 0], [3, 3, 1, 0], [0]]
    codes = np.array([c for t in texts for c in t])
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    emit, move, start = np.zeros((4, 2)), np.zeros((2, 2)), np.zeros(2)
    for rows in hm.batches_of(np.diff(offsets)):
        hm.expected_counts(model, codes, offsets, rows, emit, move, start)
    e, m, s = np.zeros((4, 2)), np.zeros((2, 2)), np.zeros(2)
    for text in texts:
        whole = plain_likelihood(model, text)
        for path in itertools.product(range(2), repeat=len(text)):
            p = model.start[path[0]] * model.emit[text[0], path[0]]
            for t in range(1, len(text)):
                p *= model.move[path[t - 1], path[t]] * model.emit[text[t], path[t]]
            s[path[0]] += p / whole
            for t, c in enumerate(text):
                e[c, path[t]] += p / whole
                if t:
                    m[path[t - 1], path[t]] += p / whole
    assert np.allclose(emit, e) and np.allclose(move, m) and np.allclose(start, s)


@pytest.mark.parametrize("tokens", [1, 7, 10_000])
def test_pieces_and_single_precision(monkeypatch, tokens):
    """Long texts in pieces give the same likelihoods; counts in single precision are those in double."""
    monkeypatch.setattr(hm, "_TOKENS", tokens)
    rng = np.random.default_rng(4)
    model = model_of(4, 30, 3)
    lengths = rng.integers(1, 400, 25)
    codes = rng.integers(0, 30, lengths.sum()).astype(np.int32)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    single = hm.Model(*(x.astype(np.float32) for x in (model.start, model.move, model.emit)))
    sums = [(np.zeros((30, 4)), np.zeros((4, 4)), np.zeros(4)) for _ in range(2)]
    seen = []
    for rows in hm.batches_of(lengths):
        seen += rows.tolist()
        for row, log in zip(rows, hm.forward(model, codes, offsets, rows)):
            state, expected = model.start, 0.0
            for t, c in enumerate(codes[offsets[row]:offsets[row + 1]]):
                state = (state if t == 0 else state @ model.move) * model.emit[c]
                expected += math.log(state.sum())
                state = state / state.sum()
            assert log == pytest.approx(expected)
        for which, tables in zip((model, single), sums):
            hm.expected_counts(which, codes, offsets, rows, *tables)
    assert sorted(seen) == list(range(25))
    for double, float32 in zip(*sums):
        assert np.allclose(double, float32, rtol=1e-4)
    assert sums[0][0].sum() == pytest.approx(lengths.sum()) and sums[0][1].sum() == pytest.approx(lengths.sum() - 25)


def plain_base(rows):
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    counts = Counter(w for k, t in rows if crc_mod(k, 10) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    p = lambda w: (counts[w] + 0.1) / (total + 0.1 * (distinct + 1))
    return sorted(
        (str(k), crc_mod(k, 10) == 0, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, round(sum(math.log10(p(w)) for w in tokens(t)), 6))
        for k, t in rows
    )


@pytest.mark.parametrize("vocabulary", [3, 1_000])
def test_scores(documents, vocabulary):
    rng = np.random.default_rng(6)
    rows = []
    for n in range(160):
        kind = ["a", "b"][n % 2]
        rows.append((n, " ".join(f"{kind}{i}" for i in rng.zipf(1.5, 20) % 50)))
    rows += [(500, None), (501, ""), (None, "a1 É b2"), (7, rows[7][1]), (502, "never seen before"), (503, "A1 " * 20_000)]
    got = hm.score_documents(documents(rows), states=2, rounds=6, vocabulary=vocabulary, prior=5.0).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got) == plain_base(rows)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    if vocabulary == 1_000:  # two kinds of text: states that keep to one kind beat word frequencies
        held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 500]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_add_up_to_probabilities(documents):
    """Over all one-word texts of a closed vocabulary plus the unseen class, the probabilities stay below one."""
    rows = [(n, "x y") for n in range(1, 9)] + [(100 + n, w) for n, w in enumerate(["x", "y", "z"])]
    got = {r["doc_id"]: r["score"] for r in hm.score_documents(documents(rows), states=2, rounds=2, vocabulary=2, rare=1).collect()}
    assert 0 < sum(10 ** got[100 + n] for n in range(3)) <= 1


def test_edge_tables(documents):
    assert hm.score_documents(documents([])).collect() == []
    only = hm.score_documents(documents([(1, None)])).collect()
    assert len(only) == 1 and only[0]["n_tokens"] == 1
