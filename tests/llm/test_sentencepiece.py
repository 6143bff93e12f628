import itertools
import math
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from tallyloom.llm import sentencepiece_sampling as sps

TEXTS = [
    "that is", "aab", "Hello  World\n\tab ▁ x 日本　é 🙂  ", " a", "\n", "▁", "x" * 400, "a\r\nb;\r", "", "1234567890 " * 300, "ſtraße\u0000", " ",
]


@pytest.fixture(scope="module")
def vocabulary():
    with open(sps.VOCABULARY, "rb") as file:
        return sps.Vocabulary(file.read())


def paths_of(vocabulary, word):
    """Every segmentation of a word with its probability, by brute force."""
    lattice = sps.Lattice(vocabulary, [word])

    def walk(node):
        if node == lattice.last[0]:
            yield ()
        for e in range(lattice.edge[node], lattice.edge[node + 1]):
            for rest in walk(lattice.end[e]):
                yield (e, *rest)

    paths = list(walk(lattice.first[0]))
    weight = np.array([math.exp(lattice.log[list(p)].sum()) for p in paths])
    return lattice, {p: w for p, w in zip(paths, weight / weight.sum())}


def drawn(vocabulary, texts, keys, samples):
    lattice, flat, offset, size, log, value, made, rest, starts, counts = sps.sample_texts(vocabulary, texts, np.array(keys, dtype=np.uint64), samples)
    out = []
    for d in range(len(texts)):
        rows = []
        for s in range(made[d]):
            words = range(starts[d], starts[d] + counts[d])
            rows.append((tuple(tuple(flat[offset[s, w]:offset[s, w] + size[s, w]].tolist()) for w in words), sum(log[s, w] for w in words), value[s, d]))
        out.append((rows, rest[d]))
    return out


def test_lattice_masses(vocabulary):
    for word in ("▁that", "▁aab", "▁ab"):
        lattice, paths = paths_of(vocabulary, word)
        total = sum(math.exp(lattice.log[list(p)].sum()) for p in paths)
        assert lattice.back[lattice.first[0]] == pytest.approx(math.log(total))


def test_samples_follow_the_distribution_without_replacement(vocabulary):
    n = 6_000
    _, paths = paths_of(vocabulary, "▁aabc")
    got = drawn(vocabulary, ["aabc"] * n, range(1, n + 1), 3)
    first = Counter(rows[0][0][0] for rows, _ in got)
    for path, p in paths.items():
        assert first[path] / n == pytest.approx(p, abs=4 * math.sqrt(p * (1 - p) / n) + 1e-9)
    second = Counter(rows[1][0][0] for rows, _ in got)
    for path, p in paths.items():
        q = sum(a * p / (1 - a) for other, a in paths.items() if other != path)
        assert second[path] / n == pytest.approx(q, abs=5 * math.sqrt(max(q * (1 - q), 1e-4) / n))
    weights = []
    for rows, rest in got:
        assert len({r[0] for r in rows}) == len(rows)
        assert all(a[2] >= b[2] for a, b in itertools.pairwise(rows))
        weights.append(sum(math.exp(r[1]) / -math.expm1(-math.exp(r[1] - rest)) if math.isfinite(rest) else math.exp(r[1]) for r in rows))
    assert np.mean(weights) == pytest.approx(1, abs=0.02)  # inclusion scores make the sample unbiased


def test_few_segmentations_are_all_given(vocabulary):
    _, paths = paths_of(vocabulary, "▁ab")
    (rows, rest), = drawn(vocabulary, ["ab"], [5], 50)
    assert {r[0][0] for r in rows} == set(paths) and rest == -math.inf


def test_very_long_words(vocabulary):
    text = "".join(np.random.default_rng(1).choice(list("abcdeß"), 60_000))
    (rows, _), = drawn(vocabulary, [text], [9], 3)
    assert len({r[0] for r in rows}) == 3


def test_tables(documents):
    rows = [(n, t) for n, t in enumerate(TEXTS)] + [(None, "that is"), (50, None), (0, TEXTS[0])]
    encoded = sps.encode(documents(rows), samples=3)
    got = sps.decode(encoded).collect()
    texts = {}
    for r in got:
        texts.setdefault(r["doc_id"], []).append(r)
    assert set(texts) == set(range(len(TEXTS))) | {None}
    sp = sentencepiece.SentencePieceProcessor(model_file=sps.VOCABULARY)
    for n, text in enumerate(TEXTS):
        assert {r["text"] for r in texts[n]} == {text}
        samples = {tuple(r["ids"]) for r in texts[n]}
        assert len(samples) == len({r["sample"] for r in texts[n]})
        assert all(0 < r["inclusion"] <= 1 or math.isclose(r["inclusion"], 0, abs_tol=1e-12) for r in texts[n])
        if "▁" not in text:  # the library decodes a spelled mark to itself as well
            assert {sp.decode(list(s)) for s in samples} == {text}
    assert len(texts[0]) == 6 and len({tuple(r["ids"]) for r in texts[0]}) == 3  # repeated rows: equal samples
    assert len(texts[8]) == 1 and texts[8][0]["ids"] == [] and texts[8][0]["log_prob"] == 0
    again = sps.encode(documents(list(reversed(rows))), samples=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, encoded.collect()))
    assert all(r["exact"] for r in sps.encode_checked(documents(rows)).collect())
    assert sps.encode(documents([])).collect() == [] and sps.decode(sps.encode(documents([]))).collect() == []


def test_a_vocabulary_is_made_once_on_the_driver(documents, monkeypatch):
    made = []
    make = sps.Vocabulary.__init__
    sps._parts.cache_clear()
    with monkeypatch.context() as patch:
        patch.setattr(sps.Vocabulary, "__init__", lambda self, *how: (made.append(how[1:]), make(self, *how))[1])
        sps.decode(sps.encode(documents([(1, "that is")])))
        sps.encode(documents([]))
    assert made == [("rank",)]


def test_single_random_numbers(vocabulary):
    for key in (0, 5, 2**63 + 11, 2**64 - 1):
        for step in (0, 1_003, 1 << 22):
            assert sps.number(key, 2, 77, step) == sps.uniforms(np.array([key], dtype=np.uint64), 2, np.array([77]), step)[0]


def test_decoding_of_any_ids(vocabulary):
    that = vocabulary.bytes.index(b" that")
    ids = np.array([that, that, vocabulary.byte[0xFF], vocabulary.byte[0xC3], vocabulary.byte[0xA9]], dtype=np.int32)
    assert vocabulary.decode(ids, np.array([0, 2, 0, 1, 2])).to_pylist() == ["", "that that", "", "", "�"]
    assert vocabulary.decode(ids[:0], np.array([], dtype=np.int64)).to_pylist() == []


def test_a_group_of_texts_takes_little_memory(vocabulary):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 8)) for _ in range(sps._GROUP_CHARS // 9)]
    tracemalloc.start()
    sps.sample_texts(vocabulary, [" ".join(words)], np.array([1], dtype=np.uint64), 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
