import random

import numpy as np
import pytest

from tallyloom.llm import passages
from tallyloom.operators.staging import staged_paths


def words(n, rng, tag="w"):
    return " ".join(f"{tag}{rng.randrange(100_000)}" for _ in range(n))


def corpus():
    rng = random.Random(4)
    shared = words(60, rng, "s")
    line = words(50, rng, "l").split()
    near = list(line)
    near[3] = "other"
    common = words(30, rng, "c")
    rows = [
        (10, f"{words(40, rng)} {shared} {words(30, rng)}\n{words(12, rng)}"),
        (11, f"{words(25, rng)}\n{words(20, rng)} {shared.upper()} {words(45, rng)}"),  # inside another line, other case
        (12, " ".join(line)), (13, words(35, rng) + "\n" + " ".join(near)),
        (14, words(80, rng)), (15, words(24, rng)), (16, words(24, rng)),
        (17, f"{common}\n{common}"),  # repeats inside one document stay
        (20, rows_text := words(90, rng)), (21, rows_text), (22, rows_text + " end"),
        (1, None), (2, ""), (3, " \n\n "), (None, rows_text), (14, words(40, rng)),
    ]
    hot = words(70, rng, "h")
    rows += [(100 + n, f"{words(5, rng)}\n{hot}") for n in range(40)]  # a paragraph that many documents share
    return rows, shared


def test_bands_reach_the_recall():
    bands, rows = passages.tune_bands(0.8, 0.995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.995 and bands * rows <= 64


def test_repeats_are_found_and_the_rest_is_left(documents):
    rows, _ = corpus()
    got = passages.repeated_spans(documents(rows)).collect()
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], set()).update(r["kept"])
    assert set(found) == {11, 13, 21, 22} | set(range(101, 140))
    assert found[11] == {10} and found[13] == {12} and found[21] == {20} and all(found[n] == {100} for n in range(101, 140))


def test_texts_lose_what_repeats(documents):
    rows, shared = corpus()
    table = documents(rows)
    got = passages.remove_repeats(table)
    assert got.columns == table.columns
    texts = {}
    for r in got.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
        if r["text"] is not None:
            assert r["n_chars"] == len(r["text"])
    before = dict(rows)
    for untouched in (10, 12, 15, 16, 17, 20, 1, 2, 3, None):
        assert texts[untouched] == [before[untouched]]
    assert len(texts[14]) == 2 and 21 not in texts and texts[100] == [before[100]]
    assert shared.split()[30].upper() not in texts[11][0] and texts[13] == [before[13].split("\n")[0]]
    assert len(texts[105][0].split()) <= 5


def test_all_pairs_of_paragraphs_against_brute_force(documents, components):
    rng = random.Random(9)
    base = [words(40, rng).split() for _ in range(6)]
    rows = []
    for n in range(90):
        line = list(base[n % 6])
        for _ in range(rng.randrange(0, 5)):
            line[rng.randrange(40)] = f"x{rng.randrange(9)}"
        rows.append((n, " ".join(line)))
    sets = [{tuple(t.split()[i:i + 5]) for i in range(36)} for _, t in rows]
    edges = [(a, b) for a in range(90) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label = components(range(90), edges)
    got = {r["doc_id"]: r["kept"][0] for r in passages.repeated_spans(documents(rows), recall=0.9999).filter("kind = 'paragraph'").collect()}
    assert got == {n: c for n, c in label.items() if n != c}


def test_cuts_do_not_depend_on_the_surroundings():
    rng = random.Random(2)
    inner = words(60, rng)
    cuts = []
    for before, after in ((words(33, rng), words(8, rng)), (words(5, rng), words(70, rng))):
        w = passages.Words([f"{before} {inner} {after}"])
        start = len(before.split())
        cuts.append({c - start for c in w.piece_starts(4).tolist() if 5 <= c - start < 55})
    assert cuts[0] == cuts[1] and cuts[0]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (2, "")], [(1, "a " * 5_000), (1, "a " * 5_000)]])
def test_edge_tables(documents, rows):
    table = documents(rows)
    assert passages.repeated_spans(table).collect() == []
    assert sorted(map(str, passages.remove_repeats(table).collect())) == sorted(map(str, table.collect()))


def test_long_texts_and_ties(documents):
    long = " ".join(np.random.default_rng(1).integers(0, 10**9, 120_000).astype(str))
    got = passages.repeated_spans(documents([(2, long), (1, long), (3, "and " * 200), (4, "and " * 200)])).collect()
    assert {r["doc_id"] for r in got} == {2, 4}
    assert sum(r["words"] for r in got if r["doc_id"] == 2 and r["kind"] == "passage") == 120_000


def wrapped(text, width):
    w = text.split()
    return "\n".join(" ".join(w[i:i + width]) for i in range(0, len(w), width))


def test_line_breaks_do_not_hide_a_passage(documents):
    rng = random.Random(21)
    rows, inner = [], [words(100, rng) for _ in range(12)]
    for n, (text, width) in enumerate(zip(inner, [10, 12, 15, 20, 30, 7] * 2)):
        rows.append((n, f"{words(40, rng)} {text} {words(40, rng)}"))
        rows.append((100 + n, wrapped(f"{words(33, rng)} {text} {words(45, rng)}", width)))
    got = {r["doc_id"]: r["text"].split() for r in passages.remove_repeats(documents(rows)).collect()}
    assert all(len(got[100 + n]) == 78 and not set(t.split()) & set(got[100 + n]) for n, t in enumerate(inner))


def test_short_lines_form_a_paragraph(documents):
    rng = random.Random(22)
    text = words(60, rng).split()
    near = text[:30] + ["other"] + text[31:]
    rows = [(1, wrapped(" ".join(text), 10)), (2, words(30, rng) + "\n\n" + wrapped(" ".join(near), 12) + "\n\n" + words(9, rng))]
    got = [(r["doc_id"], r["start"], r["words"], r["kept"]) for r in passages.repeated_spans(documents(rows)).filter("kind = 'paragraph'").collect()]
    assert got == [(2, 30, 60, [1])]


def test_passages_are_found_whole_from_the_least_length_on(documents):
    rng = random.Random(23)
    rows, want = [], []
    for n in range(150):
        text = words(24 + n % 3, rng)
        rows.append((n, f"{words(rng.randrange(30, 60), rng)} {text} {words(50, rng)}"))
        before = rng.randrange(30, 60)
        rows.append((1000 + n, f"{words(before, rng)} {text} {words(50, rng)}"))
        if n % 3:
            want.append((1000 + n, before, 24 + n % 3, [n]))
    got = passages.repeated_spans(documents(rows)).collect()
    assert sorted((r["doc_id"], r["start"], r["words"], r["kept"]) for r in got) == want


def test_a_passage_must_be_in_one_document(documents):
    rng = random.Random(24)
    lines = [words(6, rng) for _ in range(12)]
    rows = [(n, f"{words(30, rng)}\n{line}\n{words(30, rng)}") for n, line in enumerate(lines)]
    half = words(40, rng).split()
    rows += [(50, " ".join(half[:30])), (51, " ".join(half[10:])), (90, "\n".join(lines)), (91, " ".join(half))]
    got = sorted((r["doc_id"], r["start"], r["words"], r["kept"]) for r in passages.repeated_spans(documents(rows)).filter("kind = 'passage'").collect())
    assert got == [(91, 0, 30, [50]), (91, 10, 30, [51])]


def test_stretches_to_cut_are_apart_and_cover_what_repeats(documents):
    """A group of near copies has many passages by document, but few stretches a text."""
    rng = random.Random(25)
    base = words(400, rng).split()
    rows = []
    for n in range(40):
        text = list(base)
        for at in rng.sample(range(400), 3):
            text[at] = f"x{n}_{at}"
        rows.append((n, " ".join(text)))
    rows += [(60, rows[3][1]), (61, rows[0][1]), (2, rows[0][1]), (70, words(90, rng))]
    table = documents(rows)
    found = {}
    for r in passages.repeated_spans(table).filter("kind = 'passage'").collect():
        found.setdefault((r["doc_id"], r["row"]), []).append((r["start"], r["words"]))
    _, runs = passages._repeats(table, "doc_id", "text", passages.covered_words)
    got = {(r["id"], r["row"]): sorted((s["start"], s["words"]) for s in r["spans"]) for r in runs.collect()}
    assert got.keys() == found.keys() and sum(map(len, found.values())) > 1.5 * sum(map(len, got.values()))
    for place, spans in got.items():
        if place[0] not in (2, 60, 61):  # copies of a smaller document's text also lose what is kept there
            assert all(a + n < b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert {w for a, n in spans for w in range(a, a + n)} == {w for a, n in found[place] for w in range(a, a + n)}


def test_anchors_do_not_stay_on_disk(spark, documents):
    before = set(staged_paths())
    assert passages.repeated_spans(documents(corpus()[0])).collect()
    left = {c for path in staged_paths() if path not in before for c in spark.read.parquet(path).columns}
    assert left and not left & {"anchor", "asked", "window"}
