"""SentencePiece encoding by sampling distinct segmentations, and decoding.

The pieces of a vocabulary file span a lattice over a text; a path is a segmentation, with the product of
its pieces' probabilities. `samples` distinct paths are drawn without replacement by Gumbel top-k: a
perturbed A-star search whose queue holds disjoint sets of paths, each with a Gumbel value of its total
mass. The best set is taken, a path is drawn inside it and emitted with the set's value, and what is left of
the set is cut where another path can first leave the drawn one; the parts get Gumbel values truncated at
the taken value. Path masses come from a backward sum over the lattice, so no step is wasted. The next value
in the queue after the last sample is the threshold of the inclusion score 1 - exp(-exp(log_prob - threshold)).

No piece holds a space mark after another character, so the lattice falls apart into words: backward sums
are kept per distinct word, and all words of a batch of texts advance together. Random numbers are a hash of
row key, sample, word and step: a text gets the same samples in any batch, partition or retry.

Pieces with a model's own log-probabilities keep them (`prior="scores"`); merge ranks of a byte-pair model
become Zipf probabilities (`prior="rank"`). Characters without a piece are spelled in byte pieces, or
unknown pieces where the model has none. Nothing is trained and no text is cut.

Defined cases: null texts give no rows; the empty text gives one empty segmentation of probability one.
Texts with fewer than `samples` segmentations give all of them, with inclusion 1. Repeated rows get equal
samples. A null key seeds like the key 0. An empty table gives an empty result. Further columns are ignored.
Decoding gives back the text exactly where the vocabulary has byte pieces.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import tidy

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
_MARK, _LITERAL = "▁", "\udfff"  # the space mark; a mark that the text itself holds
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1
_GROUP_CHARS = 300_000  # a task holds the lattices of so much text at a time


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bases(keys: np.ndarray, sample: int, word: np.ndarray) -> np.ndarray:
    """The source of random numbers of each row key and word."""
    x = _mix(keys + np.uint64((sample * 1_000_003 + 1) * int(_BASE) & _ALL))
    return x + word.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)


def numbers(base: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1), one for each source."""
    x = _mix(base + np.uint64(step * 0x2545F4914F6CDD1D & _ALL))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def uniforms(keys: np.ndarray, sample: int, word: np.ndarray, step: int) -> np.ndarray:
    return numbers(bases(keys, sample, word), step)


def number(key: int, sample: int, word: int, step: int) -> float:
    """The same for a single row key and word, without arrays."""
    x = _mix_one(key + (sample * 1_000_003 + 1) * int(_BASE) & _ALL) + word * 0xD1342543DE82EF95
    return ((_mix_one(x + step * 0x2545F4914F6CDD1D & _ALL) >> 11) + 0.5) * 2.0**-53


def _mix_one(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _ALL
    return x ^ (x >> 31)


class Vocabulary:
    """Pieces, their log-probabilities, and the hashes of all their prefixes."""

    def __init__(self, model: bytes, prior: str = "rank"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        usual = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        score = np.array([sp.get_score(i) for i in range(n)])
        if prior == "rank":
            rank = np.empty(len(usual))
            rank[np.argsort(-score[usual], kind="stable")] = np.arange(len(usual))
            weight = 1 / (rank + 2.7)
            score[usual] = np.log(weight / weight.sum())
        self.score = score
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = sp.unk_id()
        if any(b == self.unknown or not sp.is_byte(b) for b in self.byte):
            self.byte = []
        self.spell = float(score[usual].min() - 2)  # log-probability of a byte piece or an unknown piece
        self.bytes = [b""] * n
        for i in usual:
            self.bytes[i] = names[i].replace(_MARK, " ").encode()
        for b, i in enumerate(self.byte):
            self.bytes[i] = bytes([b])
        self.bytes[self.unknown] = " ⁇ ".encode()
        found: dict[int, int] = {}
        for i in usual:
            h = 0
            for at, c in enumerate(names[i]):
                h = (h * int(_BASE) + ord(c) + 1) & _ALL
                if at + 1 == len(names[i]):
                    found[h] = i
                else:
                    found.setdefault(h, -1)
        keys = _mix(np.fromiter(found, dtype=np.uint64, count=len(found)))
        order = np.argsort(keys)
        # Sorted hashes with the first place of each leading 17 bits: a lookup reads one or two entries.
        self.prefix = np.append(keys[order], np.uint64(0))
        self.piece = np.append(np.fromiter(found.values(), dtype=np.int64, count=len(found))[order], -1)
        self.bucket = np.searchsorted(keys[order], np.arange(1 << 17, dtype=np.uint64) << np.uint64(47)).astype(np.int32)
        joined = {c for i in usual if len(names[i]) > 1 for c in names[i]}
        alone = "".join(c for c in "\n\t" if c not in joined)
        self.cut = re.compile(f"[{alone}]|{_MARK}*[^{_MARK}{alone}]+|{_MARK}+" if alone else f"{_MARK}*[^{_MARK}]+|{_MARK}+")

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are prefixes of pieces, and their places."""
        h = _mix(h)
        slot = self.bucket[(h >> np.uint64(47)).astype(np.int64)]
        more = np.flatnonzero(self.prefix[slot] < h)
        while len(more):
            slot[more] += 1
            here = self.prefix[slot[more]]
            more = more[(here < h[more]) & (here != 0)]
        hit = np.flatnonzero(self.prefix[slot] == h)
        return hit, slot[hit]

    def words(self, text: str) -> list[str]:
        return self.cut.findall(_MARK + text.replace(_MARK, _LITERAL).replace(" ", _MARK)) if text else []

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """Texts of consecutive lists of ids: the bytes of all pieces are gathered at once."""
        raw = pa.array(self.bytes, pa.large_binary()).take(pa.array(ids, pa.int32()))
        ends = np.zeros(1, dtype=np.int64)
        if len(raw):
            ends = np.frombuffer(raw.buffers()[1], dtype=np.int64, count=len(raw) + 1)
        cuts = ends[np.concatenate(([0], np.cumsum(lengths)))]
        some = cuts[1:] > cuts[:-1]
        kept = np.ones(int(cuts[-1]), dtype=bool)
        kept[cuts[:-1][some]] = False  # the first space mark of each text
        data = np.frombuffer(raw.buffers()[2], dtype=np.uint8, count=len(kept))[kept] if len(kept) else np.zeros(0, dtype=np.uint8)
        cuts -= np.concatenate(([0], np.cumsum(some)))
        texts = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        try:
            return texts.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())


@lru_cache(maxsize=2)
def _parts(model: bytes, prior: str) -> dict:
    """What a vocabulary consists of: made once on the driver and broadcast, some MB."""
    return vars(Vocabulary(model, prior))


def _whole(parts: dict) -> Vocabulary:
    vocabulary = Vocabulary.__new__(Vocabulary)
    vars(vocabulary).update(parts)
    return vocabulary


class Lattice:
    """Lattices of distinct words: nodes are character positions, edges are pieces."""

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        self.vocabulary = vocabulary
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        # Nodes are numbered by their distance to the end of their word, so that backward sums go by slices.
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        nodes = len(chars) + len(words)
        away = np.repeat(starts + lengths, lengths + 1) - np.arange(nodes)
        by_away = np.argsort(away.astype(np.int16) if nodes and lengths.max() < 32_767 else away, kind="stable")
        name = np.empty(nodes, dtype=np.int64)
        name[by_away] = np.arange(nodes)
        levels = np.searchsorted(away[by_away], np.arange(int(lengths.max()) + 2 if nodes else 0))
        self.first, self.last = name[starts], name[starts + lengths]
        word = np.repeat(np.arange(len(words)), lengths)
        node = np.arange(len(chars)) + word  # place, before renumbering, of the node at which a character starts
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))
        code = chars.astype(np.uint64) + np.uint64(1)
        at, h = np.arange(len(chars)), np.zeros(len(chars), dtype=np.uint64)
        single = np.zeros(len(chars), dtype=bool)
        found = []
        size = 0
        while len(at):
            h = h * _BASE + code[at + size]
            size += 1
            hit, slot = vocabulary.find(h)
            at, h = at[hit], h[hit]
            piece = vocabulary.piece[slot]
            real = np.flatnonzero(piece >= 0)
            ends = node[at[real]]
            found.append((name[ends], name[ends + size], piece[real]))
            if size == 1:
                single[at[real]] = True
            more = np.flatnonzero(left[at] > size)
            at, h = at[more], h[more]
        spelled = np.flatnonzero(~single)
        self.spelling: list[list[int]] = []
        codes: dict[int, int] = {}
        for c in np.unique(chars[spelled]).tolist():
            codes[c] = len(self.spelling)
            raw = (_MARK if chr(c) == _LITERAL else chr(c)).encode("utf-8", "replace")
            self.spelling.append([vocabulary.byte[b] for b in raw] if vocabulary.byte else [vocabulary.unknown])
        found.append((name[node[spelled]], name[node[spelled] + 1], np.array([-1 - codes[c] for c in chars[spelled].tolist()], dtype=np.int64)))
        # Edges by node, long pieces first, as they are the likely ones: each size has one edge of a node at most.
        degree = np.zeros(nodes, dtype=np.int64)
        for start, _, _ in found:
            degree[start] += 1
        self.edge = np.concatenate(([0], np.cumsum(degree)))
        place = self.edge[1:].copy()
        edges = int(self.edge[-1])
        self.end, self.piece = np.empty(edges, dtype=np.int64), np.empty(edges, dtype=np.int64)
        found.insert(0, found.pop())
        while found:
            start, end, piece = found.pop(0)
            to = place[start] - 1
            place[start] = to
            self.end[to], self.piece[to] = end, piece
        # The spelling of code n is piece -1 - n: it is found from the end of the scores.
        spell = np.array([len(x) * vocabulary.spell for x in reversed(self.spelling)])
        self.log = np.concatenate((vocabulary.score, spell)).take(self.piece, mode="wrap")
        # Backward sums, from the last characters of all words to the first ones.
        self.back = np.zeros(nodes)
        through = np.empty(edges)
        for k in range(1, len(levels) - 1):
            low, high = int(levels[k]), int(levels[k + 1])
            if low == high:
                continue
            e = slice(int(self.edge[low]), int(self.edge[high]))
            cuts = self.edge[low:high] - self.edge[low]
            total = through[e] = self.log[e] + self.back[self.end[e]]
            top = np.maximum.reduceat(total, cuts)
            self.back[low:high] = top + np.log(np.add.reduceat(np.exp(total - np.repeat(top, degree[low:high])), cuts))
        # Share of each edge at its node, running sums of the shares, and the shares of all other edges.
        start = np.repeat(np.arange(nodes), degree)
        share = through
        share -= self.back[start]
        np.exp(share, out=share)
        self.upto = share.copy()
        many, k = np.flatnonzero(degree > 1), 1
        while len(many):
            at = self.edge[many] + k
            self.upto[at] += self.upto[at - 1]
            k += 1
            many = many[degree[many] > k]
        self.upto[self.edge[1:][degree > 0] - 1] = 1.0
        likely = np.flatnonzero(share > 0.5)  # one edge of a node at most: the others are added up without it
        self.others = 1 - share
        share[likely] = 0.0
        rest = np.bincount(start, weights=share, minlength=nodes)
        self.others[likely] = rest[start[likely]]

    def draw(self, word: np.ndarray, keys: np.ndarray, sample: int, place: np.ndarray):
        """A path of each occurrence of a word: edges in order, edges per occurrence, log-probability, mass of other paths."""
        log, other, size = np.zeros(len(word)), np.zeros(len(word)), np.zeros(len(word), dtype=np.int64)
        # Of the occurrences that are not at their end: number, node, end, mass of the word, random source, and both sums.
        active, node, last = np.arange(len(word)), self.first[word], self.last[word]
        whole, base, path, left = self.back[node], bases(keys, sample, place), np.zeros(len(word)), np.zeros(len(word))
        steps = []
        step = 0
        while len(active):
            r = numbers(base, step)
            e = self.edge[node]
            more = np.flatnonzero(r > self.upto[e])
            while len(more):
                e[more] += 1
                more = more[r[more] > self.upto[e[more]]]
            left += np.exp(path + self.back[node] - whole) * self.others[e]
            path += self.log[e]
            node = self.end[e]
            steps.append((active, e))
            step += 1
            done = node == last
            at = np.flatnonzero(done)
            ended = active[at]
            log[ended], other[ended], size[ended] = path[at] - whole[at], left[at], step
            at = np.flatnonzero(~done)
            active, node, last, whole, base, path, left = (x[at] for x in (active, node, last, whole, base, path, left))
        edges = np.empty(int(size.sum()), dtype=np.int64)
        begin = np.cumsum(size) - size
        for step, (active, e) in enumerate(steps):
            edges[begin[active] + step] = e
        return edges, size, log, other

    def free_masses(self, word: int, paths: list[tuple[int, ...]]) -> tuple[list[dict[int, int]], list[np.ndarray | None]]:
        """A tree of the given paths of a word, and at each tree node the edges' shares without those paths.

        Node 0 is the start of the word. Only sums of positive shares, so that a tiny rest keeps its precision.
        """
        children: list[dict[int, int]] = [{}]
        place = [int(self.first[word])]
        for path in paths:
            at = 0
            for e in path:
                if e not in children[at]:
                    children[at][e] = len(children)
                    children.append({})
                    place.append(int(self.end[e]))
                at = children[at][e]
        free: list[np.ndarray | None] = [None] * len(children)
        total = [0.0] * len(children)
        for t in range(len(children) - 1, -1, -1):
            if place[t] == self.last[word]:
                continue
            low = int(self.edge[place[t]])
            share = self.shares(place[t])
            for e, child in children[t].items():
                share[e - low] *= total[child]
            free[t], total[t] = share, float(share.sum())
        return children, free

    def shares(self, node: int) -> np.ndarray:
        some = slice(int(self.edge[node]), int(self.edge[node + 1]))
        return np.exp(self.log[some] + self.back[self.end[some]] - self.back[node])

    def draw_other(self, word: int, excluded: list[tuple[int, ...]], key: np.uint64, sample: int, place: int) -> tuple[tuple[int, ...], float]:
        """A path of one word that is none of the excluded ones, and its log-probability."""
        children, free = self.free_masses(word, excluded)
        node, last, path, at = int(self.first[word]), int(self.last[word]), [], 0
        while node != last:
            share = self.shares(node) if at is None else free[at]
            r = number(int(key), sample, place, 1_000 + len(path)) * share.sum()
            e = int(self.edge[node]) + min(int(np.searchsorted(np.cumsum(share), r)), int(np.flatnonzero(share)[-1]))
            at = None if at is None else children[at].get(e)
            path.append(e)
            node = int(self.end[e])
        return tuple(path), float(self.log[path].sum() - self.back[self.first[word]])

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of edges, and how many each edge has."""
        piece = self.piece[edges]
        size = np.ones(len(piece), dtype=np.int64)
        spelled = np.flatnonzero(piece < 0)
        if not len(spelled):
            return piece, size
        sizes = np.array([len(s) for s in self.spelling])
        code = -1 - piece[spelled]
        size[spelled] = n = sizes[code]
        out = np.repeat(piece, size)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        letters = np.array(list(chain.from_iterable(self.spelling)))
        out[np.repeat((np.cumsum(size) - size)[spelled], n) + within] = letters[np.repeat((np.cumsum(sizes) - sizes)[code], n) + within]
        return out, size


def _cut_gumbel(mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values of sets of log-mass `mass`, not above `bound`."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        return mass - np.log(np.exp(mass - bound) - np.log(u))


def sample_texts(vocabulary: Vocabulary, texts: list[str], keys: np.ndarray, samples: int):
    """For each text a list of (ids, log-probability, Gumbel value, inclusion), best value first."""
    split = [vocabulary.words(t) for t in texts]
    counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    numbered: defaultdict[str, int] = defaultdict(count().__next__)
    word = np.fromiter(map(numbered.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(counts.sum()))
    del split
    lattice = Lattice(vocabulary, list(numbered))
    del numbered
    starts = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(word)) - starts[text]
    word_keys = keys[text]
    filled = np.flatnonzero(counts)
    # Per sample and word: where its edges lie in the pool, how many, and their log-probability.
    pool: list[np.ndarray] = []
    pooled = 0
    offset, size, log, other = (np.zeros((samples, len(word)), dtype=k) for k in (np.int64, np.int64, np.float64, np.float64))
    value = np.full((samples, len(texts)), -np.inf)
    made = np.zeros(len(texts), dtype=np.int64)
    branch = np.full(len(texts), -1)
    queue: list[list] = [[] for _ in texts]  # (value, parent sample, word place, excluded paths)
    rest = np.full(len(texts), -np.inf)
    edges, n, log[0], other[0] = lattice.draw(word, word_keys, 0, place)
    offset[0], size[0] = np.cumsum(n) - n, n
    pool.append(edges)
    pooled += len(edges)
    value[0, filled] = -np.log(-np.log(uniforms(keys[filled], 0, np.zeros(len(filled), dtype=np.int64), 1 << 20)))
    made[filled] = 1
    alive = filled
    for turn in range(samples):
        # Cut what is left of the set just taken: another path leaves at one of the words after the branch.
        prefix = np.zeros(len(word))
        for d in alive.tolist():  # sums inside each text, so that a text does not depend on its batch
            here = slice(int(starts[d]), int(starts[d] + counts[d]))
            prefix[here] = np.cumsum(log[turn, here]) - log[turn, here]
        live = np.zeros(len(texts), dtype=bool)
        live[alive] = True
        with np.errstate(divide="ignore"):
            mass = prefix + np.log(other[turn])
        mass[(place <= branch[text]) | ~live[text]] = -np.inf
        gumbel = _cut_gumbel(mass, value[turn][text], uniforms(word_keys, turn, place, 1 << 21))
        gumbel[~np.isfinite(mass)] = -np.inf
        for _ in range(samples - turn):
            if not len(alive):
                break
            top = np.maximum.reduceat(gumbel, starts[filled])
            best = np.full(len(texts), -np.inf)
            best[filled] = top
            at = np.flatnonzero((gumbel == best[text]) & np.isfinite(gumbel))
            if not len(at):
                break
            for i in at.tolist():
                e = pool_slice(pool, offset[turn, i], size[turn, i])
                queue[text[i]].append((float(gumbel[i]), turn, int(place[i]), [e]))
            gumbel[at] = -np.inf
        if turn + 1 == samples:
            break
        following = []
        taken: dict[int, tuple] = {}
        for d in alive.tolist():
            if queue[d]:
                queue[d].sort(key=lambda q: -q[0])
                taken[d] = queue[d].pop(0)
                following.append(d)
        alive = np.array(following, dtype=np.int64)
        branch[:] = np.iinfo(np.int64).max
        parent = np.zeros(len(texts), dtype=np.int64)
        for d, (_, s, w, _) in taken.items():
            branch[d], parent[d] = w, s
        after = np.flatnonzero(place > branch[text])
        edges, n, path_log, path_other = lattice.draw(word[after], word_keys[after], turn + 1, place[after])
        new = turn + 1
        every = np.arange(len(word))
        offset[new], size[new], log[new] = offset[parent[text], every], size[parent[text], every], log[parent[text], every]
        offset[new, after], size[new, after], log[new, after], other[new, after] = np.cumsum(n) - n + pooled, n, path_log, path_other
        pool.append(edges)
        pooled += len(edges)
        extra = []
        for d, (g, s, w, excluded) in taken.items():
            at = int(starts[d]) + w
            path, path_log = lattice.draw_other(int(word[at]), excluded, keys[d], new, w)
            offset[new, at], size[new, at], log[new, at] = pooled + len(extra), len(path), path_log
            extra += path
            value[new, d] = g
            made[d] += 1
            # What is left at this word, beside the excluded paths and the new one.
            out = excluded + [path]
            left = float(lattice.free_masses(int(word[at]), out)[1][0].sum())
            if left > 0:
                before = float(np.cumsum(log[new, int(starts[d]):at])[-1]) if w else 0.0
                u = np.array([number(int(keys[d]), new, w, 1 << 22)])
                q = float(_cut_gumbel(np.array([before + math.log(left)]), np.array([g]), u)[0])
                queue[d].append((q, new, w, out))
        pool.append(np.array(extra, dtype=np.int64))
        pooled += len(extra)
    for d in filled.tolist():
        rest[d] = max((q[0] for q in queue[d]), default=-np.inf)
    flat = np.concatenate(pool) if pool else np.zeros(0, dtype=np.int64)
    return lattice, flat, offset, size, log, value, made, rest, starts, counts


def pool_slice(pool: list[np.ndarray], offset: int, size: int) -> tuple[int, ...]:
    for part in pool:
        if offset < len(part):
            return tuple(part[offset:offset + size].tolist())
        offset -= len(part)
    return ()


def encode(
    documents: DataFrame, samples: int = 2, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, prior: str = "rank"
) -> DataFrame:
    """(key, text_hash, sample, ids, log_prob, value, inclusion) of each sampled segmentation; sample from 1."""
    with open(vocabulary, "rb") as file:
        parts = documents.sparkSession.sparkContext.broadcast(_parts(file.read(), prior))
    source = documents.filter(F.col(text).isNotNull()).select(
        key, F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("0"))).alias("seed"), text, F.xxhash64(text).alias("text_hash")
    )
    kind = dict(source.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _whole(parts.value)
        for batch in batches:
            start, size = 0, 0
            lengths = pc.utf8_length(batch.column(2)).to_pylist()
            for n, length in enumerate(lengths):
                size += length
                if size >= _GROUP_CHARS or n + 1 == len(lengths):
                    yield from group(words, batch.slice(start, n + 1 - start))
                    start, size = n + 1, 0

    def group(words: Vocabulary, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seeds = part.column(1).to_numpy().view(np.uint64)
        texts, outer = part.column(2).to_pylist(), part.select([0, 3])
        lattice, flat, offset, size, log, value, made, rest, starts, counts = sample_texts(words, texts, seeds, samples)
        owner = np.repeat(np.arange(len(texts)), counts)
        for s in range(samples):
            rows = np.flatnonzero((made > s) | ((counts == 0) & (s == 0)))
            if not len(rows):
                continue
            given = np.zeros(len(texts), dtype=bool)
            given[rows] = True
            chosen = given[owner]
            o, n = offset[s][chosen], size[s][chosen]
            at = np.repeat(o - (np.cumsum(n) - n), n)
            at += np.arange(len(at))
            ids, per_edge = lattice.ids(flat[at])
            per_word = np.add.reduceat(per_edge, np.cumsum(n) - n) if len(n) else n
            per_text = np.bincount(owner[chosen], weights=per_word, minlength=len(texts)).astype(np.int64)[rows]
            total = np.bincount(owner, weights=log[s], minlength=len(texts))[rows]
            with np.errstate(over="ignore"):
                inclusion = np.where(np.isfinite(rest[rows]), -np.expm1(-np.exp(total - rest[rows])), 1.0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_text))), pa.int32()), pa.array(ids.astype(np.int32)))
            some = outer.take(pa.array(rows))
            worth = np.where(counts[rows] == 0, 0.0, value[s, rows])
            yield pa.RecordBatch.from_arrays(
                [some.column(0), some.column(1), pa.array(np.full(len(rows), s + 1), pa.int32()), lists, pa.array(total), pa.array(worth), pa.array(inclusion)],
                names=[key, "text_hash", "sample", "ids", "log_prob", "value", "inclusion"],
            )

    return source.mapInArrow(
        tidy(run), f"{key} {kind}, text_hash long, sample int, ids array<int>, log_prob double, value double, inclusion double"
    )


def decode(encoded: DataFrame, ids: str = "ids", vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """The table with the column `text`, put together from the pieces in `ids`; null ids give null."""
    with open(vocabulary, "rb") as file:
        parts = encoded.sparkSession.sparkContext.broadcast(_parts(file.read(), "rank"))
    source = encoded.drop(text) if text in encoded.columns else encoded
    at = source.columns.index(ids)
    schema = ", ".join(f"`{c}` {t}" for c, t in source.dtypes) + f", `{text}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _whole(parts.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                lists = part.column(at)
                lengths = lists.value_lengths().fill_null(0).to_numpy()
                out = words.decode(lists.flatten().to_numpy(), lengths)
                if lists.null_count:
                    out = pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), out)
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*part.schema.names, text])

    return source.mapInArrow(tidy(run), schema)


def encode_checked(documents: DataFrame, samples: int = 2, **how) -> DataFrame:
    """Samples of every text with their pieces' digest instead of the pieces, and whether they decode to the text."""
    encoded = encode(documents, samples, **how)
    back = decode(encoded, vocabulary=how.get("vocabulary", VOCABULARY))
    return back.select(
        how.get("key", "doc_id"), "sample", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("digest"), "log_prob",
        "value", "inclusion", (F.xxhash64("text") == F.col("text_hash")).alias("exact"),
    )
