"""SimHash near-duplicates by tiled exact comparison.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the document's word
shingles. Distinct fingerprints are laid out in blocks of equal population count; a block pair whose
population counts differ by more than the radius cannot link and is never formed. Inside a block pair the
rows are sorted by the population counts of their four 16-bit quarters and cut into tiles; a tile pair is
skipped when the counts, total or by quarter, differ by more than the radius. All other tile pairs are
compared in full: exclusive-or and bit counts in numpy. So no link is missed and none is guessed.

Copies share a fingerprint and are one row of the comparison, however many there are. A block pair returns
at most one link per fingerprint (to the smallest of its local component), which is enough for components;
they are then joined across block pairs. The comparison grows with the square of the number of distinct
fingerprints, divided by what the population counts exclude; each task holds two blocks of bounded size.

Defined cases: texts with fewer words than a shingle are one shingle of all their words; null texts and
texts without words have fingerprint zero and link like any other. Repeated rows are kept as rows. A row
without an id keeps its fingerprint and gets the component of its fingerprint (null if no row of the
component has an id). An empty table gives an empty result. Further columns are ignored.

`keep_one`, the stage of a pipeline, has no contract of its own: it takes five-word shingles, candidates by
wider fingerprints at a radius calibrated to the similarity, and the exact Jaccard similarity of each candidate. Where
the parities of two sets already show that they differ by too much, which is certain, they are no candidate.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.config import LIMITS
from tallyloom.llm.common import connected_components, local_stars, tidy
from tallyloom.operators.skew import fresh, lookup_join
from tallyloom.operators.staging import release_shuffles, stage, unstage

SEED = 42
PARTS = 4  # 64-bit fingerprints of a text in `keep_one`
_SETS = replace(LIMITS, broadcast_bytes=8 << 20)  # shingle sets are several times larger in memory than counted
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit fingerprint of a text; words are runs without ASCII white space, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    spans = zip(starts[:n].tolist(), ends[shingle - 1:].tolist())
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), dtype=np.uint64, count=n)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 14):  # bounded memory for very long texts
        part = hashes[at:at + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(key, fp) of every row; fp is the fingerprint as a signed long."""
    source = documents.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=[key, "fp"])

    return source.mapInArrow(tidy(run), f"{key} {dict(source.dtypes)[key]}, fp long")


def near_links(a: np.ndarray, b: np.ndarray | None, radius: int, tile: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of fingerprints (uint64) a[i], b[j] that differ in at most `radius` bits; b None: inside a.

    Positions of b count on from len(a). Inside a tile pair links are reduced to those that connect the same
    rows, so a large group of near copies gives no square of links.
    """

    def prepared(x):
        quarters = np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int16)
        order = np.lexsort(quarters.T)
        starts = np.arange(0, len(x), tile)
        q = quarters[order]
        return x[order], order, starts, np.minimum.reduceat(q, starts), np.maximum.reduceat(q, starts)

    none = np.zeros(0, dtype=np.int64)
    if not len(a) or b is not None and not len(b):
        return none, none
    xa, oa, sa, la, ha = prepared(a)
    xb, ob, sb, lb, hb = (xa, oa, sa, la, ha) if b is None else prepared(b)
    shift = 0 if b is None else len(a)
    left, right = [none], [none]
    for i, start in enumerate(sa):
        apart = np.maximum(0, np.maximum(lb - ha[i], la[i] - hb)).sum(axis=1)  # a lower bound of the distance
        if b is None:
            apart[:i] = radius + 1
        rows = xa[start:start + tile, None]
        for j in np.flatnonzero(apart <= radius):
            u, v = np.nonzero(np.bitwise_count(rows ^ xb[None, sb[j]:sb[j] + tile]) <= radius)
            if not len(u):
                continue
            u, v = oa[start + u], ob[sb[j] + v] + shift
            if len(u) > 2 * tile:
                ids, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
                u, v = local_stars(inverse[: len(u)], inverse[len(u):], ids)
            left.append(u)
            right.append(v)
    return np.concatenate(left), np.concatenate(right)


def fingerprint_links(distinct: DataFrame, radius: int = 4, block_rows: int = 16_384) -> DataFrame:
    """(a, b): links between distinct fingerprints, reduced inside each block pair to one per fingerprint.

    `distinct` holds a column fp, each value once.
    """
    counted = distinct.select("fp", F.bit_count("fp").alias("ones"))
    # At most 65 population counts, so this little table is bounded.
    blocks = {int(r["ones"]): -(-int(r["count"]) // block_rows) for r in counted.groupBy("ones").count().collect()}
    if not blocks:
        return distinct.sparkSession.createDataFrame([], "a long, b long")
    number = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])
    placed = counted.withColumn("block", F.pmod(F.xxhash64("fp"), number[F.col("ones")]).cast("int"))
    # The pairs (ones, block) <= (other ones, other block) that a row takes part in, on either side.
    partner = F.explode(
        F.flatten(
            F.transform(
                F.array(*[F.lit(d) for d in range(-radius, radius + 1)]),
                lambda d: F.transform(
                    F.when(F.try_element_at(number, F.col("ones") + d).isNotNull(), F.sequence(F.lit(0), (F.try_element_at(number, F.col("ones") + d) - 1).cast("int")))
                    .otherwise(F.array().cast("array<int>")),
                    lambda k: F.struct((F.col("ones") + d).alias("ones"), k.alias("block")),
                ),
            )
        )
    )
    own = F.struct(F.col("ones").alias("ones"), F.col("block").alias("block"))
    sent = placed.withColumn("other", partner).select(
        "fp", F.least(own, F.col("other")).alias("low"), F.greatest(own, F.col("other")).alias("high"),
        (own <= F.col("other")).alias("first"),
    ).select("fp", "low.ones", "low.block", F.col("high.ones").alias("ones2"), F.col("high.block").alias("block2"), "first")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy(dtype=np.int64)
        first = rows["first"].to_numpy(dtype=bool)
        a, b = np.sort(fp[first]), np.sort(fp[~first])
        inside = key[0] == key[2] and key[1] == key[3]
        i, j = near_links(a.view(np.uint64), None if inside else b.view(np.uint64), radius)
        u, v = local_stars(i, j, np.concatenate([a, b]))
        return pd.DataFrame({"a": u, "b": v})

    return sent.groupBy("ones", "block", "ones2", "block2").applyInPandas(compare, "a long, b long")


def near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, block_rows: int = 16_384
) -> DataFrame:
    """(key, fp, component): the smallest id reachable over links, for every row."""
    prints = stage(fingerprints(documents, key, text, shingle))
    firsts = stage(prints.groupBy("fp").agg(F.min(key).alias("first")))
    groups = connected_components(fingerprint_links(firsts, radius, block_rows))
    merged = firsts.join(groups, firsts["fp"] == groups["id"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root")
    )
    smallest = merged.groupBy("root").agg(F.min("first").alias("component"))
    named = merged.join(smallest, "root").select("fp", "component")
    return prints.join(named, "fp").select(key, "fp", "component")


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Distinct hashes, in order, of the runs of `shingle` words; fewer words are one run, no words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    shingle = min(shingle, len(words))
    n = len(words) - shingle + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(shingle):
        out = out * _FACTOR + own[i:i + n]
    return np.unique(_scattered(out))


def _scattered(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """PARTS independent 64-bit fingerprints of a set of shingle hashes."""
    counts = np.zeros(64 * PARTS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 13):  # bounded memory for very long texts
        part = hashes[at:at + (1 << 13), None]
        part = np.ascontiguousarray(_scattered(part + _FACTOR * np.arange(1, PARTS + 1, dtype=np.uint64)))
        counts += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def parities(hashes: np.ndarray, most: int = 4_096) -> bytes:
    """Bits that tell whether an odd number of a set's hashes falls on them; 2 to 4 bits a hash, `most` in all.

    Hashes of both sets cancel out, so the sketches of two sets never differ in more bits than the sets in elements.
    """
    bits = min(most, max(64, 1 << (2 * len(hashes) - 1).bit_length())) if len(hashes) else 64
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Parities at `size` bytes each, as rows of uint64; longer sketches are folded, their halves cancelling out."""
    out = np.zeros((len(sketches), size), dtype=np.uint8)
    lengths = np.fromiter(map(len, sketches), dtype=np.int64, count=len(sketches))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        x = np.frombuffer(b"".join(sketches[n] for n in at), dtype=np.uint8).reshape(len(at), length)
        while x.shape[1] > size:
            half = x.shape[1] // 2
            x = x[:, :half] ^ x[:, half:]
        out[at] = x
    return out.view(np.uint64)


@functools.cache
def bit_share(similarity: float, most: int = 40) -> float:
    """The largest probability that a fingerprint bit differs between two sets of at least this Jaccard similarity.

    Sets of up to `most` elements together are enumerated; for larger ones the angle between them counts.
    """

    def spread(n):
        return np.array([math.comb(n, k) / 2**n for k in range(n + 1)])

    def share(same, x, y):
        """Elements in both sets and in one only; a bit is 1 if it is set in over half of a set's elements."""
        k, i, j = np.ogrid[:same + 1, :x + 1, :y + 1]
        chance = spread(same)[:, None, None] * spread(x)[None, :, None] * spread(y)[None, None, :]
        return float(chance[(2 * (k + i) > same + x) != (2 * (k + j) > same + y)].sum())

    pairs = ((same, x, only - x) for same in range(1, most) for only in range(1, most) if same >= similarity * (same + only) - 1e-9 for x in range(only + 1))
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return max(angle, max((share(*p) for p in pairs), default=0.0))


def calibrated_radius(bits: int, similarity: float, missed: float) -> int:
    """The least distance that at most the share `missed` of pairs at the similarity exceeds."""
    p, held = bit_share(similarity), 0.0
    for r in range(bits + 1):
        held += math.comb(bits, r) * p**r * (1 - p) ** (bits - r)
        if held >= 1 - missed:
            return r
    return bits


def sketches(documents: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, content, node, size, f0, f1, ..., odd) of every row: hash of the text, hash and size of its shingle set, fingerprints, parities."""
    source = documents.select(key, F.xxhash64(text).alias("content"), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size = np.zeros(batch.num_rows, dtype=np.uint64), np.zeros(batch.num_rows, dtype=np.int32)
            parts, odd = np.zeros((PARTS, batch.num_rows), dtype=np.uint64), []
            for n, value in enumerate(batch.column(2)):
                hashes = shingle_set(value.as_py(), shingle)
                odd.append(parities(hashes))
                if len(hashes):
                    node[n], size[n], parts[:, n] = xxhash.xxh64_intdigest(hashes.tobytes(), SEED), len(hashes), wide_fingerprint(hashes)
            made = [pa.array(x.view(np.int64)) for x in (node, *parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made[0], pa.array(size), *made[1:], pa.array(odd, pa.binary())], names=names)

    names = [key, "content", "node", "size", *(f"f{n}" for n in range(PARTS)), "odd"]
    longs = ", ".join(f"f{n} long" for n in range(PARTS))
    return source.mapInArrow(tidy(run), f"{key} {dict(source.dtypes)[key]}, content long, node long, size int, {longs}, odd binary")


def closest_rows(a: dict, b: dict | None, radius: int, wide: int, similarity: float, width: int, tile: int = 256) -> tuple:
    """Positions i, j and distances of candidates of different components, the `width` + 1 closest of each row of a.

    a and b hold the arrays component, size, prints (rows x PARTS, uint64), odd (parities) and ones, the population
    counts of the first part, by which they are sorted: tile pairs whose counts differ beyond the radius are skipped.
    A candidate pair differs in at most `radius` bits of the first part and `wide` bits in all, and its sizes and
    parities allow the similarity. b None: inside a, i < j.
    """

    def allowed(u, v):
        """Pairs whose parities differ in no more bits than sets of the similarity differ in elements."""
        most = (1 - similarity) / (1 + similarity) * (a["size"][u].astype(np.int64) + b["size"][v]) + 1e-6
        out = np.zeros(len(u), dtype=bool)
        for at in range(0, len(u), 1 << 13):  # bounded memory
            some = slice(at, at + (1 << 13))
            out[some] = np.bitwise_count(a["odd"][u[some]] ^ b["odd"][v[some]]).sum(axis=1, dtype=np.int64) <= most[some]
        return out

    def nearest(found):
        u, v, d = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((v, d, u))
        u, v, d = u[order], v[order], d[order]
        kept = np.arange(len(u)) - np.searchsorted(u, u) <= width
        return u[kept], v[kept], d[kept]

    inside, b = b is None, a if b is None else b
    none = np.zeros(0, dtype=np.int64)
    out = [(none, none, none)]
    for start in range(0, len(a["size"]), tile):
        found, held = [(none, none, none)], 0
        first, own, mine = a["prints"][start:start + tile, :1], a["component"][start:start + tile], a["ones"][start:start + tile]
        for at in range(start if inside else 0, len(b["size"]), 4 * tile):
            other, ones = b["component"][at:at + 4 * tile], b["ones"][at:at + 4 * tile]
            if ones[0] - mine[-1] > radius or mine[0] - ones[-1] > radius:
                continue  # fingerprints whose population counts differ by more differ in more bits
            if own[0] == other[0] and (own == own[0]).all() and (other == own[0]).all():
                continue
            u, v = np.nonzero(np.bitwise_count(first ^ b["prints"][None, at:at + 4 * tile, 0]) <= radius)
            low, high = np.sort(np.stack([a["size"][start + u], b["size"][at + v]]), axis=0)
            kept = (own[u] != other[v]) & (low >= similarity * high - 1e-9)
            u, v = start + u[kept], at + v[kept]
            if inside:
                u, v = u[u < v], v[u < v]
            d = np.bitwise_count(a["prints"][u] ^ b["prints"][v]).sum(axis=1, dtype=np.int64)
            u, v, d = u[d <= wide], v[d <= wide], d[d <= wide]
            kept = allowed(u, v)
            found.append((u[kept], v[kept], d[kept]))
            held += len(found[-1][0])
            if held > 1 << 19:
                found = [nearest(found)]
                held = len(found[0][0])
        out.append(nearest(found))
    return tuple(np.concatenate(x) for x in zip(*out))


def closest_nodes(nodes: DataFrame, radius: int, wide: int, similarity: float, width: int, block_rows: int) -> DataFrame:
    """(a, b, rank): for every node its closest candidates of other components, `width` + 1 at most.

    Sizes that differ by more than the similarity allows lie more than one level apart and never meet.
    """
    step = 1.001 * math.log(1 / similarity)
    leveled = nodes.filter("size > 0").withColumn("level", F.floor(F.log("size") / step).cast("int"))
    # A level for each factor of size, so this little table is bounded.
    blocks = {int(r["level"]): -(-int(r["count"]) // block_rows) for r in leveled.groupBy("level").count().collect()}
    if not blocks:
        return nodes.sparkSession.createDataFrame([], "a long, b long, rank int")
    number = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])
    placed = leveled.withColumn("block", F.pmod(F.xxhash64("node"), number[F.col("level")]).cast("int"))
    partner = F.explode(
        F.flatten(
            F.transform(
                F.array(F.lit(-1), F.lit(0), F.lit(1)),
                lambda d: F.transform(
                    F.when(F.try_element_at(number, F.col("level") + d).isNotNull(), F.sequence(F.lit(0), F.try_element_at(number, F.col("level") + d) - 1))
                    .otherwise(F.array().cast("array<int>")),
                    lambda k: F.struct((F.col("level") + d).alias("level"), k.alias("block")),
                ),
            )
        )
    )
    own = F.struct(F.col("level").alias("level"), F.col("block").alias("block"))
    columns = ["node", "component", "size", *(f"f{n}" for n in range(PARTS)), "odd"]
    sent = placed.withColumn("other", partner).select(
        *columns, F.least(own, F.col("other")).alias("low"), F.greatest(own, F.col("other")).alias("high"), (own <= F.col("other")).alias("first")
    ).select(*columns, "low.level", "low.block", F.col("high.level").alias("level2"), F.col("high.block").alias("block2"), "first")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows["ones"] = np.bitwise_count(rows["f0"].to_numpy(dtype=np.int64).view(np.uint64)).astype(np.int64)
        rows = rows.sort_values(["ones", "component", "node"])
        first = rows["first"].to_numpy(dtype=bool)
        sides, shortest = [], min(map(len, rows["odd"]))
        for side in (rows[first], rows[~first]):
            prints = np.stack([side[f"f{n}"].to_numpy(dtype=np.int64) for n in range(PARTS)], axis=1).view(np.uint64)
            sides.append({"component": side["component"].to_numpy(), "size": side["size"].to_numpy(), "prints": prints, "node": side["node"].to_numpy(), "ones": side["ones"].to_numpy(), "odd": folded(side["odd"].tolist(), shortest)})
        inside = key[0] == key[2] and key[1] == key[3]
        x, y = sides[0], None if inside else sides[1]
        i, j, d = closest_rows(x, y, radius, wide, similarity, width)
        return pd.DataFrame({"a": x["node"][i], "b": (y or x)["node"][j], "d": d})

    near = sent.groupBy("level", "block", "level2", "block2").applyInPandas(compare, "a long, b long, d long")
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy("d", "b")))
    return ranked.filter(F.col("rank") <= width + 1).select("a", "b", "rank")


def similar_components(
    documents: DataFrame, nodes: DataFrame, key: str, text: str, shingle: int, similarity: float, recall: float, block_rows: int
) -> DataFrame | None:
    """(id, component) of the nodes that link to another; None if none does.

    A candidate becomes a link if the exact Jaccard similarity of the shingle sets allows it. Each round takes
    the closest candidates of every node outside its component, first one, then more, until no node has more
    than were taken: then every candidate between two components has been checked. A large group of near
    copies is one component after the first rounds, so it gives no square of pairs.
    """
    radius = calibrated_radius(64, similarity, (1 - recall) / 2)
    wide = calibrated_radius(64 * PARTS, similarity, (1 - recall) / 2)
    rows = documents.select(F.col(key).alias("key"), F.xxhash64(text).alias("content"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(x.as_py(), shingle).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "shingles"])

    found, width = None, 1
    while True:
        placed = nodes.withColumn("component", F.col("node")) if found is None else nodes.join(
            found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        near = stage(closest_nodes(placed, radius, wide, similarity, width, block_rows))
        pairs = near.filter(F.col("rank") <= width).select("a", "b")
        touched = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = nodes.join(touched, "node").select("node", F.col("owner.content").alias("content"), F.col("owner.key").alias("first"))
        texts = lookup_join(rows, wanted, "content", "inner", limits=_SETS).filter(F.col("key").eqNullSafe(F.col("first"))).select("node", "text")
        sets = stage(texts.mapInArrow(tidy(run), "node long, shingles array<long>").dropDuplicates(["node"]))
        left = pairs.join(sets.withColumnRenamed("node", "a"), "a")
        other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("other"))
        both = lookup_join(left, other, "b", "inner", limits=_SETS).withColumn("both", F.size(F.array_intersect("shingles", "other")))
        near_enough = F.col("both") >= similarity * (F.size("shingles") + F.size("other") - F.col("both")) - 1e-9
        more = stage(both.filter(near_enough).select("a", "b"))
        links = more if found is None else more.union(found.select("id", "component"))  # a component is a star
        earlier, found = found, stage(connected_components(links))
        done = near.filter(F.col("rank") > width).isEmpty()
        unstage(near, sets, more, earlier)
        release_shuffles(documents.sparkSession)
        if done:
            return found
        width *= 16


def _smallest(documents: DataFrame, key: str, text: str) -> DataFrame:
    """One row per key, by a defined order and combined map-side."""
    rest = [text, *(c for c in documents.columns if c not in (key, text))]
    row = fresh("_row", documents)
    one = documents.groupBy(key).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias(row))
    return one.select(key, *[F.col(f"{row}.`{c}`").alias(c) for c in rest]).select(*documents.columns)


def keep_one(
    documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.995,
    block_rows: int = 32_768,
) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id, with its columns.

    Texts link if the Jaccard similarity of their word shingles is at least `similarity`. Candidates come from
    fingerprints at a radius that a pair at the similarity exceeds with probability 1 - `recall` at most; sets
    are compared exactly before they link. Texts with fewer words than a shingle are one shingle; texts
    without words are copies of each other.

    Rows that repeat that id are copies of one document and are reduced to one row, the one with the smallest text
    (then the smallest other columns); rows without an id cannot be told apart and stay.
    """
    prints = stage(sketches(documents, key, text, shingle))
    nodes = stage(
        prints.groupBy("node").agg(
            F.min(F.struct(F.col(key).alias("key"), "content")).alias("owner"), F.min(key).alias("least"), F.first("size").alias("size"),
            *(F.first(f"f{n}").alias(f"f{n}") for n in range(PARTS)), F.first("odd").alias("odd"),
        )
    )
    groups = similar_components(documents, nodes, key, text, shingle, similarity, recall, block_rows)
    merged = nodes.join(groups.withColumnRenamed("id", "node"), "node", "left").select("least", F.coalesce("component", "node").alias("root"))
    chosen = merged.groupBy("root").agg(F.min("least").alias(key)).filter(F.col(key).isNotNull()).select(key)
    found = stage(prints.join(chosen, key).select(key))
    once = found.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    single = lookup_join(documents, once.filter("_n = 1").select(key), key, "left_semi")
    several = _smallest(lookup_join(documents, once.filter("_n > 1").select(key), key, "left_semi"), key, text)
    return single.unionByName(several).unionByName(documents.filter(F.col(key).isNull())).select(*documents.columns)
