"""Mixing sources to target weights by entropy balancing.

Every document gets a rate of use r between 0 and `limit`. The rates of a source stay as close as possible
(in relative entropy) to one use each, while its words add up to the source's target. The solution is an
exponential tilt, r = min(limit, exp(t * size / scale)), whose t minimises a convex function, the dual: its
slope is "words taken minus target", its curvature a sum over the documents below the limit. Newton's
steps, kept inside a shrinking bracket, find t for all sources at once. Each step is one aggregation over
the histogram (source, size, documents), which is exact and much smaller than the corpus.

Rates become whole copies by error diffusion: from large to small documents, a document takes the
number of copies that keeps the running surplus of words nearest to zero, so the last and smallest
documents leave an error of about half a small document. Oversized sources are cut by a hash of id and
size into groups of bounded expected size that round independently.

Targets: the mix has `share` times all words; sources, ordered by code point with null last, weigh
`weights` in rotation; a target above `limit` times its source is cut there and the excess is shared again
by weight among the others, until none is above.

Defined cases: null text has size 0 and takes 0 words. A null source is a source. Repeated rows are
separate documents and get copies each. A source without words has target 0. An empty table gives an
empty result. Reruns agree: nothing is drawn at random.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import word_count
from tallyloom.operators.staging import stage


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: float = 2.0
) -> DataFrame:
    """(source, docs, source_size, target), one row per source; `sizes` has source, size and docs.

    Sharing the excess again is a water filling: sort the sources by source_size / weight; the first ones
    are full, and the rest divide what is left by weight. Running sums find where filling ends.
    """
    per = sizes.groupBy("source").agg(
        F.sum("docs").alias("docs"), F.sum(F.col("size") * F.col("docs")).alias("source_size")
    )
    by_name = W.orderBy(F.col("source").isNull(), "source")  # windows over one row per source
    rotation = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per.withColumn("weight", rotation[(F.row_number().over(by_name) - 1) % len(weights)])
    ranked = ranked.withColumn("weight", F.when(F.col("source_size") > 0, F.col("weight")).otherwise(0.0))
    ranked = ranked.withColumn("ratio", F.when(F.col("weight") > 0, F.col("source_size") / F.col("weight")))
    all_rows = W.partitionBy()
    fill = W.orderBy(F.col("weight") == 0, "ratio", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    level = (
        ranked.withColumn("total", share * F.sum("source_size").over(all_rows))
        .withColumn("before", limit * F.coalesce(F.sum("source_size").over(fill), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
        .withColumn("level", F.when(F.col("rest") > 1e-9, (F.col("total") - F.col("before")) / F.col("rest")))
        .withColumn("full", F.coalesce(F.col("weight") * F.col("level") > limit * F.col("source_size"), F.lit(False)))
    )
    # The level that holds is that of the first source in filling order that is not full.
    place = F.struct("ratio", F.col("source").isNull(), "source")
    first_open = F.min_by("level", F.when(~F.col("full") & (F.col("weight") > 0), place)).over(all_rows)
    return level.withColumn("open", first_open).select(
        "source", "docs", "source_size",
        F.when(F.col("full") | F.col("open").isNull(), limit * F.col("source_size"))
        .otherwise(F.least(F.col("weight") * F.col("open"), limit * F.col("source_size"))).cast("double").alias("target"),
    )


def solve_tilts(sizes: DataFrame, targets: DataFrame, limit: float = 2.0, steps: int = 60, tolerance: float = 1e-4) -> DataFrame:
    """(source, tilt, scale): Newton's method on the dual of every source, one aggregation per step.

    The bracket holds the solution: t = log(limit) * scale / smallest size gives every document the limit,
    a t of minus 700 scales gives nearly nothing. A step that leaves the bracket is replaced by its middle.
    """
    smallest = sizes.filter("size > 0").groupBy("source").agg(F.min("size").alias("smallest"))
    state = stage(
        targets.join(smallest, targets["source"].eqNullSafe(smallest["source"]), "left").select(
            targets["source"], "target", "source_size", (F.col("source_size") / F.greatest("docs", F.lit(1))).alias("scale"), "smallest"
        ).select(
            "source", "target", "source_size", "scale", F.lit(0.0).alias("tilt"), F.lit(-700.0).alias("low"),
            (np.log(limit) * F.greatest(F.col("scale"), F.lit(1e-9)) / F.coalesce("smallest", F.lit(1)) + 1).alias("high"),
            F.lit(False).alias("done"),
        )
    )
    for _ in range(steps):
        tilts = state.filter("NOT done")
        x = F.col("size") / F.col("scale")
        rate = F.exp(F.least(F.col("tilt") * x, F.lit(float(np.log(limit)))))
        below = F.col("tilt") * x < float(np.log(limit))
        moments = (
            sizes.filter("size > 0").join(tilts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("source")
            .agg(
                F.sum(F.col("docs") * rate * F.col("size")).alias("taken"),
                F.sum(F.when(below, F.col("docs") * rate * F.col("size") * x).otherwise(0.0)).alias("slope"),
            )
        )
        miss = F.coalesce(F.col("taken"), F.lit(0.0)) - F.col("target")
        low, high = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low")), F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - miss / F.when(F.col("slope") > 0, F.col("slope"))
        inside = newton.isNotNull() & (newton > low) & (newton < high)
        done = F.abs(miss) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))
        state = stage(
            state.join(moments.withColumnRenamed("source", "m"), F.col("source").eqNullSafe(F.col("m")), "left").select(
                "source", "target", "source_size", "scale",
                F.when(F.col("done") | done, F.col("tilt")).when(inside, newton).otherwise((low + high) / 2).alias("tilt"),
                low.alias("low"), high.alias("high"), (F.col("done") | done).alias("done"),
            )
        )
        if state.filter("NOT done").isEmpty():
            break
    return state.select("source", "tilt", "scale")


def round_copies(size: np.ndarray, rate: np.ndarray, limit: int) -> np.ndarray:
    """Whole copies of documents in the given order, diffusing the error of words from one to the next."""
    copies = np.zeros(len(size), dtype=np.int64)
    surplus = 0.0
    for i, (s, r) in enumerate(zip(size.tolist(), rate.tolist())):
        if s > 0:
            wanted = (r * s - surplus) / s
            c = min(max(round(wanted), 0), limit)
            copies[i] = c
            surplus += (c - r) * s
    return copies


def balance(
    documents: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: int = 2, key: str = "doc_id",
    text: str = "text", source: str = "source", group_rows: int = 2_048,
) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken) of every document."""
    rows = stage(documents.select(F.col(key).alias("id"), F.col(source).alias("source"), word_count(text).alias("size")))
    sizes = stage(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")))
    targets = stage(source_targets(sizes, weights, share, float(limit)))
    tilts = solve_tilts(sizes, targets, float(limit))
    known = targets.join(tilts.withColumnRenamed("source", "s"), targets["source"].eqNullSafe(F.col("s")), "left").drop("s")
    known = known.withColumn("parts", F.ceil(F.col("docs") / group_rows)).withColumnRenamed("source", "known")
    full = F.col("target") >= limit * F.col("source_size") * (1 - 1e-12)
    x = F.when(F.col("scale") > 0, F.col("size") / F.col("scale")).otherwise(0.0)
    rate = F.when(full, F.lit(float(limit))).otherwise(F.exp(F.least(F.col("tilt") * x, F.lit(float(np.log(limit))))))
    rated = rows.join(known, rows["source"].eqNullSafe(known["known"])).select(
        "id", "source", "size", "source_size", "target", rate.alias("rate"),
        F.pmod(F.xxhash64("id", "size"), F.col("parts")).alias("part"),
    )

    def copy(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, sort_keys=[("size", "descending"), ("id", "ascending")]))
        size = group["size"].to_numpy()
        copies = round_copies(size, group["rate"].to_numpy(), limit)
        kept = group.select(["id", "source", "size", "source_size", "target"])
        return kept.append_column("copies", pa.array(copies)).append_column("taken", pa.array(copies * size))

    kind = dict(rows.dtypes)
    out = rated.groupBy("source", "part").applyInArrow(
        copy, f"id {kind['id']}, source {kind['source']}, size long, source_size long, target double, copies long, taken long"
    )
    return out.select(F.col("id").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies", "taken")


def mix(documents: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: int = 2, key: str = "doc_id",
        text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus: the documents' columns, each document repeated by its copies.

    Documents that share an id are told apart by source and size; among equal ones the copies are pooled
    and spread evenly. Documents without words are left out, as they add nothing to any target.
    """
    used = balance(documents, weights, share, limit, key, text, source)
    used = used.groupBy(key, source, "size").agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    used = used.filter(F.col("__copies") > 0).select(
        F.col(key).alias("__id"), F.col(source).alias("__source"), F.col("size").alias("__size"), "__copies", "__rows"
    )
    sized = documents.withColumn("__words", word_count(text))
    same = sized[key].eqNullSafe(F.col("__id")) & sized[source].eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size"))
    joined = sized.join(used, same)
    single = joined.filter(F.col("__rows") == 1).withColumn("__n", F.col("__copies"))
    place = F.row_number().over(W.partitionBy("__id", "__source", "__size").orderBy(text))
    several = joined.filter(F.col("__rows") > 1).withColumn("__place", place).withColumn(
        "__n", F.floor(F.col("__copies") / F.col("__rows")) + (F.col("__place") <= F.col("__copies") % F.col("__rows")).cast("long")
    ).drop("__place")
    repeated = single.unionByName(several).filter(F.col("__n") > 0)
    return repeated.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*documents.columns)
