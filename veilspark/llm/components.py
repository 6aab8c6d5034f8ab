"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import cut, give_back

#: Links up to which one task joins them (16 bytes each); more of them go through the rounds.
FEW = 1 << 19


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of all links: of the roots at a link's ends the greater one goes below the lesser, until no link has two."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    x, y, root = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while len(x):
        a, b = root[x], root[y]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    for s in range(0, len(ids), 1 << 16):
        yield pa.record_batch([pa.array(ids[s : s + (1 << 16)]), pa.array(ids[root[s : s + (1 << 16)]])], ["node", "label"])
    give_back()


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # the small star drops repeats


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Is every node below one other at most, and above none if it is? Then each component is a star around its least node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("below")), F.struct(F.col("v").alias("node"), F.lit(0).alias("below")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.count("*").alias("n")).where("below > 0 and n > 1").agg(F.count("*")).first()[0] == 0


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``links(a, b)``, label being the least node reachable; nulls and loops are ignored.

    Each round is two aggregations with partial sums and two joins on node ids; a node with a third of all links
    only meets a pre-aggregated minimum, and adaptive execution splits its side of the join. Rounds end in a
    checkpoint, and their number follows the logarithm of the longest path. Empty links give an empty table. Up to FEW
    links need no rounds: one task joins them.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = cut(edges)
    if {t for _, t in edges.dtypes} == {"bigint"} and edges.count() <= FEW:
        return cut(edges.coalesce(1).mapInArrow(_joined, "node long, label long"))
    for _ in range(max_rounds):
        edges = cut(_small_star(_large_star(edges)))
        if _settled(edges):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
