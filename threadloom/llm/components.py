"""Connected components of a graph of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import staged


def spanning_edges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the edges ``a[i] - b[i]`` those of a spanning forest, as an array of two columns."""
    parent: dict[int, int] = {}
    kept = []

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return np.array(kept, np.int64).reshape(-1, 2)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for each node of the long columns ``a`` and ``b``.

    Every round joins each node's edges to the smallest neighbour, so rounds grow with the
    logarithm of the longest chain. Minima combine on the map side before the shuffle and the
    joins are inner ones, so a node with very many edges is no single task. Only a count and
    a check sum of the edges reach the driver. Edges are written to the shared folder.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(tied.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
