"""Connected components of an undirected graph, given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.common import delete, written


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        """The root of x."""
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def union(self, a: int, b: int) -> bool:
        """Join two trees; False if they were one."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each partition's edges as stars (node, smallest node of its tree)."""
    f = Forest()
    for b in batches:
        for u, v in zip(b["u"].tolist(), b["v"].tolist()):
            f.union(u, v)
    nodes = [x for x in f.up if f.find(x) != x]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pd.DataFrame({"u": part, "v": [f.find(x) for x in part]})


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (columns u, v: long); root is the smallest id.

    Alternating large-star and small-star steps (O(log^2) rounds whatever the diameter), each step
    one shuffle on a node; trees are contracted inside partitions first, so that chains and cliques
    shrink to stars before anything is shuffled. Lineage is cut after each round by a written table.
    Edges with a null end and loops join nothing; a node that has only such edges has no row.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = written(e.mapInPandas(_stars, "u long, v long"), "stars")
    w = Window.partitionBy("u")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least(F.min("v").over(w), F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.where("u <> v").withColumn("m", F.min("v").over(w))
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v")
        new = written(small.distinct(), "stars")
        # every node in one star, whose centre is in no other: the fixed point
        same = new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").isEmpty()
        delete(e)
        e = new
        if same:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
