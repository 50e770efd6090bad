"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


class Forest:
    """Union-find over integers."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (y := up.get(r, r)) != r:
            r = y
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def thinned(links: DataFrame) -> DataFrame:
    """The links a, b without those that close a cycle within a task, which reach nothing new."""

    def thin(batches):
        forest = Forest()
        for b in batches:
            a, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            keep = [forest.join(x, y) for x, y in zip(a.tolist(), c.tolist())]
            if len(forest.up) > 1_000_000:
                forest = Forest()
            yield b.filter(pa.array(np.array(keep, bool)))

    return links.mapInArrow(thin, "a long, b long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component for every node in links (a long, b long); component is the least node reachable.

    Each round is two aggregations by node and their joins, written to the shared folder; hot nodes are pre-aggregated
    and their joins split by Spark's skew join. The rounds grow with the logarithm of the longest path; RuntimeError if
    `most_rounds` don't suffice.
    """
    edges = stored(thinned(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
        large = both.join(least, both["a"] == least["u"]).filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = large.join(least, large["a"] == least["u"])
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        edges = stored(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
