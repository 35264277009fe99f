"""Connected components of a link table, by alternating stars; nothing is gathered on the driver but counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b, long): component is the smallest node it reaches.

    Each round points every node at the smallest of its neighbours, first from the larger ones, then from the smaller ones. Rounds grow with the
    logarithm of the longest path. A star's centre may have any number of rows: minima are aggregated before the shuffle and the join is one that
    adaptive execution splits. Loops, repeated and reversed links change nothing; null ends are dropped; an empty table gives an empty result.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = written(small, "links")
        dropped(now, large)
        now = new
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(now.select("v", F.lit(0), F.lit(1)).toDF("x", "up", "low"))
        # stars are done: every node but the centres has one link, and it is to a centre
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up > 1 or (up > 0 and low > 0)").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class Sets:
    """Disjoint sets over 0..n-1 in one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        if i > j:
            i, j = j, i
        self.up[j] = i
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))], np.int64)
