"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import attach, materialize


def _stars(edges: DataFrame, n: int, large: bool) -> DataFrame:
    """One step over edges (a, b).

    Large star: each node links its larger neighbours to the smallest node it sees. Small star: each node links its
    smaller neighbours and itself to the smallest of them.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count("*").alias("degree"))
    seen = attach(both, least, ["a"], "degree", n)
    if large:
        out = seen.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = seen.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node in edges (a, b), where component is the smallest node that links reach.

    Loops and repeated edges are harmless; nodes without other nodes are left out, and no edges give no rows. Each
    round is written to the shared folder, so the work neither repeats nor depends on any one executor.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        n = now.count()
        new = materialize(_stars(materialize(_stars(now, 2 * n, True)), n, False))
        if new.count() == n and new.exceptAll(now).isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        now = new


def clusters(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric boolean matrix the first node of its component."""
    n = len(linked)
    first = np.arange(n)
    seen = ~linked.any(1)
    for start in range(n):
        if seen[start]:
            continue
        seen[start] = True
        frontier = np.array([start])
        while len(frontier):
            reach = linked[frontier].any(0) & ~seen
            seen |= reach
            first[reach] = start
            frontier = np.flatnonzero(reach)
    return first
