"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidelog.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over (u, v) with u > v: link each node's neighbours to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select("u", "v")
    least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m"))
    joined = both.join(least, both["u"] == least["c"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    out = out.where("u <> v")
    return out if large else out.distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component: the smallest node reachable.

    Nulls and loops in edges are left out; an empty edge table gives an empty result. A node's neighbourhood is never
    gathered: rounds are partial minima and joins, which the adaptive planner splits where a node is hot. Each round is
    written to the shared folder, where a count and a sum of hashes of its edges are taken on the way. It ends when these stay the same.
    """
    def kept(out: DataFrame, drop: tuple = ()) -> tuple[DataFrame, dict]:
        seen = Observation()
        return written(out.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")), drop), seen.get

    e, before = kept(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct())
    for _ in range(rounds):
        e, now = kept(_star(_star(e, True), False), (e,))
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
