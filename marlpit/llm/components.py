"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.shared import drop, stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """nid, label for every node of the links (a, b): label is its component's least node.

    Each step only takes minima per node and joins them back, so a node may
    have any number of neighbours. Stored after each step; ends once a step
    changes nothing, and fails if ``rounds``, of which a component of n nodes
    needs about the logarithm of n, are not enough.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = _mark(edges)
    for turn in range(rounds + 1):
        if not mark[0]:
            break
        if turn == rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        old, edges = edges, stored(small, "links")
        drop(old)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    members = edges.select(F.col("u").alias("nid"), F.col("v").alias("label"))
    return members.unionByName(edges.select(F.col("v").alias("nid"), F.col("v").alias("label")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return row[0], row[1]
