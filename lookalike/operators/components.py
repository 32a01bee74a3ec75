"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round re-hangs neighbours onto the smallest node seen next to them (Kiveris et al. 2014), so the
number of rounds grows with the logarithm of the diameter rather than with the diameter. Every round is
two aggregations and two joins on the node; the edges are cut to a written table between rounds, and only
their number and a checksum, observed as they are written, come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.stage_table import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).where("a <> b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge: the smallest node reachable from it.

    ``edges`` has two columns of one orderable type; direction, loops and repeats don't matter."""
    a, b = edges.columns[:2]
    now = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        seen = Observation()
        rows = _small_star(_large_star(now).distinct()).distinct()
        now = cut(rows.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("sum")))
        if (state := seen.get) == before:
            # all edges now lead from a node to its component's smallest
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
