"""Connected components of an edge table, by stars: each round links every node to the least node that it knows of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root) of every node that has an edge in ``edges`` (a, b); root is the component's least node.

    A round is two aggregations and two joins over the edges, each summed in the tasks first; a hub's edges are split by
    Spark's skew join. Each round is written to the shared folder, and the loop ends when the edges no longer change."""
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, before = cut(both, "edges"), None
    for _ in range(most_rounds):
        # large star: each neighbour above a node is linked to the least node of its neighbourhood
        two_way = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = two_way.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = two_way.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each neighbour below a node, and the node, are linked to the least of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = cut(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
