"""Connected components of an edge list, wholly as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.session import durable


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Every neighbour (or every smaller one and the node itself) is tied to the least of a node's neighbourhood."""
    if larger_only:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # The key is taken anew so that both sides are dealt out by it and a large one can be split.
        tied = both.filter("v > u").select(F.col("u").alias("k"), "v").join(least.withColumn("k", F.col("u") + F.lit(0)), "k")
        return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.select(F.col("u").alias("k"), "v").join(least.withColumn("k", F.col("u") + F.lit(0)), "k")
    return (
        tied.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .filter("u <> v")
        .distinct()
    )


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node reachable.

    ``edges`` has long columns u and v in either order; loops and repeated edges do no harm, an empty table
    gives an empty one. Large-star and small-star rounds until nothing changes; each round's edges are
    written to the checkpoint folder. The number of edges never grows, whatever the size of a component.
    """
    now = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
        now = durable(_stars(_stars(now, True), False))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
