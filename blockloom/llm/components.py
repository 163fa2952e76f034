"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, split_join, stored


def _stars(edges: DataFrame, small: bool, n: int) -> DataFrame:
    """One step on edges (u, v) with u > v. Each node's minimum comes from a map-side combined aggregate, joined back.

    n: the number of edges. The minima of hubs go to all tasks: no task gets all the edges of one node.
    """
    if small:
        around = edges  # the neighbours below a node; the node itself is above them
        least = around.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        joined = split_join(around, least, ["u"], "degree", n)
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    else:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
        moved = split_join(around.where(F.col("v") > F.col("u")), least, ["u"], "degree", 2 * n).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.where(F.col("a") != F.col("b")).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge; component is the smallest node reachable. edges: (u, v), in any order.

    Loops and repeated edges are ignored, and rows with a null too. Each step is written to the shared
    folder, so lineage stays short; nothing but two numbers comes to the driver.
    """
    now = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = stored(now, "cc-edges"), None
    for _ in range(most_rounds):
        sums = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(sums) == before or not sums["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = tuple(sums)
        last, now = now, stored(_stars(_stars(now, False, sums["n"]), True, sums["n"]), "cc-edges")
        forget(last)
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
