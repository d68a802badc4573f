"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a minimum per node (combined before the shuffle) and a join back; the join's sides are written tables,
so a node with very many edges is split by adaptive execution. Edges stay linear in the input. Lineage is cut by written
tables each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import stored

MOST_ROUNDS = 60


def _star(both: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) rehung to the least node of u's neighbourhood."""
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    hung = both.join(least, "u")
    if large:
        return hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of its component. `edges` has columns u, v."""
    tidy = lambda e: e.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(tidy(edges), "edges")
    for _ in range(MOST_ROUNDS):
        # in a forest of stars with the least node in the middle every node but the middle has one edge, and no middle has one
        twice = edges.groupBy("u").count().filter("count > 1").select("u")
        if twice.union(edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")).isEmpty():
            break
        mirrored = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(tidy(_star(mirrored, True)), "edges")
        edges = stored(tidy(_star(large, False)), "edges")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
