"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is an aggregation with partial sums and a join that Spark may split, so a node with very many links stays
spread over tasks. Each round is written to the shared folder.

Edge cases: no links give no rows; links of a node to itself and repeated links don't count; null ends are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import Workspace


def _large(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour or itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(moved)


def components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, root) for every node of the links (a, b), root the smallest node of its component; without the roots."""
    edges = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    at, seen = 0, None
    edges = work.write(edges, f"{name}-0")
    while True:
        at += 1
        # After both steps every node has at least one link downwards; one each, and none below, means stars.
        edges = work.write(_small(_large(edges)).where("a != b").distinct(), f"{name}-{at}")
        work.drop(f"{name}-{at - 1}")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.col("a").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
