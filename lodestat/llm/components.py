"""Connected components of a graph whose edges lie in a table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge to another one, for edges (a, b) of whole numbers in any direction; root is the
    smallest node that can be reached. Loops and repeated edges are of no consequence.

    A large star ties every neighbour above a node to the smallest neighbour, a small star does so for those below; both keep
    components as they are, and the edges end as one star each. Minima are taken by aggregation before the join back, so that a node
    with very many neighbours is no single task's work. Each round is written to the shared folder.
    """
    at = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(at)
    while True:
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        at = stage(tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        new = _mark(at)
        if new == mark:
            break
        mark = new
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Edges' number and sums of their hashes: equal for equal sets."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(row)
