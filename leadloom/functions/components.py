"""Connected components of an edge table by alternating large stars and small stars: only joins and aggregates, no node's neighbours are gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, drop_cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie every neighbour (large: those above the node, small: those below, and the node itself) to the least of the node's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    tied = both.join(least, "a")
    out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), numbers in any direction; (node, root): the least node that each reaches, itself included. Nodes without edges are absent.

    A round halves the depth of what is not yet a star, so that a chain of n nodes takes about log n rounds. Each round is a written table; whether it changed anything is seen from its number of edges and the sum of their ends.
    """
    now = cut(edges.where("a <> b").select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).distinct(), "stars")
    seen = None
    while True:
        print_ = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if print_ == seen:
            break
        seen, before = print_, now
        now = cut(_star(cut_large := cut(_star(before, True), "stars"), False), "stars")
        drop_cut(before, cut_large)
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return cut(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), "components")
