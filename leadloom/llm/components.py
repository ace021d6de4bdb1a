"""Connected components over an edge table, by joins and aggregates alone.

Every node takes the least label among itself and its neighbours, then the label of its label (pointer jumping); rounds go on until no
label changes. Edges and labels are written tables, so that joins on a hub split their hot keys, minima are combined map-side, and
each round starts from files. No node's neighbours are gathered anywhere, and only the number of changes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, join_checked


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), any direction; returns (node, root): the least node that it reaches. Nodes without edges are absent."""
    both = cut(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        # the least root among the neighbours
        near = join_checked(both.select(F.col("b").alias("node"), "a"), labels, ["node"], "inner").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        near = cut(near, "near")
        hooked = cut(join_checked(labels, near, ["node"], "inner").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")), "hooked")
        drop_cut(near)
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        up._cut_path = None
        jumped = cut(join_checked(hooked, up, ["root"], "left").select("node", "was", F.least("root", F.coalesce("up", "root")).alias("root")), "jumped")
        changed = jumped.where("root <> was").limit(1).count()
        drop_cut(labels), drop_cut(hooked)
        labels = jumped.select("node", "root")
        labels._cut_path = jumped._cut_path
        if not changed:
            drop_cut(both)
            return labels
