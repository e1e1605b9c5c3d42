"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise
from .heavy import lookup


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) long -> (node, comp): comp is the smallest node reachable; nodes without edges don't occur.

    Each round, every tree takes the smallest label that any of its nodes sees, then follows two pointers; trees
    merge with their smallest neighbour, so rounds grow with the logarithm of the longest chain. All groupings
    combine on the map side, and both joins spread their heavy keys: the edges of a hub, and the nodes of a giant component.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    while True:
        seen = lookup(both, labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("seen"))
        own = labels.join(seen, F.col("node") == F.col("a")).select("node", "comp", F.least("comp", "seen").alias("low"))
        # a label may be a node that has its own, smaller label by now
        roots = own.select(F.col("comp").alias("root"), "low").union(own.select("node", "low")).groupBy("root").agg(F.min("low").alias("up"))
        roots = materialise(roots, "roots")
        jump = roots.alias("x").join(roots.alias("y"), F.col("x.up") == F.col("y.root"), "left").select(F.col("x.root").alias("comp"), F.least("x.up", F.coalesce("y.up", "x.up")).alias("up"))
        moved = materialise(lookup(labels, jump, "comp", "left").select("node", F.least("comp", F.coalesce("up", "comp")).alias("next"), "comp"), "labels")
        changed = moved.where("next <> comp").limit(1).count()
        labels = moved.select("node", F.col("next").alias("comp"))
        if not changed:
            return labels
