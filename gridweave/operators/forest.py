"""Subtrees of a forest by Euler-tour intervals.

The tour enters every node before its children and all below them, so a subtree is a run of consecutive numbers. A node's number is that of its parent, one more, and the sizes of the
siblings' subtrees before it: sizes are summed upwards and numbers downwards while pointers to ancestors double over written tables, so rounds grow with the logarithm of the depth, and rows are one a node.
A value over each subtree is one over a run of numbers, put together from aligned blocks of 1, 2, 4, ... numbers, of which a run has at most two of each size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .relations import running_sums

#: Numbers that lie in one task when blocks are summed up: 2 ** NEAR.
NEAR = 14


def intervals(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, first, last): the number of each node in the tour, siblings in order of their ids, and that of the last one in its subtree. A parent that is not there counts as none. A cycle is an error."""
    rows = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"))
    known = rows.select(F.col("node").alias("known"))
    rows = materialise(rows.join(known, F.col("up") == F.col("known"), "left").select("node", F.col("known").alias("up")), "rows")
    most = math.log2(max(rows.count(), 1)) + 1  # a chain has no more steps than there are nodes

    def doubled(now: DataFrame, step, label: str) -> DataFrame:
        """Rounds of step(now, rows of where each points) until no row points anywhere."""
        rounds = 0
        while now.where("up is not null").limit(1).count():
            if rounds > most:
                raise ValueError("the parent links hold a cycle")
            now, rounds = materialise(step(now), label), rounds + 1
        return now

    def upwards(now: DataFrame) -> DataFrame:
        """The size of a node's subtree as far as twice the steps down: what is at the end of so many steps adds its own."""
        above = now.where("up is not null").select(F.col("node").alias("a"), F.col("up").alias("a_up"))
        below = now.where("up is not null").groupBy(F.col("up").alias("b")).agg(F.sum("size").alias("more"))
        joined = now.join(above, F.col("up") == F.col("a"), "left").join(below, F.col("node") == F.col("b"), "left")
        return joined.select("node", F.col("a_up").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))

    def downwards(now: DataFrame) -> DataFrame:
        above = now.select(F.col("node").alias("a"), F.col("up").alias("a_up"), F.col("at").alias("a_at"))
        joined = now.join(above, F.col("up") == F.col("a"), "left")
        return joined.select("node", F.col("a_up").alias("up"), (F.col("at") + F.coalesce("a_at", F.lit(0))).alias("at"), "size")

    sizes = doubled(rows.withColumn("size", F.lit(1).cast("bigint")), upwards, "sizes").select("node", "size")
    placed = materialise(rows.join(sizes, "node"), "sizes")
    placed = running_sums(placed, ["up"], ["node"], "size", "before")
    begun = placed.select("node", "up", (F.col("before") + F.when(F.col("up").isNull(), 0).otherwise(1)).cast("bigint").alias("at"), "size")
    tour = doubled(materialise(begun, "tour"), downwards, "tour")
    return tour.select("node", F.col("at").alias("first"), (F.col("at") + F.col("size") - 1).alias("last"))


def over_subtrees(found: DataFrame, values: DataFrame, node: str, totals: dict[str, tuple[str, str]]) -> DataFrame:
    """(node, totals...) over each node and all below it. found: intervals(); values: rows of nodes; totals: {name: (min, max or sum, column of values)}."""
    total = {"min": F.min, "max": F.max, "sum": F.sum}
    placed = found.select("node", "first").join(values.withColumnRenamed(node, "node"), "node")
    levels = max(1, math.ceil(math.log2((found.agg(F.max("first")).first()[0] or 0) + 2)))
    # consecutive numbers meet before they are summed up for the first time, so what is shuffled then is at most two cells a number
    placed = placed.repartition(F.expr(f"shiftright(first, {NEAR})"))
    cells = placed.select(F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"), "first", *{c for _, c in totals.values()})
    cells = cells.groupBy("level", F.expr("shiftright(first, level)").alias("cell")).agg(*(total[f](c).alias(n) for n, (f, c) in totals.items()))
    # at each size, the run's blocks that do not belong to a larger one: at its begin if odd, at its end if the next one is odd
    size = lambda k: F.pow(F.lit(2.0), k)
    low = lambda k: F.ceil(F.col("first") / size(k))
    high = lambda k: F.floor((F.col("last") + 1) / size(k))

    def blocks(k: Column) -> Column:
        begin, end = low(k), high(k)
        here = lambda at, take: F.when((begin < end) & take, F.array(F.struct(k.cast("int").alias("level"), at.alias("cell")))).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>"))
        return F.concat(here(begin, begin % 2 == 1), here(end - 1, end % 2 == 1))

    sizes = F.floor(F.log2(F.col("last") - F.col("first") + 1) + 1e-9).cast("int")  # no block of a run is larger than the run
    runs = found.select("node", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), sizes), blocks))).alias("b")).select("node", "b.level", "b.cell")
    return runs.join(cells, ["level", "cell"]).groupBy("node").agg(*(total[f](n).alias(n) for n, (f, _) in totals.items()))


def subtree_bounds(nodes: DataFrame, boxes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, min_x, max_x, ...): a box around each node's box and all below it; boxes (node, min_x.., max_x..). Nodes without any box get no row. relations.cull() then drops whole subtrees."""
    sides = {f"{f}_{a}": (f, f"{f}_{a}") for a in "xyz" for f in ("min", "max")}
    return over_subtrees(intervals(nodes, node, parent), boxes, node, sides)
