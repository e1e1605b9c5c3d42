"""Joins, lookups and windows over catalogs, snapshots, atlases, keyframes and scene graphs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..scratch import materialise


def changes(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """(key, state): same, changed, missing (only old) or added (only new)."""
    a, b = old.select(key, F.col(stamp).alias("__a"), F.lit(1).alias("__o")), new.select(key, F.col(stamp).alias("__b"), F.lit(1).alias("__n"))
    state = F.when(F.col("__n").isNull(), "missing").when(F.col("__o").isNull(), "added").when(F.col("__a").eqNullSafe(F.col("__b")), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, state.alias("state"))


def stale(sources: DataFrame, outputs: DataFrame, key: str, stamp: str) -> DataFrame:
    """Sources without a newer output."""
    done = outputs.select(F.col(key).alias("__k"), F.col(stamp).alias("__t"))
    return sources.join(done, (F.col(key) == F.col("__k")) & (F.col("__t") > F.col(stamp)), "left_anti")


def point_in_rectangle(points: DataFrame, rectangles: DataFrame, cells: int = 16) -> DataFrame:
    """First rectangle (by ordinal) that holds each point, edges included; coordinates in 0..1.

    points (point_id, u, v), rectangles (name, ordinal, x, y, w, h). Both sides are dealt to a grid of cells, so this is an equi-join.
    """
    cell = lambda c: F.least(F.greatest(F.floor(c * cells), F.lit(0)), F.lit(cells - 1))
    r = rectangles.withColumn("cu", F.explode(F.sequence(cell(F.col("x")), cell(F.col("x") + F.col("w")))))
    r = r.withColumn("cv", F.explode(F.sequence(cell(F.col("y")), cell(F.col("y") + F.col("h")))))
    p = points.withColumn("cu", cell(F.col("u"))).withColumn("cv", cell(F.col("v")))
    inside = (F.col("u") >= F.col("x")) & (F.col("u") <= F.col("x") + F.col("w")) & (F.col("v") >= F.col("y")) & (F.col("v") <= F.col("y") + F.col("h"))
    return p.join(r, ["cu", "cv"]).where(inside).groupBy("point_id").agg(F.min_by("name", "ordinal").alias("name"))


def ranked_candidates(rows: DataFrame, names: DataFrame, candidates: Column, key: str, name: str) -> DataFrame:
    """First candidate, in order, that exists among names."""
    tried = rows.select(key, F.posexplode(candidates).alias("__rank", name))
    return tried.join(names.select(name).distinct(), name).groupBy(key).agg(F.min_by(name, "__rank").alias("found"))


def between_keys(queries: DataFrame, keys: DataFrame, channel: str, width: float) -> DataFrame:
    """As-of with interpolation: queries (channel, t), keys (channel, ts, value). Times outside the keys are skipped.

    Keys are intervals to the next key and are dealt to time buckets of `width` by their start. A query meets those that start in its own bucket and the one
    that reaches into it from before, found from one row a bucket that holds anything. So this is an equi-join, and a long gap costs one row.
    """
    w = Window.partitionBy(channel).orderBy("ts")
    spans = keys.withColumn("next_ts", F.lead("ts").over(w)).withColumn("next_value", F.lead("value").over(w)).withColumn("first", F.row_number().over(w) == 1)
    bucket = lambda c: F.floor(c / width)
    span = F.struct("ts", "value", "next_ts", "next_value", "first")
    spans = spans.select(channel, bucket(F.col("ts")).alias("b"), span.alias("s"))
    q = queries.select(channel, "t", bucket(F.col("t")).alias("b"))
    held = spans.groupBy(channel, "b").agg(F.max("s").alias("last"))  # the struct's first field is ts
    every = held.unionByName(q.select(channel, "b", F.lit(None).cast(held.schema["last"].dataType).alias("last")).distinct()).groupBy(channel, "b").agg(F.max("last").alias("last"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy(channel).orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    reaching = every.select(channel, "b", before.alias("s")).where("s is not null")
    met = q.join(spans.unionByName(reaching), [channel, "b"]).select(channel, "t", "s.*")
    # a key's own time belongs to the span that it ends, but for the first key
    holds = ((F.col("t") > F.col("ts")) & (F.col("t") <= F.col("next_ts"))) | (F.col("first") & (F.col("t") == F.col("ts")))
    share = F.coalesce(F.try_divide((F.col("t") - F.col("ts")).cast("double"), (F.col("next_ts") - F.col("ts")).cast("double")), F.lit(0.0))
    value = F.col("value") + (F.coalesce("next_value", "value") - F.col("value")) * share
    return met.where(holds).select(channel, "t", value.alias("value"))


def first_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def steps(rows: DataFrame, group: list[str], order: list[str], name: str, circular: bool) -> DataFrame:
    """Adds previous and next of `name`; at the ends the row itself, or the other end."""
    w = Window.partitionBy(*group).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = (F.last(name).over(whole), F.first(name).over(whole)) if circular else (F.col(name), F.col(name))
    return rows.withColumn("previous", F.coalesce(F.lag(name).over(w), ends[0])).withColumn("next", F.coalesce(F.lead(name).over(w), ends[1]))


def ancestors(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, ancestor, steps) along parent links, over written tables; neither rows nor depth have a cap. A cycle is an error.

    Round k knows all walks of at most 2^k steps, and those of exactly 2^k as pointers. Following a pointer from the end of each
    known walk gives the walks of up to twice the steps, each once, so rounds grow with the logarithm of the depth.
    """
    links = nodes.select(F.col(node).alias("node"), F.col(parent).alias("ancestor")).where("ancestor is not null")
    pointers = materialise(links, "links")
    known, more, reach = pointers.withColumn("steps", F.lit(1)), pointers, 1
    while True:
        if more.where("node = ancestor").limit(1).count():  # every cycle leads a node back to itself
            raise ValueError("the parent links hold a cycle")
        ends = pointers.select(F.col("node").alias("end"), F.col("ancestor").alias("above"))
        more = known.join(ends, F.col("ancestor") == F.col("end")).select("node", F.col("above").alias("ancestor"), (F.col("steps") + reach).alias("steps"))
        more = materialise(more, "walks")
        pointers = more.where(F.col("steps") == 2 * reach).select("node", "ancestor")
        known, reach = known.unionByName(more), 2 * reach
        if not more.limit(1).count():
            return known


def relink(edges: DataFrame, nodes: DataFrame, children: str, node: str) -> DataFrame:
    """(node, child) of an array of child ids; children that do not exist are dropped."""
    pairs = edges.select(node, F.explode(children).alias("child"))
    return pairs.join(nodes.select(F.col(node).alias("child")), "child", "left_semi").select(node, "child")


def cull(boxes: DataFrame, planes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Boxes (box_id, min_x.., max_x..) with a corner on the inner side of every plane (a, b, c, d): at most a few planes, so plain filters."""
    out = boxes
    for a, b, c, d in planes:
        best = F.lit(float(d))
        for k, axis in zip((a, b, c), "xyz", strict=True):
            best = best + F.col(f"{'max' if k > 0 else 'min'}_{axis}") * float(k)
        out = out.where(best > 0)
    return out


def cull_spheres(spheres: DataFrame, planes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Spheres (center_x.., radius) that reach the inner side of every plane (a, b, c, d) of unit normal."""
    out = spheres
    for a, b, c, d in planes:
        out = out.where(F.col("center_x") * float(a) + F.col("center_y") * float(b) + F.col("center_z") * float(c) + float(d) > -F.col("radius"))
    return out


def bounds(points: DataFrame, by: list[str], axes: str = "xyz") -> DataFrame:
    """Bounding boxes with center and radius."""
    box = points.groupBy(*by).agg(*(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))))
    half = [(F.col(f"max_{a}") - F.col(f"min_{a}")) / 2 for a in axes]
    size = half[0] * half[0]
    for h in half[1:]:
        size = size + h * h
    return box.select("*", *(((F.col(f"max_{a}") + F.col(f"min_{a}")) / 2).alias(f"center_{a}") for a in axes), F.sqrt(size).alias("radius"))


def members(rows: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """Rows whose key is among names.name."""
    return rows.join(names.select(F.col(name).alias("__name")), F.col(key) == F.col("__name"), "left_semi")


def not_members(rows: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """Rows whose key is not among names.name; a null key stays."""
    return rows.join(names.select(F.col(name).alias("__name")), F.col(key) == F.col("__name"), "left_anti")


def changes_to_next(rows: DataFrame, group: list[str], order: list[str], column: str, out: str) -> DataFrame:
    """Adds whether the next row of the group has another value in `column`; false at the end."""
    following = F.lead(column).over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn(out, F.coalesce(following != F.col(column), F.lit(False)))


def row_ordinals(rows: DataFrame, group: list[str], order: list[str], out: str = "ordinal") -> DataFrame:
    """Adds the place of each row in its group, from 0."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def ordinals(rows: DataFrame, order: list[str], out: str = "ordinal") -> DataFrame:
    """Adds the place of each row in the whole order, from 0, without bringing all rows to one task: rows are range-partitioned and
    written, partitions are counted (one row each), and each numbers its own rows from where those before it end. Equal rows are numbered as they come.
    """
    held = materialise(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return held.join(F.broadcast(starts), "__part").withColumn(out, (F.col("__start") + inside - 1).cast("bigint")).drop("__part", "__start")


#: Rows of a group up to which one task sums them up.
SPREAD = 1_000_000


def running_sums(rows: DataFrame, group: list[str], order: list[str], value: str, out: str, most: int = SPREAD) -> DataFrame:
    """Adds the sum of `value` over the rows before each row in its group, 0 at the first. Null groups are a group.

    Where no group has more than `most` rows, a window does it. Otherwise rows are range-partitioned by (group, order) and written; each partition sums up its own rows of a group,
    and starts from the totals of the partitions before: one row for each group in a partition. So a group of any size is spread, and ties of the order stay together.
    """
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    largest = rows.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= most:
        return rows.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
    held = materialise(rows.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy("__part", *group).agg(F.sum(value).alias("n"))
    starts = totals.select(F.col("__part").alias("__p"), *(F.col(c).alias(f"__g{i}") for i, c in enumerate(group)), F.sum("n").over(earlier).alias("__start"))
    inside = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = held.withColumn("__own", F.sum(value).over(inside))
    same = [F.col("__part") == F.col("__p"), *(F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group))]
    joined = summed.join(starts, same)
    return joined.select(*rows.columns, (F.coalesce("__start", F.lit(0)) + F.coalesce("__own", F.lit(0))).alias(out))


def counted(rows: DataFrame, conditions: dict[str, Column], write) -> dict[str, int]:
    """Writes rows with write(rows), and returns how many met each condition: counters are observed in the pass that writes, so nothing is scanned for them."""
    seen = Observation()
    write(rows.observe(seen, *(F.count_if(c).alias(k) for k, c in conditions.items())))
    return {k: int(n) for k, n in seen.get.items()}


def shares(rows: DataFrame, group: list[str], value: str, out: str = "share") -> DataFrame:
    """Adds value / its group's total; totals are aggregated, then joined, so no group meets in one task but for the join's rows."""
    totals = rows.groupBy(*group).agg(F.sum(value).alias("__total"))
    return rows.join(totals, group).withColumn(out, F.try_divide(F.col(value), F.col("__total"))).drop("__total")


def append(parts: list[DataFrame]) -> DataFrame:
    """Union of all rows, by column names; columns that a part lacks are null there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def distinct_by(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of all rows with one row of each key."""
    return append(parts).dropDuplicates(key)


def counters(rows: DataFrame, by: list[str], conditions: dict[str, Column]) -> DataFrame:
    """How many rows of each group meet each condition."""
    return rows.groupBy(*by).agg(*(F.count_if(c).alias(k) for k, c in conditions.items()))


def failures(rows: DataFrame, code: str) -> DataFrame:
    """(failed): the sum of return codes of all jobs; 0 without jobs."""
    return rows.agg(F.coalesce(F.sum(code), F.lit(0)).cast("bigint").alias("failed"))


def slower_than(rows: DataFrame, elapsed: str, limit: float) -> DataFrame:
    return rows.where(F.col(elapsed) > limit)


def extent(rows: DataFrame, value: str, scale_to: float) -> DataFrame:
    """(largest, n, scale): chart parameters; scale is null without rows."""
    return rows.agg(F.max(value).alias("largest"), F.count("*").alias("n"), F.try_divide(F.lit(float(scale_to)), F.max(value)).alias("scale"))


def bar_positions(rows: DataFrame, start: str, size: str, scale: float) -> DataFrame:
    """Adds x0 and x1, the whole pixels of stacked bars."""
    at = lambda c: F.floor(c * scale).cast("int")
    return rows.withColumns({"x0": at(F.col(start)), "x1": at(F.col(start) + F.col(size))})


def counterparts(files: DataFrame, group: list[str], order: str, stem: str) -> DataFrame:
    """Adds counterpart: the next file, in circular order, if it has the same stem, else the one before, else null."""
    w = Window.partitionBy(*group).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def other(move, end):
        found = F.coalesce(move(F.struct(order, stem)).over(w), end(F.struct(order, stem)).over(whole))
        return F.when((found[stem] == F.col(stem)) & (found[order] != F.col(order)), found[order])

    return files.withColumn("counterpart", F.coalesce(other(F.lead, F.first), other(F.lag, F.last)))


def global_transforms(nodes: DataFrame, node: str, parent: str, matrix: str, n: int = 4) -> DataFrame:
    """(node, transform): product of the matrices from the root down to each node. A cycle is an error.

    Pointers double: each round multiplies a node's product by that of the node it points to and points to that one's target, over
    written tables, so rounds grow with the logarithm of the depth.
    """
    now = materialise(nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"), F.col(matrix).alias("m")), "transforms")
    rounds, most = 0, math.log2(max(now.count(), 1)) + 1  # a chain has no more steps than there are nodes
    while now.where("up is not null").limit(1).count():
        if rounds > most:
            raise ValueError("the parent links hold a cycle")
        above = now.select(F.col("node").alias("a"), F.col("up").alias("a_up"), F.col("m").alias("a_m"))
        joined = now.join(above, F.col("up") == F.col("a"), "left")
        now = materialise(joined.select("node", F.col("a_up").alias("up"), F.when(F.col("a_m").isNull(), F.col("m")).otherwise(vectors.multiply(F.col("a_m"), F.col("m"), n)).alias("m")), "transforms")
        rounds += 1
    return now.select("node", F.col("m").alias("transform"))


def world_boxes(boxes: DataFrame, transforms: DataFrame, node: str) -> DataFrame:
    """(node, min_x.., max_x..): the box around each box's eight corners after its node's transform, 4 x 4."""
    corners = F.array(*(F.array(*(F.col(f"{'max' if k >> i & 1 else 'min'}_{a}") for i, a in enumerate("xyz")), F.lit(1.0)) for k in range(8)))
    moved = boxes.join(transforms.withColumnRenamed("node", "__node"), F.col(node) == F.col("__node")).select(F.col(node).alias("node"), F.transform(corners, lambda p: vectors.apply(F.col("transform"), p, 4)).alias("q"))
    side = lambda f, i: f(F.transform("q", lambda p: F.element_at(p, i + 1)))
    return moved.select("node", *(side(f, i).alias(f"{n}_{a}") for i, a in enumerate("xyz") for n, f in (("min", F.array_min), ("max", F.array_max))))


def scene_bounds(boxes: DataFrame, transforms: DataFrame, node: str) -> DataFrame:
    """Box around all transformed corners of the boxes (node, min_x.., max_x..) of a scene; transforms (node, transform), 4 x 4. Empty scenes give nulls."""
    corners = F.array(*(F.array(*(F.col(f"{'max' if k >> i & 1 else 'min'}_{a}") for i, a in enumerate("xyz")), F.lit(1.0)) for k in range(8)))
    points = boxes.join(transforms.withColumnRenamed("node", "__node"), F.col(node) == F.col("__node")).select("transform", F.explode(corners).alias("p"))
    moved = points.select(vectors.apply(F.col("transform"), F.col("p"), 4).alias("q"))
    return moved.agg(*(f(F.element_at("q", i + 1)).alias(f"{n}_{a}") for i, a in enumerate("xyz") for n, f in (("min", F.min), ("max", F.max))))
