"""Nesting of intervals on tracks by mergeable stacks, and a dictionary of the paths from the outside in.

Intervals of a track stand by start, then longest, then latest id. Those that hold the next one form a stack: an interval takes all shorter-reaching ones off it and goes on top.
What a run of intervals leaves on the stack is a list with falling ends, and two runs, one after the other, leave the first one's intervals that reach as far as
the second one's furthest end, then the second one's list. So stacks of runs merge, and no task needs a whole track, whatever covers it:

1. Rows are range-partitioned once by (track, start, ...), cut into chunks of CHUNK rows, and written: a chunk is one row with its rows inside and the stack that it leaves.
2. The chunks' stacks, a few rows for each chunk, are merged in order of each track: what each chunk inherits.
3. Each chunk is swept from what it inherits. The sweep keeps, with each open interval, what its inner ones will ask for, so a row costs the same at any depth.

A path is the list of an interval's ancestors, as far as they have a step, and goes by a 128-bit name, hashed from the path outside and the step. Rows carry one name
instead of all ancestors; dictionary() has one row for each path, and chains() spells paths out by pointer doubling.
"""

from __future__ import annotations

from hashlib import blake2b

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise

#: Rows of a chunk, and rows of it that a sweep has in hand.
CHUNK, SLICE = 50_000, 5_000

_OPEN = [("end", pa.int64()), ("id", pa.int64()), ("step", pa.string()), ("marks", pa.list_(pa.bool_())), ("keys", pa.list_(pa.string()))]
_OPEN_DDL = "array<struct<end:bigint,id:bigint,step:string,marks:array<boolean>,keys:array<string>>>"


class Shape:
    """Places of the columns in a chunk: tracks, then what the caller keeps, then id, end, step, marks and keys."""

    def __init__(self, tracks: int, kept: int, marks: int, keys: int):
        self.tracks, self.kept = tracks, kept
        self.id, self.end, self.step = kept, kept + 1, kept + 2
        self.marks = range(kept + 3, kept + 3 + marks)
        self.keys = range(kept + 3 + marks, kept + 3 + marks + keys)


def _groups(table: pa.Table, tracks: int) -> list[tuple]:
    return list(zip(*(table.column(k).to_pylist() for k in range(tracks)), strict=True)) if tracks else [()] * len(table)


def _left_open(table: pa.Table, shape: Shape, first: int) -> tuple[list[dict], int | None]:
    """What the rows from `first` on leave on the stack, outermost first, and their furthest end."""
    ends, most, places = table.column(shape.end).to_pylist(), None, []
    for k in range(len(ends) - 1, first - 1, -1):
        if ends[k] is not None and (most is None or ends[k] >= most):
            most = ends[k]
            places.append(k)
    rows = table.take(pa.array(places[::-1], pa.int64()))
    ids, held, steps = (rows.column(k).to_pylist() for k in (shape.id, shape.end, shape.step))
    marks, keys = ([rows.column(k).to_pylist() for k in places] for places in (shape.marks, shape.keys))
    return [{"end": e, "id": i, "step": s, "marks": [m[k] for m in marks], "keys": [x[k] for x in keys]} for k, (e, i, s) in enumerate(zip(held, ids, steps, strict=True))], most


def _chunks(shape: Shape, size: int):
    """Chunks of sorted rows: their place, tracks at both ends, rows, stack left by the last track, and its furthest end."""

    def row(part, number, batches):
        table = pa.Table.from_batches(batches).combine_chunks()
        groups = _groups(table, shape.tracks)
        first = len(groups) - 1
        while first and groups[first - 1] == groups[-1]:
            first -= 1
        stack, most = _left_open(table, shape, first)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        ends = [pa.array([g[k]], table.schema.field(k).type) for g in (groups[0], groups[-1]) for k in range(shape.tracks)]
        names = [f"{n}_{k}" for n in ("head", "tail") for k in range(shape.tracks)]
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([number], pa.int64()), *ends, pa.array([first == 0]), pa.array([most], pa.int64()), pa.array([stack], pa.list_(pa.struct(_OPEN))), pa.array([out.getvalue().to_pybytes()], pa.large_binary()).cast(pa.binary())],
            ["part", "number", *names, "whole", "most", "stack", "rows"],
        )

    def run(batches):
        part, number, held, count = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            while len(batch):
                own = batch.slice(0, size - count)
                held.append(own)
                count, batch = count + len(own), batch.slice(len(own))
                if count == size:
                    yield row(part, number, held)
                    number, held, count = number + 1, [], 0
        if held:
            yield row(part, number, held)

    return run


def _inherited(tracks: int):
    """What each chunk inherits, from rows (track..., part, number, gives, whole, most, stack) in order: chunks at both of their tracks."""

    def run(batches):
        group, stack = None, []
        for batch in batches:
            parts, numbers, stacks = [], [], []
            for g, part, number, gives, whole, most, own in zip(_groups(batch, tracks), *(batch.column(tracks + k).to_pylist() for k in range(6)), strict=True):
                if g != group:
                    group, stack = g, []
                if stack:
                    parts.append(part), numbers.append(number), stacks.append(stack)
                if gives:
                    stack = [x for x in stack if most is None or x["end"] >= most] + own if whole else own
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(numbers, pa.int64()), pa.array(stacks, pa.list_(pa.struct(_OPEN)))], ["part", "number", "inherited"])

    return run


class Sweep:
    """Takes the intervals of a track in order. For each: its parent's id, depth, path and the path inside it, nearest marked ancestors, and whether an ancestor has its keys."""

    def __init__(self, marks: int, keys: int):
        self.marks, self.keys, self.names = marks, keys, {}
        self.start()

    def start(self) -> None:
        self.stack: list[tuple] = []  # (end, id, path inside, nearest marked ids, keys)
        self.open: list[dict] = [{} for _ in range(self.keys)]

    def inside(self, path: bytes | None, step: str | None) -> bytes | None:
        """The path with one more step."""
        if step is None:
            return path
        found = self.names.get((path, step))
        if found is None:
            if len(self.names) > 200_000:
                self.names.clear()
            found = self.names[path, step] = blake2b((path or b"") + step.encode(), digest_size=16).digest()
        return found

    def push(self, end, number, step, marks, keys) -> None:
        below = self.stack[-1] if self.stack else (None, None, None, (None,) * self.marks, ())
        nearest = tuple(number if m else old for m, old in zip(marks, below[3], strict=True)) if self.marks else ()
        self.stack.append((end, number, self.inside(below[2], step), nearest, keys))
        for held, key in zip(self.open, keys, strict=True):
            if key is not None:
                held[key] = held.get(key, 0) + 1

    def take(self, end, number, step=None, marks=(), keys=()) -> tuple:
        stack = self.stack
        while stack and stack[-1][0] < end:
            gone = stack.pop()
            for held, key in zip(self.open, gone[4], strict=True):
                if key is not None:
                    held[key] -= 1
                    if not held[key]:
                        del held[key]
        depth = len(stack)
        parent, path, nearest = (stack[-1][1], stack[-1][2], stack[-1][3]) if depth else (None, None, (None,) * self.marks)
        shared = tuple(key in held for held, key in zip(self.open, keys, strict=True)) if self.keys else ()
        self.push(end, number, step, marks, keys)
        return parent, depth, path, stack[-1][2], nearest, shared


def _swept(shape: Shape):
    marks, keys = len(shape.marks), len(shape.keys)

    def run(batches):
        sweep = Sweep(marks, keys)
        for batch in batches:
            for blob, inherited in zip(batch.column(0), batch.column(1), strict=True):
                table = pa.ipc.open_stream(blob.as_buffer()).read_all()
                sweep.start()
                for x in inherited.as_py() or []:
                    sweep.push(x["end"], x["id"], x["step"], x["marks"], x["keys"])
                now = None
                for at in range(0, len(table), SLICE):  # only so many rows are Python's objects at once
                    part = table.slice(at, SLICE).combine_chunks()
                    groups, out = _groups(part, shape.tracks), []
                    columns = [part.column(k).to_pylist() for k in range(shape.id, len(part.columns))]
                    alone = (None, 0, None, None, (None,) * marks, (False,) * keys)
                    for group, number, end, step, *rest in zip(groups, *columns, strict=True):
                        if group != now:
                            if now is not None:
                                sweep.start()
                            now = group
                        out.append(sweep.take(end, number, step, rest[:marks], tuple(rest[marks:])) if end is not None else alone)
                    parent, depth, path, own, nearest, shared = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(part.column(k).combine_chunks() for k in range(shape.kept)), pa.array(parent, pa.int64()), pa.array(depth, pa.int32()), pa.array(path, pa.binary()), pa.array(own, pa.binary()),
                            part.column(shape.step).combine_chunks(), *(pa.array([x[k] for x in nearest], pa.int64()) for k in range(marks)), *(pa.array([x[k] for x in shared], pa.bool_()) for k in range(keys)),
                        ],
                        names=[str(k) for k in range(shape.kept + 5 + marks + keys)],
                    )

    return run


def nest(rows: DataFrame, tracks: list[str], step: Column | None = None, marks: dict[str, Column] | None = None, keys: dict[str, Column] | None = None) -> DataFrame:
    """rows (event_id, ts, dur and others) with parent_id, depth, path, own, step, and a column for each of marks and keys.

    parent_id is the innermost interval of the track that holds this one, both ends included; depth counts the holders. step: a string column, what an interval adds to
    the paths of those inside it (null: nothing); path names the ancestors' steps, own those and the row's. marks: conditions; the column has the id of the nearest ancestor that meets it.
    keys: strings; the column tells whether an ancestor has the same one. Rows without a start or a duration are in nothing and hold nothing. Null tracks are a track.
    """
    marks, keys = marks or {}, keys or {}
    columns = [*tracks, *(c for c in rows.columns if c not in tracks)]
    shape = Shape(len(tracks), len(columns), len(marks), len(keys))
    end = (F.col("ts").cast("bigint") + F.col("dur").cast("bigint")).alias("__end")
    extra = [F.col("event_id").cast("bigint").alias("__id"), end, (F.lit(None) if step is None else step).cast("string").alias("__step")]
    extra += [F.coalesce(c.cast("boolean"), F.lit(False)).alias(f"__mark{k}") for k, c in enumerate(marks.values())] + [c.cast("string").alias(f"__key{k}") for k, c in enumerate(keys.values())]
    order = [*(F.col(c) for c in tracks), F.col("ts"), F.desc("dur"), F.desc("event_id")]
    types = dict(zip(columns, (rows.schema[c].dataType.simpleString() for c in columns), strict=True))
    ends = "".join(f"head_{k} {types[c]}, " for k, c in enumerate(tracks)) + "".join(f"tail_{k} {types[c]}, " for k, c in enumerate(tracks))
    dealt = rows.select(*columns, *extra).repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = materialise(dealt.mapInArrow(_chunks(shape, CHUNK), f"part bigint, number bigint, {ends}whole boolean, most bigint, stack {_OPEN_DDL}, rows binary"), "chunks")
    side = lambda name, gives: F.struct(*(F.col(f"{name}_{k}").alias(f"t{k}") for k in range(len(tracks))), "part", "number", F.lit(gives).alias("gives"), "whole", "most", "stack")
    sides = F.when(F.col("whole"), F.array(side("tail", True))).otherwise(F.array(side("head", False), side("tail", True)))
    flat = chunks.select(F.explode(sides).alias("s")).select("s.*")
    by = [f"t{k}" for k in range(len(tracks))]
    ordered = (flat.repartition(*by) if by else flat.repartition(1)).sortWithinPartitions(*by, "part", "number")
    given = materialise(ordered.mapInArrow(_inherited(len(tracks)), f"part bigint, number bigint, inherited {_OPEN_DDL}"), "inherited")
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", parent_id bigint, depth int, path binary, own binary, step string"
    schema += "".join(f", `{c}` bigint" for c in marks) + "".join(f", `{c}` boolean" for c in keys)
    return chunks.select("part", "number", "rows").join(given, ["part", "number"], "left").select("rows", "inherited").mapInArrow(_swept(shape), schema)


def dictionary(nested: DataFrame) -> DataFrame:
    """(own, path, step): one row for each path that has a step; `path` is the one outside it."""
    return nested.where("step is not null and own is not null").groupBy("own").agg(F.first("path").alias("path"), F.first("step").alias("step"))


def chains(paths: DataFrame) -> DataFrame:
    """(path, chain) of a dictionary: the steps of each path, innermost first. Pointers double twice between written tables, so rounds grow with the logarithm of the depth."""

    def doubled(now: DataFrame) -> DataFrame:
        above = now.select(F.col("own").alias("__own"), F.col("up").alias("__up"), F.col("chain").alias("__chain"))
        joined = now.join(above, F.col("up") == F.col("__own"), "left")
        return joined.select("own", F.col("__up").alias("up"), F.concat("chain", F.coalesce("__chain", F.array().cast("array<string>"))).alias("chain"))

    now = materialise(paths.select("own", F.col("path").alias("up"), F.array("step").alias("chain")), "paths")
    while now.where("up is not null").limit(1).count():
        now = materialise(doubled(doubled(now)), "paths")
    return now.select(F.col("own").alias("path"), "chain")
