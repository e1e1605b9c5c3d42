"""Image operators on pixels in rows: (image_id, y, x, channels...). Grids of any size; one image never has to fit one task unless said so."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def swizzle(pixels: DataFrame, order: str, one=255) -> DataFrame:
    """order: four of r, g, b, a, 0, 1, x (x and 0 give 0)."""
    if len(order) != 4 or set(order) - set("rgba01x"):
        raise ValueError(f"not a swizzle: {order}")
    source = {c: F.col(c) for c in "rgba"} | {"0": F.lit(0), "x": F.lit(0), "1": F.lit(one)}
    rest = [c for c in pixels.columns if c not in "rgba"]
    return pixels.select(*rest, *(source[o].alias(c) for c, o in zip("rgba", order, strict=True)))


def valid_swizzle(text: Column) -> Column:
    """Whether a swizzle is four of r, g, b, a, 0, 1, x; null counts as none."""
    return F.coalesce(text.rlike(r"\A[rgba01x]{4}\z"), F.lit(False))


def valid_channels(text: Column) -> Column:
    """Whether channels are rgba in their places, each of them or x."""
    return F.coalesce(text.rlike(r"\A[rx][gx][bx][ax]\z"), F.lit(False))


def traits(pixels: DataFrame, key: str = "image_id", opaque=255) -> DataFrame:
    return pixels.groupBy(key).agg(F.bool_or((F.col("r") != F.col("g")) | (F.col("r") != F.col("b"))).alias("has_color"), F.bool_or(F.col("a") != opaque).alias("has_alpha"))


def sizes_of(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, width, height) of images that have all their pixels."""
    return pixels.groupBy(key).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def box_mip(pixels: DataFrame, channels: list[str], key: str = "image_id", integers: bool = True, even: bool = False) -> DataFrame:
    """Half size, rounded down: 2 x 2 boxes where both sides are even, integers (sum + 2) div 4, else the mean; other images by weighted_mip(), rounded half up for integers.

    even: the caller knows that all sides are even, which saves a pass over the pixels.
    """
    mean = (lambda c: F.expr(f"(sum({c}) + 2) div 4")) if integers else F.avg
    boxes = lambda p: p.groupBy(key, F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(*(mean(c).alias(c) for c in channels))
    if even:
        return boxes(pixels)
    sizes = sizes_of(pixels, key)
    plain = sizes.where("width % 2 = 0 and height % 2 = 0").select(key)
    rest = sizes.where("width % 2 = 1 or height % 2 = 1")
    odd = weighted_mip(pixels, rest, channels, key)
    if integers:
        odd = odd.withColumns({c: F.floor(F.round(F.col(c), 6) + 0.5).cast("bigint") for c in channels})
    return boxes(pixels.join(plain, key, "left_semi")).unionByName(odd.select(key, F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), *channels))


def _taps(size: str, at: str) -> Column:
    """Cells of one axis at half size that a source counts in, with its weight there: one, or two for every other source of an odd size. The weights of a cell sum to 1."""
    n, p = F.col(size), F.col(at)
    cells = F.floor(n / 2)
    half, m = F.floor(p / 2), cells.cast("double")
    cell = lambda o, w: F.struct(o.cast("int").alias("o"), w.cast("double").alias("w"))
    # overlap of the output cell with each source: the first, the middle and the last of its three
    odd = F.when(p % 2 == 1, F.array(cell(half, m / n))).otherwise(F.array(cell(half, (m - half) / n), cell(half - 1, half / n)))
    inside = (p >= 0) & (p < n)
    found = F.when(n == 1, F.array(cell(half, F.lit(1.0)))).when(n % 2 == 0, F.array(cell(half, F.lit(0.5)))).otherwise(odd)
    return F.when(inside, F.filter(found, lambda t: (t["o"] >= 0) & (t["o"] < F.greatest(cells, F.lit(1)))))


def weighted_mip(pixels: DataFrame, sizes: DataFrame, channels: list[str], key: str = "image_id") -> DataFrame:
    """Half size, rounded down, of any size: odd sizes weigh three sources by overlap. sizes: (image_id, width, height). Each pixel goes to the cells that it counts in, at most four, and cells are summed
    before they are shuffled, so no task sorts all of its pixels by place."""
    rows = pixels.select(key, "y", "x", *channels).join(sizes.select(key, "width", "height"), key)
    rows = rows.withColumn("ty", F.explode(_taps("height", "y"))).withColumn("tx", F.explode(_taps("width", "x")))
    weight = F.col("ty.w") * F.col("tx.w")
    return rows.groupBy(key, F.col("ty.o").alias("y"), F.col("tx.o").alias("x")).agg(*(F.sum(F.col(c) * weight).alias(c) for c in channels))


def mip_plan(images: DataFrame, most: int = 16) -> DataFrame:
    """(…, mip, mip_width, mip_height): max(1, n >> mip) until both are 1."""
    levels = F.least(F.lit(most), F.floor(F.log2(F.greatest("width", "height").cast("double"))).cast("int") + 1)
    rows = images.withColumn("mip", F.explode(F.sequence(F.lit(0), levels - 1)))
    return rows.selectExpr("*", "greatest(1, shiftright(width, mip)) as mip_width", "greatest(1, shiftright(height, mip)) as mip_height")


def mip_offsets(plan: DataFrame, bytes_of: Column, key: str = "image_id") -> DataFrame:
    before = Window.partitionBy(key).orderBy("mip").rowsBetween(Window.unboundedPreceding, -1)
    return plan.withColumn("length", bytes_of).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def aligned_offsets(lengths: Column, align: int = 4) -> Column:
    """Offsets of an array of lengths, each rounded up to a multiple of `align`."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
    pad = lambda n: F.ceil(n / align) * align
    return F.aggregate(lengths, start, lambda s, n: F.struct(pad(s["at"] + n).cast("bigint").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])


def neighbors(pixels: DataFrame, channel: str, wrap: bool, key: str = "image_id") -> DataFrame:
    """Adds left, right, up, down; edges wrap around or repeat the pixel itself."""
    row, column = Window.partitionBy(key, "y").orderBy("x"), Window.partitionBy(key, "x").orderBy("y")
    every = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    value = F.col(channel)

    def side(move, w, edge):
        return F.coalesce(move(channel).over(w), edge(channel).over(every(w)) if wrap else value)

    out = pixels.withColumn("left", side(F.lag, row, F.last)).withColumn("right", side(F.lead, row, F.first))
    return out.withColumn("up", side(F.lag, column, F.last)).withColumn("down", side(F.lead, column, F.first))


def height_to_normal(pixels: DataFrame, channel: str, scale: float, wrap: bool, key: str = "image_id") -> DataFrame:
    """(key, y, x, nx, ny, nz) by central differences."""
    n = neighbors(pixels, channel, wrap, key)
    dx, dy = (F.col("left") - F.col("right")) * scale, (F.col("up") - F.col("down")) * scale
    size = F.sqrt(dx * dx + dy * dy + 1.0)
    return n.select(key, "y", "x", (dx / size).alias("nx"), (dy / size).alias("ny"), (F.lit(1.0) / size).alias("nz"))


def mip_flood(levels: DataFrame, count: int, key: str = "image_id") -> DataFrame:
    """levels: (key, mip, y, x, r, g, b, a). Pixels without alpha take the color of the next smaller level that has alpha there, else of the smallest.

    Each such pixel asks all smaller levels (at most `count`) in one join, so the plan does not grow with the levels.
    """
    last = F.lit(count - 1)
    asked = levels.where((F.col("a") == 0) & (F.col("mip") < last)).select(key, F.col("mip").alias("m"), F.col("y").alias("y0"), F.col("x").alias("x0"), F.explode(F.sequence(F.col("mip") + 1, last)).alias("mip"))
    asked = asked.withColumns({"y": F.expr("shiftright(y0, mip - m)"), "x": F.expr("shiftright(x0, mip - m)")})
    found = asked.join(levels, [key, "mip", "y", "x"]).where((F.col("a") != 0) | (F.col("mip") == last))
    best = found.groupBy(key, "m", "y0", "x0").agg(F.min_by(F.struct("r", "g", "b"), "mip").alias("p"))
    best = best.select(key, F.col("m").alias("mip"), F.col("y0").alias("y"), F.col("x0").alias("x"), "p")
    joined = levels.join(best, [key, "mip", "y", "x"], "left")
    return joined.select(key, "mip", "y", "x", *(F.coalesce(F.col("p")[c], F.col(c)).alias(c) for c in "rgb"), "a")


def resize_point(pixels: DataFrame, sizes: DataFrame, width: int, height: int, key: str = "image_id") -> DataFrame:
    """Nearest source pixel, by floored coordinates."""
    grid = sizes.select(key, F.expr(f"explode(sequence(0, {height - 1}))").alias("oy"), "width", "height").select("*", F.expr(f"explode(sequence(0, {width - 1}))").alias("ox"))
    grid = grid.selectExpr(key, "oy", "ox", f"oy * height div {height} as y", f"ox * width div {width} as x")
    return grid.join(pixels, [key, "y", "x"]).drop("y", "x").withColumnsRenamed({"oy": "y", "ox": "x"})


def block_average(pixels: DataFrame, channels: list[str], block: int, key: str = "image_id") -> DataFrame:
    """Every pixel gets its block's mean, rounded: (sum + n div 2) div n. Blocks are bounded, so a window is too."""
    w = Window.partitionBy(key, F.expr(f"y div {block}"), F.expr(f"x div {block}"))
    n = F.count("*").over(w)
    rest = [c for c in pixels.columns if c not in channels]
    return pixels.select(*rest, *(F.floor((F.sum(c).over(w) + F.floor(n / 2)) / n).cast("bigint").alias(c) for c in channels))


def highlight(mode: str) -> Column:
    """Predicates on r, g, b, a in 0..1; only where a is not 0. Normals are read from r, g as -1..1."""
    r, g, b, a = (F.col(c) for c in "rgba")
    x, y = r * 2 - 1, g * 2 - 1
    tests = {
        "transparent": a < 1, "nonzero": (r != 0) | (g != 0) | (b != 0), "color": (r != g) | (r != b), "gray": (r > 0) & (r < 1) & (r == g) & (r == b),
        "hdr": (F.least(r, g, b) < 0) | (F.greatest(r, g, b) > 1), "positive_x": r > 0.55, "positive_y": g > 0.55, "xy_length": x * x + y * y > 0.999 * 0.999,
    }
    return (a != 0) & tests[mode]


def chunks(pixels: DataFrame, chunk_width: int, chunk_height: int, columns: int) -> DataFrame:
    """Cuts strips and atlases: chunk number, and coordinates inside the chunk."""
    return pixels.selectExpr("*", f"y div {chunk_height} * {columns} + x div {chunk_width} as chunk").withColumns({"y": F.col("y") % chunk_height, "x": F.col("x") % chunk_width})


def metrics(a: DataFrame, b: DataFrame, channel: str, key: list[str], peak: float = 255.0) -> DataFrame:
    """Per group of `key`: max, mean, mse, rmse, psnr of absolute differences; psnr is 100 where the rmse is 0."""
    d = F.abs(F.col("va") - F.col("vb"))
    at = [*key, "y", "x"]
    both = a.select(*at, F.col(channel).alias("va")).join(b.select(*at, F.col(channel).alias("vb")), at).select(*key, d.alias("d"))
    m = both.groupBy(*key).agg(F.max("d").alias("max"), F.avg("d").alias("mean"), F.avg(F.col("d") * F.col("d")).alias("mse"))
    m = m.withColumn("rmse", F.sqrt("mse"))
    return m.withColumn("psnr", F.when(F.col("rmse") == 0, 100.0).otherwise(F.log10(F.lit(peak) / F.col("rmse")) * 20.0))


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """Interleaved bits of x (even places) and y (odd places)."""
    bit = lambda v, i, to: F.shiftleft(F.shiftright(v, i).bitwiseAND(1).cast("bigint"), to)
    parts = [p for i in range(bits) for p in (bit(x, i, 2 * i), bit(y, i, 2 * i + 1))]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


# --- distance fields: a pass over rows, then one over columns


def distance_field(pixels: DataFrame, channel: str, threshold: float = 127.5, spread: float = 4.0, key: str = "image_id", scale: int = 1) -> DataFrame:
    """(key, y, x, distance) of each image, every `scale`-th pixel of each row and column, from the middle of its cell: 0..255, 128 at the edge, the distance to the nearest pixel
    of the other side, up to `spread`. Exact, by two passes: in each row how far the nearest pixel of either side is, then in each column the least sum of squares, within
    `spread` of the pixel, beyond which nothing counts. A row or a column of an image is the most that meets in a task. Pixels that are not there are on neither side.
    """
    inside, most = F.col(channel) > threshold, math.ceil(spread)
    along = Window.partitionBy(key, "y").orderBy("x")
    back, ahead = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(0, Window.unboundedFollowing)

    def in_row(side):
        x = F.when(side, F.col("x"))
        return F.least(F.col("x") - F.last(x, ignorenulls=True).over(back), F.first(x, ignorenulls=True).over(ahead) - F.col("x"))

    rows = pixels.select(key, "y", "x", in_row(inside).alias("__in"), in_row(~inside).alias("__out"))
    near = F.collect_list(F.struct("y", "__in", "__out")).over(Window.partitionBy(key, "x").orderBy("y").rangeBetween(-most, most))
    square = lambda c: c.cast("double") * c.cast("double")
    nearest = lambda side: F.coalesce(F.sqrt(F.array_min(F.transform("__near", lambda r: square(r["y"] - F.col("y")) + square(r[side])))), F.lit(float(most + 1)))
    found = rows.withColumn("__near", near)
    step = F.least(F.greatest((nearest("__in") - nearest("__out")) / float(spread), F.lit(-1.0)), F.lit(1.0))
    value = F.least(F.greatest(F.bround(128.0 - 127.0 * step, 0), F.lit(0.0)), F.lit(255.0)).cast("int").alias("distance")
    found = found.select(key, "y", "x", value)
    if scale == 1:
        return found
    kept = found.where(((F.col("y") - scale // 2) % scale == 0) & ((F.col("x") - scale // 2) % scale == 0))
    return kept.select(key, *(F.floor((F.col(c) - scale // 2) / scale).cast(dict(pixels.dtypes)[c]).alias(c) for c in "yx"), "distance")


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def next_power_of_two(n: Column) -> Column:
    """The least power of two that is not below n; 1 for n below 2."""
    return F.when(n <= 1, F.lit(1).cast("bigint")).otherwise(F.expr("1L").cast("bigint") * F.pow(F.lit(2.0), F.length(F.bin((n - 1).cast("bigint")))).cast("bigint"))


def premultiply_float(pixels: DataFrame, prezero: bool = False) -> DataFrame:
    """Float colors times alpha; prezero: zero where alpha is 0, else as they are."""
    out = (lambda c: F.when(F.col("a") == 0, 0.0).otherwise(F.col(c))) if prezero else (lambda c: F.col(c) * F.col("a"))
    rest = [c for c in pixels.columns if c not in "rgba"]
    return pixels.select(*rest, *(out(c).alias(c) for c in "rgb"), "a")


def chunk(pixels: DataFrame, number: int, chunk_width: int, chunk_height: int, columns: int) -> DataFrame:
    """One chunk of a strip or atlas, with its own coordinates."""
    return chunks(pixels, chunk_width, chunk_height, columns).where(F.col("chunk") == number).drop("chunk")


def linearize(pixels: DataFrame, premultiplied: bool = True, prezero: bool = False) -> DataFrame:
    """sRGB bytes to linear 0..1, multiplied by alpha or zeroed where alpha is 0."""
    from ..functions.colors import srgb_to_linear

    a = F.col("a") / 255.0
    channel = lambda c: srgb_to_linear(F.col(c) / 255.0)
    if premultiplied:
        out = lambda c: channel(c) * a
    else:
        out = (lambda c: F.when(F.col("a") == 0, 0.0).otherwise(channel(c))) if prezero else channel
    rest = [c for c in pixels.columns if c not in "rgba"]
    return pixels.select(*rest, *(out(c).alias(c) for c in "rgb"), a.alias("a"))


def kept_levels(plan: DataFrame, smallest: int = 1, largest: int = 32768, skip: int = 0) -> DataFrame:
    """Levels of mip_plan() with both sides between two sizes, without the first `skip`; numbered anew."""
    rows = plan.where((F.least("mip_width", "mip_height") >= smallest) & (F.greatest("mip_width", "mip_height") <= largest))
    w = Window.partitionBy("image_id").orderBy("mip")
    return rows.withColumn("level", F.row_number().over(w) - 1 - skip).where("level >= 0")


def isolate(pixels: DataFrame, channel: str) -> DataFrame:
    """One channel alone; alpha shows as gray."""
    rest = [c for c in pixels.columns if c not in "rgba"]
    pick = (lambda c: F.col("a")) if channel == "a" else (lambda c: F.col(c) if c == channel else F.lit(0))
    return pixels.select(*rest, *(pick(c).alias(c) for c in "rgb"), (F.lit(255) if channel == "a" else F.col("a")).alias("a"))


def probe(pixels: DataFrame, u: float, v: float, width: int, height: int, mip: int | None = None, block: tuple[int, int] | None = None) -> DataFrame:
    """The pixel at a texture coordinate; of a level if mip is given; with the block that it is in if a block size is."""
    w, h = (max(1, n >> (mip or 0)) for n in (width, height))
    x, y = min(w - 1, max(0, int(u * w))), min(h - 1, max(0, int(v * h)))
    rows = pixels.where((F.col("x") == x) & (F.col("y") == y))
    rows = rows if mip is None else rows.where(F.col("mip") == mip)
    return rows.withColumns({"block_x": F.lit(x // block[0]), "block_y": F.lit(y // block[1])}) if block else rows
