"""Texture formats as a dimension table, and what is derived from names and formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, block width, block height, bytes of a block, channels, family, number kind.
FORMATS = [
    ("Invalid", 1, 1, 0, 0, "", ""),
    ("BC1", 4, 4, 8, 3, "bc", "unorm"), ("BC1s", 4, 4, 8, 3, "bc", "srgb"),
    ("BC3", 4, 4, 16, 4, "bc", "unorm"), ("BC3s", 4, 4, 16, 4, "bc", "srgb"),
    ("BC4", 4, 4, 8, 1, "bc", "unorm"), ("BC4sn", 4, 4, 8, 1, "bc", "snorm"),
    ("BC5", 4, 4, 16, 2, "bc", "unorm"), ("BC5sn", 4, 4, 16, 2, "bc", "snorm"),
    ("BC6h", 4, 4, 16, 4, "bc", "half"), ("BC6uh", 4, 4, 16, 4, "bc", "half"),
    ("BC7", 4, 4, 16, 4, "bc", "unorm"), ("BC7s", 4, 4, 16, 4, "bc", "srgb"),
    ("ETCr", 4, 4, 8, 1, "etc", "unorm"), ("ETCrsn", 4, 4, 8, 1, "etc", "snorm"),
    ("ETCrg", 4, 4, 16, 2, "etc", "unorm"), ("ETCrgsn", 4, 4, 16, 2, "etc", "snorm"),
    ("ETCrgb", 4, 4, 8, 3, "etc", "unorm"), ("ETCsrgb", 4, 4, 8, 3, "etc", "srgb"),
    ("ETCrgba", 4, 4, 16, 4, "etc", "unorm"), ("ETCsrgba", 4, 4, 16, 4, "etc", "srgb"),
    *((f"ASTC{n}x{n}{s}", n, n, 16, 4, "astc", k) for n in (4, 5, 6, 8) for s, k in (("", "unorm"), ("s", "srgb"), ("h", "half"))),
    ("EXPr8", 1, 1, 1, 1, "explicit", "unorm"), ("EXPrg8", 1, 1, 2, 2, "explicit", "unorm"),
    ("EXPrgba8", 1, 1, 4, 4, "explicit", "unorm"), ("EXPsrgba8", 1, 1, 4, 4, "explicit", "srgb"),
    ("EXPr16f", 1, 1, 2, 1, "explicit", "half"), ("EXPrg16f", 1, 1, 4, 2, "explicit", "half"), ("EXPrgba16f", 1, 1, 8, 4, "explicit", "half"),
    ("EXPr32f", 1, 1, 4, 1, "explicit", "float"), ("EXPrg32f", 1, 1, 8, 2, "explicit", "float"), ("EXPrgba32f", 1, 1, 16, 4, "explicit", "float"),
    ("EXPrg11b10f", 1, 1, 4, 3, "import", "half"), ("EXPrgb9f", 1, 1, 4, 3, "import", "half"),
]

# Format numbers of the Vulkan and Direct3D headers, for the formats that the containers here read and write.
VULKAN = {"BC1": 131, "BC1s": 132, "BC3": 137, "BC3s": 138, "BC4": 139, "BC4sn": 140, "BC5": 141, "BC5sn": 142, "BC7": 145, "BC7s": 146, "ETCrgb": 147, "ETCsrgb": 148, "ETCrgba": 151, "ETCsrgba": 152, "ETCr": 153, "ETCrsn": 154, "ETCrg": 155, "ETCrgsn": 156, "ASTC4x4": 157, "ASTC4x4s": 158, "ASTC5x5": 161, "ASTC5x5s": 162, "ASTC6x6": 165, "ASTC6x6s": 166, "ASTC8x8": 171, "ASTC8x8s": 172, "EXPr8": 9, "EXPrg8": 16, "EXPrgba8": 37, "EXPsrgba8": 43, "EXPr16f": 76, "EXPrg16f": 83, "EXPrgba16f": 97, "EXPr32f": 100, "EXPrg32f": 103, "EXPrgba32f": 109}
DIRECTX = {"BC1": 71, "BC1s": 72, "BC3": 77, "BC3s": 78, "BC4": 80, "BC4sn": 81, "BC5": 83, "BC5sn": 84, "BC7": 98, "BC7s": 99, "EXPr8": 61, "EXPrg8": 49, "EXPrgba8": 28, "EXPsrgba8": 29, "EXPr16f": 54, "EXPrg16f": 34, "EXPrgba16f": 10, "EXPr32f": 41, "EXPrg32f": 16, "EXPrgba32f": 2}
# Pixel format numbers of the Metal headers.
METAL = {"BC1": 130, "BC1s": 131, "BC3": 134, "BC3s": 135, "BC4": 140, "BC4sn": 141, "BC5": 142, "BC5sn": 143, "BC6h": 150, "BC6uh": 151, "BC7": 152, "BC7s": 153, "ETCr": 170, "ETCrsn": 172, "ETCrg": 174, "ETCrgsn": 176, "ETCrgba": 178, "ETCsrgba": 179, "ETCrgb": 180, "ETCsrgb": 181, "ASTC4x4s": 186, "ASTC5x5s": 188, "ASTC6x6s": 190, "ASTC8x8s": 194, "ASTC4x4": 204, "ASTC5x5": 206, "ASTC6x6": 208, "ASTC8x8": 212, "ASTC4x4h": 222, "ASTC5x5h": 224, "ASTC6x6h": 226, "ASTC8x8h": 230, "EXPr8": 10, "EXPrg8": 30, "EXPrgba8": 70, "EXPsrgba8": 71, "EXPr16f": 25, "EXPrg16f": 65, "EXPrgba16f": 115, "EXPr32f": 55, "EXPrg32f": 105, "EXPrgba32f": 125}
#: Encoders by priority and the families they take.
ENCODERS = [("squish", 0, "bc"), ("bcenc", 1, "bc"), ("etcenc", 0, "etc"), ("astcenc", 0, "astc"), ("explicit", 0, "explicit")]


def formats(spark: SparkSession) -> DataFrame:
    """The dimension table: fixed size, so it may be broadcast."""
    rows = [(*f, VULKAN.get(f[0]), DIRECTX.get(f[0]), METAL.get(f[0])) for f in FORMATS]
    df = spark.createDataFrame(rows, "format string, block_x int, block_y int, block_size int, channels int, family string, kind string, vulkan int, directx int, metal int")
    return df.selectExpr("*", "kind = 'srgb' as is_srgb", "kind = 'snorm' as is_signed", "kind in ('half', 'float') as is_float", "kind in ('half', 'float') as is_hdr", "channels = 4 as has_alpha", "block_x > 1 as is_block")


def with_format(rows: DataFrame, column: str = "format") -> DataFrame:
    """Adds the format's columns; unknown names become Invalid."""
    table = formats(rows.sparkSession)
    known = [f[0] for f in FORMATS]
    named = rows.withColumn(column, F.when(F.col(column).isin(known), F.col(column)).otherwise("Invalid"))
    return named.join(F.broadcast(table.withColumnRenamed("format", column)), column, "left")


def format_of_number(rows: DataFrame, column: str, api: str) -> DataFrame:
    """Adds the format that a number of an API (vulkan, directx or metal) stands for; Invalid for numbers without one."""
    table = formats(rows.sparkSession).where(F.col(api).isNotNull()).select(F.col(api).alias("__number"), "format")
    named = rows.join(F.broadcast(table), F.col(column) == F.col("__number"), "left").drop("__number")
    return named.withColumn("format", F.coalesce("format", F.lit("Invalid")))


def level_bytes(width: Column, height: Column) -> Column:
    """Of a row that has the format's columns."""
    return (F.ceil(width / F.col("block_x")) * F.ceil(height / F.col("block_y")) * F.col("block_size")).cast("bigint")


def toggle_srgb(name: Column) -> Column:
    """The other of a linear and sRGB pair; others stay."""
    pairs = {}
    for f in FORMATS:
        other = f[0] + "s" if not f[0].startswith(("ETC", "EXP")) else f[0].replace("rgb", "srgb", 1)
        if f[6] == "unorm" and any(g[0] == other and g[6] == "srgb" for g in FORMATS):
            pairs |= {f[0]: other, other: f[0]}
    table = F.create_map(*(F.lit(x) for p in sorted(pairs.items()) for x in p))
    return F.coalesce(F.try_element_at(table, name), name)


def opaque_format(name: Column, has_alpha: Column) -> Column:
    """Cheaper formats for images without alpha."""
    down = F.create_map(*(F.lit(x) for x in ("BC7", "BC1", "BC7s", "BC1s", "BC3", "BC1", "BC3s", "BC1s", "ETCrgba", "ETCrgb", "ETCsrgba", "ETCsrgb")))
    return F.when(~has_alpha, F.coalesce(F.try_element_at(down, name), name)).otherwise(name)


def encoder_for(rows: DataFrame, column: str = "format") -> DataFrame:
    """Adds the encoder of the least priority number that takes the format's family."""
    spark = rows.sparkSession
    support = spark.createDataFrame(ENCODERS, "encoder string, priority int, family string").join(formats(spark).select("format", "family"), "family")
    best = support.groupBy(F.col("format").alias(column)).agg(F.min_by("encoder", "priority").alias("encoder"))
    return rows.join(F.broadcast(best), column, "left")


def content_type(name: Column) -> Column:
    """From the suffix of a name without its extension; default albedo."""
    return F.when(name.rlike("-(n|normal)$"), "normal").when(name.rlike("-(h|height)$"), "height").when(name.rlike("-(sdf)$"), "sdf").when(name.rlike("-(ao)$"), "ao").when(name.rlike("-(mr|metalroughness)$"), "metal_rough").otherwise("albedo")


# Endings of a file's stem and what it holds, tried in this order.
LIBRARY_ENDS = [
    ("sdf", ["-sdf"]), ("height", ["-h"]), ("normal", ["-n", "_normal", "_Normal"]), ("albedo", ["-a", "-d", "_baseColor", "_Color"]), ("ao", ["-ao", "_AO"]),
    ("metal_rough", ["-mr", "_Metallic", "_Roughness", "_MetaliicRoughness"]),
]


def library_content_type(file: Column) -> Column:
    """From a file name with an extension, by the library's rules, which know other endings than content_type(); without extension unknown, else albedo."""
    stem = F.regexp_replace(file, r"\.[^.]*\z", "")
    out = F.when(~file.contains("."), "unknown")
    for content, ends in LIBRARY_ENDS:
        for end in ends:
            out = out.when(stem.endswith(end), content)
    return out.otherwise("albedo")


def texture_type(name: Column) -> Column:
    """In this order, so that -cubearray is a cube: it contains -cube."""
    return F.when(name.contains("-3d"), "3d").when(name.contains("-cube"), "cube").when(name.contains("-2darray"), "2darray").when(name.contains("-1darray"), "1darray").otherwise("2d")


def atlas_grid(name: Column) -> tuple[Column, Column]:
    """(columns, rows) of -atlas<c>x<r>; 0 without."""
    part = lambda k: F.coalesce(F.regexp_extract(name, r"-atlas(\d+)x(\d+)", k).try_cast("int"), F.lit(0))
    return part(1), part(2)


def info(textures: DataFrame, levels: str = "levels") -> DataFrame:
    """Totals over an array of levels (length, compressed): bytes, compressed bytes, whole percent; megapixels of the largest level, from width and height if there."""
    total = lambda f: F.aggregate(F.col(levels), F.lit(0).cast("bigint"), lambda a, x: a + x[f])
    if {"width", "height"} <= {*textures.columns}:
        textures = textures.withColumn("megapixels", F.col("width").cast("double") * F.col("height") / 1e6)
    return textures.withColumn("bytes", total("length")).withColumn("compressed_bytes", total("compressed")).withColumn("percent", F.expr("coalesce(100 * compressed_bytes div nullif(bytes, 0), 0)"))


def bc7_mode(first_byte: Column) -> Column:
    """Mode of a BC7 block: place of the lowest set bit of its first byte; 8 if none."""
    return F.when(first_byte == 0, 8).otherwise(F.bit_count(first_byte.bitwiseXOR(first_byte - 1)) - 1)


def parse_format(name: Column, signed: Column, srgb: Column, hdr: Column) -> Column:
    """Format of a command's name and flags, e.g. ("bc7", srgb) -> BC7s; Invalid if there is none."""
    known = {}
    for f in FORMATS[1:]:
        base = f[0].lower()
        for suffix, kind in (("sn", "snorm"), ("s", "srgb"), ("h", "half"), ("uh", "half")):
            if f[6] == kind and base.endswith(suffix):
                base = base[: -len(suffix)]
                break
        base = base.replace("srgb", "rgb") if f[6] == "srgb" else base
        known.setdefault(f"{base}/{f[6]}", f[0])
    table = F.create_map(*(F.lit(x) for p in sorted(known.items()) for x in p))
    kind = F.when(signed, "snorm").when(srgb, "srgb").when(hdr, "half").otherwise("unorm")
    key = F.lower(name)
    return F.coalesce(F.try_element_at(table, F.concat_ws("/", key, kind)), F.try_element_at(table, F.concat_ws("/", key, F.lit("unorm"))), F.try_element_at(table, F.concat_ws("/", key, F.lit("half"))), F.try_element_at(table, F.concat_ws("/", key, F.lit("float"))), F.lit("Invalid"))


def kind_of_texture(height: Column, depth: Column, layers: Column, faces: Column) -> Column:
    """Type from a container's header."""
    return (
        F.when((faces > 1) & (layers > 0), "cubearray").when(faces > 1, "cube").when(depth > 0, "3d")
        .when((layers > 0) & (height > 0), "2darray").when((layers > 0) | (height == 0), "1darray").otherwise("2d")
    )


def total_chunks(depth: Column, layers: Column, faces: Column) -> Column:
    return F.greatest(depth, F.lit(1)) * F.greatest(layers, F.lit(1)) * F.greatest(faces, F.lit(1))


def valid_levels(textures: DataFrame) -> DataFrame:
    """Adds `valid`: every level (mip, length) of a texture with its format's columns has the length that its size asks for."""
    side = lambda n, mip: F.greatest(F.lit(1), F.shiftright(n, 0) / F.pow(F.lit(2), mip)).cast("int")
    size = lambda m: F.ceil(side(F.col("width"), m) / F.col("block_x")) * F.ceil(side(F.col("height"), m) / F.col("block_y")) * F.col("block_size")
    return textures.withColumn("valid", F.forall("levels", lambda v: v["length"] == size(v["mip"])))


# What a viewer does to show a stored swizzle, channel names, addressing and filter of containers.
POST_SWIZZLES = {"gggr": "ag01", "rrrg": "ga01", "rrr1": "r001"}
CHANNELS = {"normal": "Nrm.x,Nrm.y,X,X", "premultiplied": "Alb.ra,Alb.ga,Alb.ba,Alb.a", "plain": "Alb.r,Alb.g,Alb.b,Alb.a"}
ADDRESSES = {"1darray": "Rep,X,X", "3d": "Rep,Rep,Rep", "other": "Rep,Rep,X"}
FILTERS = {"mips": "Lin,Lin,Lin", "one": "Lin,Lin,X"}


def base_props(swizzle: Column, normal: Column, srgb: Column, premultiplied: Column, kind: Column, mips: Column) -> Column:
    """Properties written into containers, as a map: swizzle and what undoes it, channels, address, filter. Linear colors that are not premultiplied have no channels."""
    post = F.try_element_at(F.create_map(*(F.lit(x) for p in POST_SWIZZLES.items() for x in p)), swizzle)
    channels = F.when(normal, CHANNELS["normal"]).when(premultiplied, CHANNELS["premultiplied"]).when(srgb, CHANNELS["plain"])
    address = F.when(kind == "1darray", ADDRESSES["1darray"]).when(kind == "3d", ADDRESSES["3d"]).otherwise(ADDRESSES["other"])
    every = F.create_map(
        F.lit("swizzle"), swizzle, F.lit("post_swizzle"), post, F.lit("channels"), channels, F.lit("address"), address, F.lit("filter"), F.when(mips, FILTERS["mips"]).otherwise(FILTERS["one"]),
    )
    return F.map_filter(every, lambda _, v: v.isNotNull())


def info_lines(rows: DataFrame) -> DataFrame:
    """One line per texture of `info` and `with_format` columns."""
    return rows.select(F.format_string("%s: %s %dx%d, %d levels, %d bytes (%d%%)", "path", "format", "width", "height", F.size("levels"), "bytes", "percent").alias("value"))


def encode_line() -> Column:
    """Command of a row (source, target, format, is_srgb, content)."""
    flag = F.when(F.col("is_srgb"), " -srgb").otherwise("")
    normal = F.when(F.col("content") == "normal", " -normal").otherwise("")
    return F.concat(F.lit("encode -f "), F.lower("format"), flag, normal, F.lit(" -i "), "source", F.lit(" -o "), "target")


def encode_script(rows: DataFrame) -> DataFrame:
    """One command a line."""
    return rows.select(encode_line().alias("value"))
