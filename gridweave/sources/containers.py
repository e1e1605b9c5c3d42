"""Texture containers: readers to rows, and writers of the same bytes."""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.textures import DIRECTX, FORMATS, VULKAN
from ..scratch import spread

try:
    import zstandard
except ImportError:  # only supercompressed levels need it
    zstandard = None

# File identifiers.
KTX1 = bytes([0xAB, 0x4B, 0x54, 0x58, 0x20, 0x31, 0x31, 0xBB, 0x0D, 0x0A, 0x1A, 0x0A])
KTX2 = bytes([0xAB, 0x4B, 0x54, 0x58, 0x20, 0x32, 0x30, 0xBB, 0x0D, 0x0A, 0x1A, 0x0A])
PNG = bytes([0x89, 0x50, 0x4E, 0x47, 0x0D, 0x0A, 0x1A, 0x0A])
# GL internal formats and base formats of the explicit formats that KTX1 files here hold.
GL = {"EXPr8": (0x8229, 0x1903), "EXPrg8": (0x822B, 0x8227), "EXPrgba8": (0x8058, 0x1908), "EXPsrgba8": (0x8C43, 0x8C42), "BC1": (0x83F0, 0x1907), "BC3": (0x83F3, 0x1908), "BC7": (0x8E8C, 0x1908), "ETCrgba": (0x9278, 0x1908), "ASTC4x4": (0x93B0, 0x1908)}
_BY_GL = {v[0]: k for k, v in GL.items()}
_BY_VK, _BY_DX = {v: k for k, v in VULKAN.items()}, {v: k for k, v in DIRECTX.items()}
SHAPE = {f[0]: f[1:4] for f in FORMATS}


def level_size(name: str, width: int, height: int, mip: int) -> int:
    bx, by, size = SHAPE[name]
    w, h = max(1, width >> mip), max(1, height >> mip)
    return -(-w // bx) * -(-h // by) * size


def _pad(n: int, to: int = 4) -> int:
    return -n % to


def pack_props(props: list[tuple[str, str]]) -> bytes:
    """uint32 size, key, zero, value, zero, padded to four bytes."""
    out = b""
    for key, value in props:
        body = key.encode() + b"\0" + value.encode() + b"\0"
        out += struct.pack("<I", len(body)) + body + b"\0" * _pad(len(body))
    return out


def unpack_props(data: bytes) -> list[tuple[str, str]]:
    out, at = [], 0
    while at + 4 <= len(data):
        (size,) = struct.unpack_from("<I", data, at)
        key, _, value = data[at + 4 : at + 4 + size].partition(b"\0")
        out.append((key.decode(), value.rstrip(b"\0").decode()))
        at += 4 + size + _pad(size)
    return out


def set_prop(props: list[tuple[str, str]], key: str, value: str) -> list[tuple[str, str]]:
    """Replaces a key's value in place, or appends it."""
    out = [(k, value if k == key else v) for k, v in props]
    return out if any(k == key for k, _ in props) else [*out, (key, value)]


def write_ktx1(name: str, width: int, height: int, levels: list[bytes], props: list[tuple[str, str]] = ()) -> bytes:
    internal, base = GL[name]
    kv = pack_props(list(props))
    block = SHAPE[name][0] > 1
    head = struct.pack("<13I", 0x04030201, 0 if block else 0x1401, 1, 0 if block else base, internal, base, width, height, 0, 0, 1, len(levels), len(kv))
    body = b"".join(struct.pack("<I", len(x)) + x + b"\0" * _pad(len(x)) for x in levels)
    return KTX1 + head + kv + body


def read_ktx1(data: bytes) -> dict:
    if data[:12] != KTX1:
        raise ValueError("not a KTX file")
    f = struct.unpack_from("<13I", data, 12)
    at, levels = 64 + f[12], []
    for _ in range(max(1, f[11])):
        (size,) = struct.unpack_from("<I", data, at)
        levels.append((at + 4, size, size))
        at += 4 + size + _pad(size)
    return {"container": "ktx", "format": _BY_GL.get(f[4], "Invalid"), "width": f[6], "height": f[7], "depth": f[8], "layers": f[9], "faces": f[10], "props": unpack_props(data[64 : 64 + f[12]]), "scheme": 0, "levels": levels}


@functools.cache
def descriptor(name: str) -> bytes:
    """Basic data format descriptor: enough to name block size and channels."""
    bx, by, size = SHAPE[name]
    channels, kind = next((f[4], f[6]) for f in FORMATS if f[0] == name)
    samples = b"".join(struct.pack("<HBBIII", 8 * k * max(1, size // max(channels, 1)), max(8 * size // max(channels, 1) - 1, 0) & 0xFF, k, 0, 0, 0xFFFFFFFF) for k in range(channels))
    body = struct.pack("<HHHHBBBB4B8B", 0, 0, 2, 24 + len(samples), 1, 1, 2 if kind == "srgb" else 1, 0, bx - 1, by - 1, 0, 0, size, 0, 0, 0, 0, 0, 0, 0) + samples
    return struct.pack("<I", len(body) + 4) + body


def write_ktx2(name: str, width: int, height: int, levels: list[bytes], props: list[tuple[str, str]] = (), scheme: int = 0) -> bytes:
    """Smallest level first, each aligned to four bytes. scheme: 0 none, 2 zstd, 3 zlib."""
    dfd, kv = descriptor(name), pack_props(list(props))
    squeeze = {0: lambda x: x, 2: lambda x: zstandard.ZstdCompressor().compress(x), 3: zlib.compress}[scheme]
    at = 80 + 24 * len(levels)
    dfd_at, kv_at = at, at + len(dfd)
    at = kv_at + len(kv)
    index, body = [None] * len(levels), b""
    for k in range(len(levels) - 1, -1, -1):
        gap = _pad(at)
        packed = squeeze(levels[k])
        body += b"\0" * gap + packed
        index[k] = (at + gap, len(packed), len(levels[k]))
        at += gap + len(packed)
    head = struct.pack("<9I", VULKAN[name], 1, width, height, 0, 0, 1, len(levels), scheme) + struct.pack("<4I2Q", dfd_at, len(dfd), kv_at, len(kv), 0, 0)
    return KTX2 + head + b"".join(struct.pack("<3Q", *x) for x in index) + dfd + kv + body


def read_ktx2(data: bytes) -> dict:
    if data[:12] != KTX2:
        raise ValueError("not a KTX2 file")
    f = struct.unpack_from("<9I4I2Q", data, 12)
    if f[8] == 1 or f[0] == 0:
        raise ValueError("this supercompression is not supported")
    levels = [struct.unpack_from("<3Q", data, 80 + 24 * k) for k in range(max(1, f[7]))]
    return {"container": "ktx2", "format": _BY_VK.get(f[0], "Invalid"), "width": f[2], "height": f[3], "depth": f[4], "layers": f[5], "faces": f[6], "props": unpack_props(data[f[11] : f[11] + f[12]]), "scheme": f[8], "levels": levels}


def read_level(data: bytes, scheme: int, level: tuple[int, int, int]) -> bytes:
    offset, packed, size = level
    body = data[offset : offset + packed]
    if scheme == 0:
        return body
    if scheme == 2:
        if zstandard is None:
            raise RuntimeError("zstandard is needed for this level")
        return zstandard.ZstdDecompressor().decompress(body, max_output_size=size)
    return zlib.decompress(body, bufsize=size)


def write_dds(name: str, width: int, height: int, levels: list[bytes]) -> bytes:
    flags = 0x1007 | (0x20000 if len(levels) > 1 else 0) | (0x80000 if SHAPE[name][0] > 1 else 0x8)
    head = struct.pack("<7I44x", 124, flags, height, width, len(levels[0]), 0, len(levels)) + struct.pack("<2I4s5I", 32, 4, b"DX10", 0, 0, 0, 0, 0) + struct.pack("<5I", 0x1000 | (0x400008 if len(levels) > 1 else 0), 0, 0, 0, 0)
    return b"DDS " + head + struct.pack("<5I", DIRECTX[name], 3, 0, 1, 0) + b"".join(levels)


# Older files name their format by four characters.
_FOUR = {b"DXT1": "BC1", b"DXT5": "BC3", b"ATI1": "BC4", b"BC4U": "BC4", b"ATI2": "BC5", b"BC5U": "BC5"}


def read_dds(data: bytes) -> dict:
    if data[:4] != b"DDS ":
        raise ValueError("not a DDS file")
    height, width = struct.unpack_from("<2I", data, 12)
    count = max(1, struct.unpack_from("<I", data, 28)[0])
    four, at = data[84:88], 128
    if four == b"DX10":
        name, at = _BY_DX.get(struct.unpack_from("<I", data, 128)[0], "Invalid"), 148
    else:
        name = _FOUR.get(four, "EXPrgba8" if struct.unpack_from("<I", data, 88)[0] == 32 else "Invalid")
    levels = []
    for k in range(count):
        size = level_size(name, width, height, k)
        levels.append((at, size, size))
        at += size
    return {"container": "dds", "format": name, "width": width, "height": height, "depth": 0, "layers": 0, "faces": 1, "props": [], "scheme": 0, "levels": levels}


def write_png(width: int, height: int, rgba: bytes, srgb: bool = False) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + rgba[4 * width * y : 4 * width * (y + 1)] for y in range(height))
    return PNG + chunk(b"IHDR", struct.pack(">2I5B", width, height, 8, 6, 0, 0, 0)) + (chunk(b"sRGB", b"\0") if srgb else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def png_chunks(data: bytes):
    at = 8
    while at + 8 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size


def read_png(data: bytes) -> tuple[int, int, bool, bytes]:
    """(width, height, srgb, rgba) of 8-bit gray, gray and alpha, rgb or rgba images without interlacing."""
    if data[:8] != PNG:
        raise ValueError("not a PNG file")
    width = height = 0
    depth = color = lace = 0
    srgb, body = False, b""
    for kind, content in png_chunks(data):
        if kind == b"IHDR":
            width, height, depth, color, _, _, lace = struct.unpack(">2I5B", content)
        elif kind == b"sRGB":
            srgb = True
        elif kind == b"IDAT":
            body += content
    n = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if depth != 8 or n is None or lace:
        raise ValueError("only plain 8-bit images are supported")
    stride = width * n
    raw = np.frombuffer(zlib.decompress(body), np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    rows, before = np.empty((height, width, n), np.uint8), np.zeros((width, n), np.uint8)
    for y in range(height):
        before = rows[y] = _unfiltered(int(raw[y, 0]), raw[y, 1:].reshape(width, n), before)
    rgba = np.full((height, width, 4), 255, np.uint8)
    rgba[..., :3] = rows[..., :3] if n > 2 else rows[..., :1]
    if n in (2, 4):
        rgba[..., 3] = rows[..., -1]
    return width, height, srgb, rgba.tobytes()


def _unfiltered(kind: int, row: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A row (width, channels) without its filter. Two of the filters need the pixel to the left, so they go pixel by pixel."""
    if kind == 1:
        return np.cumsum(row, 0, dtype=np.uint8)
    if kind == 2:
        return row + before
    if kind not in (3, 4):
        return row
    out = []
    for own, ups in zip(row.T.tolist(), before.T.tolist(), strict=True):
        left = corner = 0
        line = []
        for value, up in zip(own, ups, strict=True):
            if kind == 3:
                left = (value + (left + up) // 2) & 255
            else:
                a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                left = (value + (left if a <= b and a <= c else up if b <= c else corner)) & 255
            corner = up
            line.append(left)
        out.append(line)
    return np.array(out, np.uint8).T


_READERS = {KTX1: read_ktx1, KTX2: read_ktx2}
_TEXTURES = "path string, container string, format string, width int, height int, depth int, layers int, faces int, scheme int, props array<struct<key:string,value:string>>, levels array<struct<mip:int,offset:bigint,compressed:bigint,length:bigint>>, error string"


def _read(batches):
    for batch in batches:
        rows = []
        for path, data in zip(batch["path"], batch["content"], strict=True):
            try:
                t = _READERS.get(data[:12], read_dds)(data)
                rows.append((path, *(t[k] for k in ("container", "format", "width", "height", "depth", "layers", "faces", "scheme")), [{"key": k, "value": v} for k, v in t["props"]], [{"mip": k, "offset": o, "compressed": c, "length": n} for k, (o, c, n) in enumerate(t["levels"])], None))
            except (ValueError, struct.error) as e:  # a bad file becomes a row that says so
                rows.append((path, None, None, None, None, None, None, None, None, None, None, str(e)))
        yield pd.DataFrame(rows, columns=[x.strip().split()[0] for x in ("path,container,format,width,height,depth,layers,faces,scheme,props,levels,error").split(",")])


def textures(containers: DataFrame) -> DataFrame:
    """containers (path, content) -> one row per texture: header, properties and levels; payloads stay where they are."""
    return containers.select("path", "content").mapInPandas(_read, _TEXTURES)


_PIXELS = "path string, y int, x int, srgb boolean, r int, g int, b int, a int, error string"


#: Pixels of a frame that goes back to Spark, about.
FRAME = 200_000


def _frame(held: list[tuple]) -> pa.RecordBatch:
    """Rows of images (path, width, height, srgb, rgba, error); one without pixels is a row with its error."""
    sizes = np.array([1 if e is not None else w * h for _, w, h, _, _, e in held])
    each = np.repeat(np.arange(len(held)), sizes)
    place = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    bad = np.array([e is not None for *_, e in held])[each]
    y, x = np.divmod(place, np.array([w or 1 for _, w, *_ in held])[each])
    flat = np.frombuffer(b"".join(b"\0" * 4 if e is not None else p for *_, p, e in held), np.uint8).reshape(-1, 4)
    number = lambda v: pa.array(v.astype(np.int32), mask=bad)
    named = lambda k, kind: pa.array([r[k] for r in held], kind).take(pa.array(each))
    return pa.RecordBatch.from_arrays([named(0, pa.string()), number(y), number(x), named(3, pa.bool_()), *(number(flat[:, k]) for k in range(4)), named(5, pa.string())], [x.split()[0] for x in _PIXELS.split(", ")])


def _pixels(batches):
    held, count = [], 0
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                held.append((path, *read_png(data), None))
            except (ValueError, struct.error, zlib.error) as e:  # a bad file becomes a row that says so
                held.append((path, None, None, None, None, str(e)))
            count += (held[-1][1] or 1) * (held[-1][2] or 1)
            if count >= FRAME:
                yield _frame(held)
                held, count = [], 0
    if held:
        yield _frame(held)


def png_pixels(images: DataFrame) -> DataFrame:
    """images (path, content) -> (path, y, x, srgb, r, g, b, a, error)."""
    return images.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(_pixels, _PIXELS)


def png_files(pixels: DataFrame, key: str = "path", srgb: bool = False) -> DataFrame:
    """pixels (key, y, x, r, g, b, a) -> (key, content): PNG files; an image must fit one task."""

    def file(parts: list[pa.RecordBatch]):
        y, x, *channels = (np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]) for k in range(1, 7))
        grid = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 4), np.uint8)
        grid[y, x] = np.stack(channels, -1)
        return write_png(grid.shape[1], grid.shape[0], grid.tobytes(), srgb)

    def run(batches):
        """Rows stand by image; the last image of a batch may go on in the next one."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = pc.run_end_encode(batch.column(0))
            names, contents, begin = [], [], 0
            for end in keys.run_ends.to_pylist():
                own, begin = batch.slice(begin, end - begin), end
                if held and not held[0].column(0)[0].equals(own.column(0)[0]):
                    names.append(held[0].column(0)[0]), contents.append(file(held))
                    held = []
                held.append(own)
            yield result(names, contents)
        if held:
            yield result([held[0].column(0)[0]], [file(held)])

    def result(names, contents):
        return pa.RecordBatch.from_arrays([pa.array([n.as_py() for n in names], kind), pa.array(contents, pa.binary())], [key, "content"])

    kind = to_arrow_type(pixels.schema[key].dataType)
    rows = spread(pixels.select(key, "y", "x", *"rgba"), key).sortWithinPartitions(key)
    return rows.mapInArrow(run, f"{key} {dict(pixels.dtypes)[key]}, content binary")


@F.pandas_udf(T.BinaryType())
def png_with_srgb(content: pd.Series) -> pd.Series:
    """The same images, marked as sRGB."""

    def one(data):
        width, height, _, rgba = read_png(data)
        return write_png(width, height, rgba, srgb=True)

    return content.map(lambda x: None if x is None else one(bytes(x)))


def level_payloads(containers: DataFrame) -> DataFrame:
    """containers (path, content) -> (path, mip, payload): levels, inflated."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                t = _READERS.get(data[:12], read_dds)(data)
                rows += [(path, k, read_level(data, t["scheme"], level)) for k, level in enumerate(t["levels"])]
            yield pd.DataFrame(rows, columns=["path", "mip", "payload"])

    return containers.select("path", "content").mapInPandas(run, "path string, mip int, payload binary")


def png_header(content):
    """Width and height from the first bytes, without decoding."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.struct(number(17).alias("width"), number(21).alias("height"))
