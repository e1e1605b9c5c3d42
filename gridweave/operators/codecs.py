"""Block and explicit pixel formats in numpy, as a registry that other codecs can join, and their use on tables of levels."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import spread
from ..sources.containers import SHAPE as FORMAT_SHAPE
from ..sources.containers import read_dds, read_ktx1, read_ktx2, read_level, write_ktx1

#: format -> function (bytes, width, height) -> uint8 or float array (height, width, 4)
DECODERS: dict[str, Callable] = {}
#: format -> function (array (height, width, 4)) -> bytes
ENCODERS: dict[str, Callable] = {}
#: Formats whose blocks stand in rows from the top: images of one width, one above the other, are coded as one.
STACKED: set[str] = set()


def register(name: str, decode: Callable | None = None, encode: Callable | None = None, stacked: bool = False) -> None:
    """Adds or replaces the codec of a format. stacked: both take images one above the other as one image, of whole blocks each."""
    STACKED.add(name) if stacked else STACKED.discard(name)
    if decode:
        DECODERS[name] = decode
    if encode:
        ENCODERS[name] = encode


def _tiles(pixels: np.ndarray) -> np.ndarray:
    """(rows * columns, 16, channels): 4 x 4 tiles, edges repeated."""
    h, w = pixels.shape[:2]
    p = np.pad(pixels, ((0, -h % 4), (0, -w % 4), (0, 0)), mode="edge")
    a, b = p.shape[0] // 4, p.shape[1] // 4
    return p.reshape(a, 4, b, 4, -1).transpose(0, 2, 1, 3, 4).reshape(a * b, 16, -1)


def _untile(tiles: np.ndarray, width: int, height: int) -> np.ndarray:
    a, b = -(-height // 4), -(-width // 4)
    return tiles.reshape(a, b, 4, 4, -1).transpose(0, 2, 1, 3, 4).reshape(a * 4, b * 4, -1)[:height, :width]


def _indices(packed: np.ndarray, bits: int) -> np.ndarray:
    """16 indices of `bits` bits from little-endian bytes, for each block."""
    flat = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), 16, bits)
    return (flat * (1 << np.arange(bits))).sum(2)


def _pack_indices(index: np.ndarray, bits: int) -> np.ndarray:
    flat = (index[:, :, None] >> np.arange(bits)) & 1
    return np.packbits(flat.reshape(len(index), 16 * bits).astype(np.uint8), axis=1, bitorder="little")


def _from565(c: np.ndarray) -> np.ndarray:
    r, g, b = (c >> 11) & 31, (c >> 5) & 63, c & 31
    return np.stack(((r << 3) | (r >> 2), (g << 2) | (g >> 4), (b << 3) | (b >> 2)), -1)


def _to565(c: np.ndarray) -> np.ndarray:
    r, g, b = (np.rint(c[:, k] * m / 255).astype(np.int64) for k, m in enumerate((31, 63, 31)))
    return (r << 11) | (g << 5) | b


def _colors(blocks: np.ndarray, four: bool) -> np.ndarray:
    ends = blocks[:, :4].copy().view("<u2").astype(np.int64)
    a, b = _from565(ends[:, 0]), _from565(ends[:, 1])
    opaque = (ends[:, 0] > ends[:, 1])[:, None] | four
    table = np.stack((a, b, np.where(opaque, (2 * a + b) // 3, (a + b) // 2), np.where(opaque, (a + 2 * b) // 3, 0)), 1)
    alpha = np.full((len(blocks), 4), 255)
    alpha[:, 3] = np.where(opaque[:, 0], 255, 0)
    table = np.concatenate((table, alpha[:, :, None]), 2)
    return np.take_along_axis(table, _indices(blocks[:, 4:8], 2)[:, :, None], 1)


def _single(blocks: np.ndarray) -> np.ndarray:
    """One 8-bit channel: two ends and 16 indices of 3 bits."""
    a, b = blocks[:, 0].astype(np.int64), blocks[:, 1].astype(np.int64)
    eight = [a, b] + [((7 - k) * a + k * b) // 7 for k in range(1, 7)]
    six = [a, b] + [((5 - k) * a + k * b) // 5 for k in range(1, 5)] + [np.zeros_like(a), np.full_like(a, 255)]
    table = np.where((a > b)[:, None], np.stack(eight, 1), np.stack(six, 1))
    return np.take_along_axis(table, _indices(blocks[:, 2:8], 3), 1)


def _blocks(data: bytes, size: int, width: int, height: int) -> np.ndarray:
    n = -(-width // 4) * -(-height // 4)
    return np.frombuffer(data, np.uint8, n * size).reshape(n, size)


def decode_bc1(data, width, height):
    return _untile(_colors(_blocks(data, 8, width, height), False), width, height).astype(np.uint8)


def decode_bc3(data, width, height):
    b = _blocks(data, 16, width, height)
    out = _colors(b[:, 8:], True)
    out[:, :, 3] = _single(b[:, :8])
    return _untile(out, width, height).astype(np.uint8)


def _channels(n: int):
    def decode(data, width, height):
        b = _blocks(data, 8 * n, width, height)
        out = np.zeros((len(b), 16, 4), np.int64)
        out[:, :, 3] = 255
        for k in range(n):
            out[:, :, k] = _single(b[:, 8 * k : 8 * k + 8])
        return _untile(out, width, height).astype(np.uint8)

    def encode(pixels):
        t = _tiles(np.asarray(pixels)).astype(np.int64)
        return np.concatenate([_fit_single(t[:, :, k]) for k in range(n)], 1).tobytes()

    return decode, encode


def _fit_single(v: np.ndarray) -> np.ndarray:
    """Range fit: the ends are the largest and smallest value."""
    a, b = v.max(1), v.min(1)
    table = np.stack([a, b] + [((7 - k) * a + k * b) // 7 for k in range(1, 7)], 1)
    index = np.abs(v[:, :, None] - table[:, None, :]).argmin(2)
    index[a == b] = 0
    return np.concatenate((np.stack((a, b), 1).astype(np.uint8), _pack_indices(index, 3)), 1)


def encode_bc1(pixels):
    """Range fit along the box's diagonal; opaque."""
    t = _tiles(np.asarray(pixels))[:, :, :3].astype(np.int64)
    a, b = _to565(t.max(1)), _to565(t.min(1))
    p, q = _from565(a), _from565(b)
    table = np.stack((p, q, (2 * p + q) // 3, (p + 2 * q) // 3), 1)
    index = ((t[:, :, None] - table[:, None]) ** 2).sum(3).argmin(2)
    index[a == b] = 0
    return np.concatenate((np.stack((a, b), 1).astype("<u2").view(np.uint8), _pack_indices(index, 2)), 1).tobytes()


def _explicit(channels: int, kind: str):
    one = 255 if kind == "u1" else 1.0

    def decode(data, width, height):
        v = np.frombuffer(data, f"<{kind}", width * height * channels).reshape(height, width, channels)
        out = np.zeros((height, width, 4), np.uint8 if kind == "u1" else np.float32)
        out[..., 3] = one
        out[..., :channels] = v
        return out

    def encode(pixels):
        return np.ascontiguousarray(np.asarray(pixels)[..., :channels]).astype(f"<{kind}").tobytes()

    return decode, encode


for _suffix in ("", "s"):
    register(f"BC1{_suffix}", decode_bc1, encode_bc1, stacked=True)
    register(f"BC3{_suffix}", decode_bc3, stacked=True)
register("BC4", *_channels(1), stacked=True)
register("BC5", *_channels(2), stacked=True)
for _n, _c in ((1, "r"), (2, "rg"), (4, "rgba")):
    for _kind, _bits in (("u1", "8"), ("f2", "16f"), ("f4", "32f")):
        register(f"EXP{_c}{_bits}", *_explicit(_n, _kind), stacked=True)
register("EXPsrgba8", *_explicit(4, "u1"), stacked=True)


def decode(name: str, data: bytes, width: int, height: int) -> np.ndarray:
    if name not in DECODERS:
        raise ValueError(f"no decoder for {name}; add one with register()")
    return DECODERS[name](data, width, height)


def _together(keys: list[tuple]) -> list[list[int]]:
    """Places of equal keys; formats that don't stack stay alone."""
    groups: dict[tuple, list[int]] = {}
    for k, key in enumerate(keys):
        groups.setdefault(key if key[0] in STACKED else (*key, k), []).append(k)
    return list(groups.values())


def decode_all(parts: list[tuple[str, bytes, int, int]]) -> list:
    """Pixels of many levels (format, bytes, width, height), those of one format and size at once; the error in place of one that cannot be decoded."""
    out: list = [None] * len(parts)
    for places in _together([(name, w, h) for name, _, w, h in parts]):
        name, _, w, h = parts[places[0]]
        if name in STACKED:
            bx, by, unit = FORMAT_SHAPE[name]
            size, tall = -(-w // bx) * -(-h // by) * unit, -(-h // by) * by
            whole = [k for k in places if len(parts[k][1]) >= size]
            if whole:
                grid = decode(name, b"".join(parts[k][1][:size] for k in whole), w, tall * len(whole)).reshape(len(whole), tall, w, -1)[:, :h]
                for k, own in zip(whole, grid, strict=True):
                    out[k] = own
        for k in places:
            if out[k] is None:
                try:
                    out[k] = decode(*parts[k])
                except ValueError as e:
                    out[k] = e
    return out


def encode_all(name: str, grids: list[np.ndarray]) -> list[bytes]:
    """Bytes of many images, those of one size at once."""
    out: list = [b""] * len(grids)
    for places in _together([(name, *g.shape) for g in grids]):
        if len(places) == 1:
            out[places[0]] = ENCODERS[name](grids[places[0]])
            continue
        by = FORMAT_SHAPE[name][1]
        stack = np.stack([grids[k] for k in places])
        stack = np.pad(stack, ((0, 0), (0, -stack.shape[1] % by), (0, 0), (0, 0)), mode="edge")
        data = ENCODERS[name](stack.reshape(-1, *stack.shape[2:]))
        size = len(data) // len(places)
        for at, k in enumerate(places):
            out[k] = data[at * size : (at + 1) * size]
    return out


def _packed(data: bytes, mip: int):
    """(format, bytes, width, height) of a level; None if there is none."""
    read = {b"\xabKTX 11\xbb": read_ktx1, b"\xabKTX 20\xbb": read_ktx2}.get(data[:8], read_dds)
    t = read(data)
    if mip >= len(t["levels"]):
        return None
    return t["format"], read_level(data, t["scheme"], t["levels"][mip]), max(1, t["width"] >> mip), max(1, t["height"] >> mip)


def _level(data: bytes, mip: int):
    """(width, height, pixels) of a level; None if there is none."""
    found = _packed(data, mip)
    return found and (*found[2:], decode(*found))


_PIXELS = "path string, mip int, y int, x int, r double, g double, b double, a double, error string"
#: Pixels of a frame that goes back to Spark, about: a frame for each image would cost far more than its pixels.
FRAME = 200_000


def _frame(mip: int, found: list[tuple]) -> pd.DataFrame:
    """Rows of images (path, width, height, pixels, error); one without pixels is a row with its error."""
    sizes = np.array([1 if grid is None else w * h for _, w, h, grid, _ in found])
    each = np.repeat(np.arange(len(found)), sizes)
    place = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    good = np.array([grid is not None for *_, grid, _ in found])[each]
    y, x = np.divmod(place, np.array([w or 1 for _, w, *_ in found])[each])
    flat = np.concatenate([np.zeros((1, 4)) if grid is None else grid.astype(float).reshape(-1, 4) for *_, grid, _ in found])
    masked = lambda v, kind: pd.Series(pd.array(v, kind)).mask(~good)
    rows = {"path": np.array([p for p, *_ in found], object)[each], "mip": np.full(len(each), mip, np.int32), "y": masked(y, "Int32"), "x": masked(x, "Int32")}
    return pd.DataFrame(rows | {c: masked(flat[:, k], "Float64") for k, c in enumerate("rgba")} | {"error": np.array([e for *_, e in found], object)[each]})


def _pixels(mip: int):
    def frame(paths, parts):
        good = [k for k, x in enumerate(parts) if not isinstance(x, Exception)]
        for k, grid in zip(good, decode_all([parts[k] for k in good]), strict=True):
            parts[k] = grid if isinstance(grid, Exception) else (*parts[k][2:], grid)
        return _frame(mip, [(p, None, None, None, str(x)) if isinstance(x, Exception) else (p, *x, None) for p, x in zip(paths, parts, strict=True)])

    def run(batches):
        paths, parts, count = [], [], 0
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = _packed(data, mip)
                except (ValueError, RuntimeError, struct.error, zlib.error) as e:  # a bad file or unknown format becomes a row that says so
                    found = e
                if found:
                    paths.append(path), parts.append(found)
                    count += 1 if isinstance(found, Exception) else found[2] * found[3]
                if count >= FRAME:
                    yield frame(paths, parts)
                    paths, parts, count = [], [], 0
        if parts:
            yield frame(paths, parts)

    return run


def texture_pixels(containers: DataFrame, mip: int = 0) -> DataFrame:
    """containers (path, content) -> (path, mip, y, x, r, g, b, a, error): missing channels are 0, missing alpha is opaque."""
    return spread(containers.select("path", "content"), "path").mapInPandas(_pixels(mip), _PIXELS)


def thumbnails(containers: DataFrame, largest: int = 256) -> DataFrame:
    """containers (path, content) -> (path, width, height, rgba): the largest level of at most `largest` a side; the smallest if all are larger. 8-bit formats."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                mip, level = 0, _level(data, 0)
                while max(level[:2]) > largest and (smaller := _level(data, mip + 1)):
                    mip, level = mip + 1, smaller
                rows.append((path, level[0], level[1], level[2].astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "rgba"])

    return containers.select("path", "content").mapInPandas(run, "path string, width int, height int, rgba binary")


def decoded(containers: DataFrame, format: str = "EXPrgba8") -> DataFrame:
    """containers (path, content) -> (path, content): KTX files of an explicit format with all levels decoded."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                levels, mip = [], 0
                while found := _level(data, mip):
                    levels.append(found)
                    mip += 1
                rows.append((path, write_ktx1(format, levels[0][0], levels[0][1], [ENCODERS[format](x[2]) for x in levels])))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return containers.select("path", "content").mapInPandas(run, "path string, content binary")


def encoded(images: DataFrame, format: str) -> DataFrame:
    """images (path, width, height, rgba: bytes of one level) -> (path, format, width, height, levels): textures for a container sink, by the registered encoder."""

    @F.pandas_udf(T.ArrayType(T.BinaryType()))
    def encode(width: pd.Series, height: pd.Series, rgba: pd.Series) -> pd.Series:
        grid = lambda w, h, x: np.frombuffer(x, np.uint8).reshape(int(h), int(w), 4)
        out, held, count = [], [], 0
        for w, h, x in zip(width, height, rgba, strict=True):
            held.append(grid(w, h, x))
            count += held[-1].size // 4
            if count >= FRAME:
                out, held, count = out + encode_all(format, held), [], 0
        return pd.Series([[x] for x in out + encode_all(format, held)], dtype=object)

    if format not in ENCODERS:
        raise ValueError(f"no encoder for {format}; add one with register()")
    images = spread(images.select("path", "width", "height", "rgba"), "path")
    return images.select("path", F.lit(format).alias("format"), "width", "height", encode("width", "height", "rgba").alias("levels"))
