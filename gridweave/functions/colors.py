"""Color and quantisation functions as columns."""

from __future__ import annotations

from pyspark.sql import functions as F


def srgb_to_linear(x):
    """x in 0..1."""
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(x):
    return F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(x, F.lit(1 / 2.4)) * 1.055 - 0.055)


def to_unorm8(x):
    """0..1 to 0..255, half to even."""
    return F.rint(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255.0).cast("int")


def to_snorm8(x):
    """-1..1 to -127..127, half to even, then shifted to 1..255."""
    return (F.rint(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) * 127.0) + 128).cast("int")


def premultiply(c, a):
    """Integer product, truncated."""
    return F.expr("0").cast("int") + F.floor(c * a / 255).cast("int")


def rec709(r, g, b):
    """Luma of linear channels."""
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def reconstruct_z(x, y):
    """Third part of a unit normal; the first two are kept below 0.999 in length."""
    return F.sqrt(F.lit(1.0) - F.least(x * x + y * y, F.lit(0.998001)))


def remap_to_signed(endpoint):
    """Unsigned endpoint 0..255 to signed -128..127."""
    return endpoint - 128


def remap_from_signed(endpoint):
    return endpoint + 128
