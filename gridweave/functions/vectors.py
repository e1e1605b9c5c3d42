"""Vector, matrix and scalar math as columns. Vectors are arrays of doubles, matrices arrays of rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

_zero = lambda: F.lit(0.0)


def saturate(x):
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def clamp(x, low, high):
    return F.least(F.greatest(x, low), high)


def lerp(a, b, t):
    return a + (b - a) * t


def step(edge, x):
    return F.when(x >= edge, 1.0).otherwise(0.0)


def smoothstep(low, high, x):
    t = saturate((x - low) / (high - low))
    return t * t * (F.lit(3.0) - t * 2.0)


def fract(x):
    return x - F.floor(x)


def rsqrt(x):
    return F.lit(1.0) / F.sqrt(x)


def recip(x):
    return F.lit(1.0) / x


def mad(x, y, z):
    return x * y + z


def round_even(x):
    return F.rint(x)


def fix_nan(x, other):
    return F.when(F.isnan(x), other).otherwise(x)


def equal_abs(a, b, tolerance):
    return F.abs(a - b) <= tolerance


def equal_rel(a, b, tolerance):
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))


def degrees(x):
    return F.degrees(x)


def first_bit_low(x):
    """Number of the lowest set bit, -1 without one."""
    return F.when(x == 0, -1).otherwise(F.bit_count(x.bitwiseXOR(x - 1)) - 1)


def first_bit_high(x):
    """Number of the highest set bit, -1 without one; x is not negative."""
    return F.when(x == 0, -1).otherwise(F.length(F.bin(x)) - 1)


def reverse_bits(x, bits: int = 32):
    return F.conv(F.rpad(F.reverse(F.bin(x)), bits, "0"), 2, 10).cast("bigint")


# --- vectors


def reduce_add(v):
    return F.aggregate(v, _zero(), lambda a, x: a + x)


def dot(a, b):
    return reduce_add(F.zip_with(a, b, lambda x, y: x * y))


def length_squared(v):
    return dot(v, v)


def length(v):
    return F.sqrt(length_squared(v))


def distance(a, b):
    return length(F.zip_with(a, b, lambda x, y: x - y))


def normalize(v):
    size = length(v)
    return F.transform(v, lambda x: x / size)


def cross(a, b):
    at = lambda v, i: F.element_at(v, i)
    return F.array(*(at(a, i) * at(b, j) - at(a, j) * at(b, i) for i, j in ((2, 3), (3, 1), (1, 2))))


def lerp_vector(a, b, t):
    return F.zip_with(a, b, lambda x, y: x + (y - x) * t)


def reflect(v, n):
    d = dot(v, n) * 2.0
    return F.zip_with(v, n, lambda x, y: x - d * y)


# --- matrices (n x n)


def _at(m: Column, i: int, j: int) -> Column:
    return F.element_at(F.element_at(m, i + 1), j + 1)


def transpose(m, n: int):
    return F.array(*(F.array(*(_at(m, j, i) for j in range(n))) for i in range(n)))


def multiply(a, b, n: int):
    """Row by row: written out, the product is a method too long for the JVM's compiler, and is interpreted."""
    row = lambda own: F.array(*(functools.reduce(lambda x, y: x + y, [F.element_at(own, k + 1) * _at(b, k, j) for k in range(n)]) for j in range(n)))
    return F.transform(F.array(*(F.element_at(a, i + 1) for i in range(n))), row)


def apply(m, v, n: int):
    return F.array(*(functools.reduce(lambda x, y: x + y, [_at(m, i, k) * F.element_at(v, k + 1) for k in range(n)]) for i in range(n)))


def trace(m, n: int):
    return functools.reduce(lambda x, y: x + y, [_at(m, i, i) for i in range(n)])


def _minor(m: Column, rows: list[int], columns: list[int]) -> Column:
    """Determinant of some rows and columns."""
    if len(rows) == 1:
        return _at(m, rows[0], columns[0])
    terms = [_at(m, rows[0], c) * _minor(m, rows[1:], [x for x in columns if x != c]) * (1.0 if k % 2 == 0 else -1.0) for k, c in enumerate(columns)]
    return functools.reduce(lambda x, y: x + y, terms)


def determinant(m, n: int):
    return _minor(m, list(range(n)), list(range(n)))


def inverse3(m):
    """Inverse of a 3 x 3 matrix; null if it has none."""
    d = determinant(m, 3)

    def cofactor(i, j):
        r, c = [x for x in range(3) if x != i], [x for x in range(3) if x != j]
        sign = 1.0 if (i + j) % 2 == 0 else -1.0
        return (_at(m, r[0], c[0]) * _at(m, r[1], c[1]) - _at(m, r[0], c[1]) * _at(m, r[1], c[0])) * sign

    return F.array(*(F.array(*(F.try_divide(cofactor(j, i), d) for j in range(3))) for i in range(3)))


def quaternion_multiply(a, b):
    """(x, y, z, w) arrays."""
    (ax, ay, az, aw), (bx, by, bz, bw) = ([F.element_at(q, i) for i in (1, 2, 3, 4)] for q in (a, b))
    return F.array(aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)


def quaternion_rotate(q, v):
    """v turned by the unit quaternion q."""
    u, w = F.slice(q, 1, 3), F.element_at(q, 4)
    t = F.transform(cross(u, v), lambda x: x * 2.0)
    return F.zip_with(F.zip_with(v, t, lambda x, y: x + w * y), cross(u, t), lambda x, y: x + y)


def slerp(a, b, t):
    """Along the shorter arc; nearly equal quaternions are interpolated linearly."""
    d0 = dot(a, b)
    sign = F.when(d0 < 0, -1.0).otherwise(1.0)
    d = F.least(F.abs(d0), F.lit(1.0))
    angle = F.acos(d)
    wa = F.when(d > 0.9995, F.lit(1.0) - t).otherwise(F.sin((F.lit(1.0) - t) * angle) / F.sin(angle))
    wb = F.when(d > 0.9995, t).otherwise(F.sin(t * angle) / F.sin(angle)) * sign
    return normalize(F.zip_with(a, b, lambda x, y: x * wa + y * wb))


def quaternion_inverse(q):
    """Of a unit quaternion."""
    return F.array(*(-F.element_at(q, i) for i in (1, 2, 3)), F.element_at(q, 4))


def quaternion_lerp(a, b, t):
    return normalize(lerp_vector(a, b, t))


def bezier(a, b, c, d, t):
    """Cubic curve through a and d with the control points b and c; columns or vectors' components."""
    s = F.lit(1.0) - t
    return a * s * s * s + b * s * s * t * 3.0 + c * s * t * t * 3.0 + d * t * t * t


# --- more scalars


def frexp(x):
    """(mantissa in [0.5, 1), exponent) with x = mantissa * 2^exponent; zero gives zeros."""
    exponent = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log2(F.abs(x))).cast("int") + 1)
    return F.struct((x / F.pow(F.lit(2.0), exponent)).alias("mantissa"), exponent.alias("exponent"))


def fmod(x, y):
    """Remainder with the sign of x."""
    return x - y * trunc(x / y)


def trunc(x):
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def min3(a, b, c):
    return F.least(a, b, c)


def max3(a, b, c):
    return F.greatest(a, b, c)


def select(a, b, condition):
    """b where the condition holds, else a."""
    return F.when(condition, b).otherwise(a)


def bitselect(a, b, mask):
    """Bits of b where the mask has ones, of a elsewhere."""
    return a.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(b.bitwiseAND(mask))


def refract(v, n, eta):
    """Direction v refracted at the normal n; zeros on total reflection."""
    d = dot(v, n)
    k = F.lit(1.0) - eta * eta * (F.lit(1.0) - d * d)
    return F.zip_with(v, n, lambda x, y: F.when(k < 0, 0.0).otherwise(eta * x - (eta * d + F.sqrt(F.greatest(k, F.lit(0.0)))) * y))


# --- more matrices


def add(a, b):
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda p, q: p + q))


def subtract(a, b):
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda p, q: p - q))


def inverse(m, n: int):
    """Inverse by cofactors; entries are null where there is none. m had better be a column: it is named many times."""
    rest = lambda i: [x for x in range(n) if x != i]
    cofactors = F.array(*(F.array(*(_minor(m, rest(j), rest(i)) * (1.0 if (i + j) % 2 == 0 else -1.0) for j in range(n))) for i in range(n)))
    d = determinant(m, n)
    return F.transform(cofactors, lambda row: F.transform(row, lambda x: F.try_divide(x, d)))


def matrix(rows: list) -> Column:
    """A matrix of numbers and columns."""
    return F.array(*(F.array(*(x if isinstance(x, Column) else F.lit(float(x)) for x in r)) for r in rows))


def translation(x, y, z):
    return matrix([[1, 0, 0, x], [0, 1, 0, y], [0, 0, 1, z], [0, 0, 0, 1]])


def scaling(x, y, z):
    return matrix([[x, 0, 0, 0], [0, y, 0, 0], [0, 0, z, 0], [0, 0, 0, 1]])


def rotation_z(angle):
    c, s = F.cos(angle), F.sin(angle)
    return matrix([[c, -s, 0, 0], [s, c, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])


def orthographic(width, height, near, far):
    """View box to -1..1 in x and y, 0..1 in depth; the view looks along -z."""
    depth = far - near
    return matrix([[F.lit(2.0) / width, 0, 0, 0], [0, F.lit(2.0) / height, 0, 0], [0, 0, F.lit(-1.0) / depth, -near / depth], [0, 0, 0, 1]])


def perspective(fov_y, aspect, near, far):
    """Right-handed projection to depth 0..1; fov_y in radians."""
    h = F.lit(1.0) / F.tan(fov_y / 2)
    z = far / (near - far)
    return matrix([[h / aspect, 0, 0, 0], [0, h, 0, 0], [0, 0, z, z * near], [0, 0, -1, 0]])


def decompose(m) -> Column:
    """(translation, scale) of an affine 4 x 4 matrix: the last column, and the lengths of the first three."""
    column = lambda j: F.array(*(_at(m, i, j) for i in range(3)))
    return F.struct(column(3).alias("translation"), F.array(*(length(column(j)) for j in range(3))).alias("scale"))
