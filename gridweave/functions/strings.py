"""String functions as columns."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def nice_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def truncate(name: Column, longest: int = 70) -> Column:
    """Names above `longest` characters keep the first longest - 2 and get three dots."""
    return F.when(F.length(name) > longest, F.concat(F.substring(name, 1, longest - 2), F.lit("..."))).otherwise(name)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; empty without one."""
    return F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def is_header(path: Column) -> Column:
    """No extension, or one that starts with h or i; a trailing dot is no header."""
    base = file_name(path)
    return base.rlike(r"^[^.]*$") | base.rlike(r"(?i)\.[hi][^.]*$")


def object_name(path: Column) -> Column:
    """Build traces are named after their object files."""
    return F.regexp_replace(path, r"(?i)\.json$", ".o")


def short_directory(path: Column) -> Column:
    """The last two folders of a path."""
    parts = F.split(path, "/")
    return F.concat_ws("/", F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.least(F.size(parts) - 1, F.lit(2))))


def strip_namespaces(name: Column, namespaces: tuple[str, ...] = ("std::", "eastl::")) -> Column:
    return functools.reduce(lambda c, n: F.replace(c, F.lit(n), F.lit("")), namespaces, name)


def bytes_text(n: Column) -> Column:
    """Whole units: 2047 gives 1 KiB."""
    unit = lambda name, bits: F.concat(F.shiftright(n, bits).cast("string"), F.lit(f" {name}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, unit("KiB", 10)).when(n < 1 << 30, unit("MiB", 20)).otherwise(unit("GiB", 30))


def collapse_name(name: Column) -> Column:
    """Each outermost <...> becomes <$>. Names with "operator" in them, or with unbalanced brackets, stay.

    One fold over the runs between brackets, so it stays in the JVM: state is (depth, text, broken). Text grows at outermost brackets only.
    """
    zero = F.struct(F.lit(0).alias("d"), F.lit("").alias("t"), F.lit(False).alias("x"))

    def step(s, part):
        opens, closes = part.startswith("<"), part.startswith(">")
        depth = s["d"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        text = F.when(opens & (s["d"] == 0), F.concat(s["t"], F.lit("<$"))).when(closes & (s["d"] == 1), F.concat(s["t"], part)).when((depth > 0) | opens | (s["d"] > 0), s["t"]).otherwise(F.concat(s["t"], part))
        return F.struct(depth.alias("d"), text.alias("t"), (s["x"] | (depth < 0)).alias("x"))

    folded = F.aggregate(F.split(name, "(?=[<>])"), zero, step)
    plain = name.contains("operator") | ~name.contains("<")
    return F.when(plain, name).otherwise(F.when((folded["d"] != 0) | folded["x"], name).otherwise(folded["t"]))


def fnv1(text: Column) -> Column:
    """32-bit hash that multiplies, then xors each byte taken as signed; 0 to 2^32 - 1."""
    from .hashing import fnv1_udf

    return fnv1_udf(text)


def js_escape(text: Column) -> Column:
    """Line and paragraph separators are no valid characters of a script."""
    return F.replace(F.replace(text, F.lit(" "), F.lit("\\u2028")), F.lit(" "), F.lit("\\u2029"))


def percent_text(part: Column, whole: Column) -> Column:
    return F.format_string("%.1f%%", F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)))


def duration_text(seconds: Column, memory: Column) -> Column:
    """Three decimals and a unit; nothing for zero."""
    return F.when(seconds == 0, F.lit("")).otherwise(F.concat(F.format_string("%.3f", seconds), F.when(memory, "m").otherwise("s")))


def ends_with(text: Column, end: str, ignore_case: bool = False) -> Column:
    return F.lower(text).endswith(end.lower()) if ignore_case else text.endswith(end)


def count_text(n: Column) -> Column:
    """Groups of three digits."""
    return F.format_number(n, 0)


def hex_text(n: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(n)))
