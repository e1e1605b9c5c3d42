"""Lookups by a key that may be very unevenly used.

Misra-Gries counters (Spark's freqItems) name every value that more than SUPPORT of the rows hold, and at most 1/SUPPORT
values in all, whatever the input's size; that list alone is broadcast. Rows with such a key, or with none, are dealt by key and
salt, and the looked-up row of each such key is repeated for every salt, so no task gets more than a salt's share of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free_name

#: Share of the rows from which a value's rows are spread; tasks over which they are spread.
SUPPORT, SALTS = 1 / 1000, 128


def heavy_hashes(rows: DataFrame, key: str, name: str, support: float = SUPPORT) -> DataFrame:
    """(name): xxhash64 of at most 1/support values of a column, all of those that more than `support` of the rows hold among them.

    Counters compare keys as objects, which would tell equal byte strings apart, so they get 64-bit hashes.
    """
    hashed = rows.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"))
    return hashed.freqItems(["h"], support).select(F.explode("h_freqItems").alias(name))


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """left joined with right, which has at most one row per key; how: inner or left. The key's column of left is scanned once more."""
    both = left.join(right, key)
    hashed, flag, salt = (free_name(both, x) for x in ("__hash", "__heavy", "__salt"))
    heavy = F.broadcast(heavy_hashes(left, key, hashed).withColumn(flag, F.lit(True)))
    marked = lambda df: df.withColumn(hashed, F.xxhash64(key)).join(heavy, hashed, "left").drop(hashed)
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    dealt = marked(left).withColumn(salt, F.when(F.col(flag) | F.col(key).isNull(), spread).otherwise(0)).drop(flag)
    every = F.when(F.col(flag), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = marked(right).withColumn(salt, F.explode(every)).drop(flag)
    return dealt.join(repeated, [key, salt], how).drop(salt)
