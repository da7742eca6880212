"""Equi-joins that survive a key holding a large share of the left rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: No key below this many rows counts as hot; a hot key is split in parts of about so many rows.
HOT_ROWS = 50_000
#: A hot key holds at least this share of all rows, so there are at most 1 / HOT_SHARE of them and their list may be broadcast.
HOT_SHARE = 0.001


def hot_keys(left: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys of at least ``hot_rows`` rows and ``HOT_SHARE`` of all rows, 1,000 keys at most, with the number of their parts."""
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"))
    hot = counts.where(F.col("__n") >= hot_rows).join(F.broadcast(total), F.col("__n") >= F.col("__all") * HOT_SHARE)
    return hot.select(*keys, F.ceil(F.col("__n") / hot_rows).cast("int").alias("__parts"))


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", *, spread: Column, hot_rows: int = HOT_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """``left`` joined to ``right`` on ``keys``, ``how`` being ``left`` or ``inner``.

    Hot keys (see :func:`hot_keys`) are split by a salt taken from ``spread`` (a column of ``left`` that differs within a
    key); only their right rows are repeated, once a part.  Null keys match nothing and are spread by the same column.
    ``counted`` is a table to count the keys in, where ``left`` is costly and has them as often.
    """
    hot = F.broadcast(hot_keys(left if counted is None else counted, keys, hot_rows))
    own = F.xxhash64("__spread")
    null = reduce(or_, [F.col(k).isNull() for k in keys])
    a = left.withColumn("__spread", spread).join(hot, keys, "left").withColumn("__salt", F.when(null, own).otherwise(F.pmod(own, F.coalesce("__parts", F.lit(1)).cast("long")))).drop("__parts", "__spread")
    b = right.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__parts", F.lit(1)).cast("long") - 1))).drop("__parts")
    return a.join(b, [*keys, "__salt"], how).drop("__salt")
