"""Grids that spread the cells of a join whose key may be very frequent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

BROADCAST_ROWS = 100_000


def grid(left: DataFrame, right: DataFrame, keys: list[str], left_salt: Column, right_salt: Column, left_cap: int, right_cap: int) -> tuple[DataFrame, DataFrame, bool]:
    """Both sides with columns sa and sb, so that (keys, sa, sb) cells meet every pair just once.

    A key with at most left_cap left and right_cap right rows stays one cell. A hotter one is
    divided into na parts of left rows and nb parts of right rows; left rows are repeated for
    each part of the right and the other way round. The list of hot keys has at most
    rows / cap entries; it is broadcast only if it was counted to be small. Tells whether any
    key was divided.
    """
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    counts = (
        left.select(*keys, one.alias("q"), zero.alias("m"))
        .unionByName(right.select(*keys, zero.alias("q"), one.alias("m")))
        .groupBy(*keys)
        .agg(F.sum("q").alias("q"), F.sum("m").alias("m"))
        .where((F.col("q") > left_cap) | (F.col("m") > right_cap))
        .where("q > 0 and m > 0")
    )
    na = F.ceil(F.col("q") / left_cap).cast("int")
    nb = F.ceil(F.col("m") / right_cap).cast("int")
    hot = cut(counts.select(*keys, na.alias("na"), nb.alias("nb")))
    n = hot.count()
    if not n:
        return tuple(d.withColumn("sa", F.lit(0)).withColumn("sb", F.lit(0)) for d in (left, right)) + (False,)
    small = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
    part = lambda c, k: F.pmod(F.xxhash64(F.lit(7), c), k).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    left = left.join(small, keys, "left").na.fill(1, ["na", "nb"])
    left = left.withColumn("sa", part(left_salt, F.col("na"))).withColumn("sb", every(F.col("nb"))).drop("na", "nb")
    right = right.join(small, keys, "left").na.fill(1, ["na", "nb"])
    right = right.withColumn("sb", part(right_salt, F.col("nb"))).withColumn("sa", every(F.col("na"))).drop("na", "nb")
    return left, right, True
