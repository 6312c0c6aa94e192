"""The batch rules about late and repeated data as streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import newest_wins


def before_event(df: DataFrame, captured: str, event: str) -> DataFrame:
    """Rows captured before their event; later ones are late and left out."""
    return df.where(F.col(captured) < F.col(event))


def once_by_content(df: DataFrame, columns: list[str], at: str, delay: str) -> DataFrame:
    """Each content once, with state kept for the delay only."""
    hashed = df.withColumn("_h", F.sha2(F.to_json(F.struct(*sorted(columns))), 256))
    return hashed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["_h"]).drop("_h")


def week_blocks(df: DataFrame, at: str, groups: list[str], offset_days: int = 0, grace: str = "6 hours", zone_hours: int = 8) -> DataFrame:
    """Counts of seven-day blocks that begin on Thursdays at the zone's midnight and stay open for the grace period.

    The epoch day was a Thursday, so blocks counted from it begin on one.
    """
    start = f"{offset_days * 24 + zone_hours} hours"
    w = F.window(F.col(at), "7 days", "7 days", start)
    return df.withWatermark(at, grace).groupBy(w.alias("block"), *groups).agg(F.count("*").alias("n"), F.max(at).alias("last_at"))


def upsert_newest(read_current: Callable[[], DataFrame], write: Callable[[DataFrame], None], keys: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges a micro-batch into a table, the newest version of a key winning."""

    def merge(batch: DataFrame, _: int) -> None:
        write(newest_wins(read_current(), batch, keys, version))

    return merge


def keep_locked(previous: DataFrame, computed: DataFrame, keys: list[str], event: str, now) -> DataFrame:
    """Rows of the last result whose event has passed stay as they are; all others are the new ones."""
    locked = previous.where(F.col(event) <= F.lit(now))
    return locked.unionByName(computed.join(locked.select(*keys), keys, "left_anti"), allowMissingColumns=True)
