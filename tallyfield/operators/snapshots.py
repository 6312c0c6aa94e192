"""Changes between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Rows and characters of the list of steps up to which it is sent to every executor; longer lists are joined.
BROADCAST_STEPS, BROADCAST_CHARS = 200_000, 16_000_000


def row_hash(columns: list[Column]) -> Column:
    """64-bit hash of the columns in which null differs from every value and keeps its place."""
    parts: list[Column] = []
    for c in columns:
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)


def two_decimals(c: Column) -> Column:
    """The value in whole hundredths; NaN becomes its own mark, null stays null."""
    nan = F.isnan(c.cast("double"))
    return F.when(nan, F.lit(-(2**62))).otherwise(F.round(F.nanvl(c.cast("double"), F.lit(0.0)) * 100).cast("long")).cast("long")


def delivered_steps(rows: DataFrame) -> DataFrame:
    """(_e, _s, _next, _first): each entity's snapshots in order of _o, then _s.

    One aggregation, whose state is the entity's distinct (snapshot, order) pairs. If rows of one
    snapshot differ in their order, the least counts.
    """
    pairs = F.array_sort(F.collect_set(F.struct("_s", "_o")))
    each = F.filter(F.col("p"), lambda x, i: (i == 0) | (x["_s"] != F.get(F.col("p"), i - 1)["_s"]))
    line = rows.groupBy("_e").agg(pairs.alias("p")).select("_e", F.array_sort(F.transform(each, lambda x: F.struct(x["_o"].alias("_o"), x["_s"].alias("_s")))).alias("p"))
    return line.select("_e", F.posexplode("p").alias("_i", "_x"), "p").select("_e", F.col("_x._s").alias("_s"), F.get(F.col("p"), F.col("_i") + 1)["_s"].alias("_next"), (F.col("_i") == 0).alias("_first"))


def snapshot_changes(
    df: DataFrame,
    entity: str,
    snapshot: str,
    order: str,
    key: str,
    compared: list[Column],
) -> DataFrame:
    """One row for each key that was added, removed or changed between consecutive snapshots.

    Every row is tagged twice: as the later side of its own snapshot and as the earlier side
    of the next delivered one. One aggregation over (entity, snapshot, key) then holds both
    sides' row hashes, and is the only shuffle of the rows. The order of an entity's snapshots
    comes from its distinct (snapshot, order) pairs; that list of steps is measured, and
    broadcast only up to BROADCAST_STEPS rows and BROADCAST_CHARS characters.

    Repeated rows of a key count once; if they differ, the least hash stands for the key, so
    the result doesn't depend on the order of rows. Rows with a null entity, snapshot,
    order or key are in no snapshot and are left out. An empty table gives no rows. Other
    columns of the input are never read.
    """
    rows = df.select(
        F.col(entity).alias("_e"), F.col(snapshot).alias("_s"), F.col(order).alias("_o"), F.col(key).alias("_k"), row_hash(compared).alias("_h")
    ).where("_e is not null and _s is not null and _o is not null and _k is not null")
    steps = cut(delivered_steps(rows))
    size = steps.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.concat_ws("|", *[F.col(c).cast("string") for c in ("_e", "_s", "_next")]))), F.lit(0)).alias("chars")).first()
    if size["n"] <= BROADCAST_STEPS and size["chars"] <= BROADCAST_CHARS:
        steps = F.broadcast(steps)
    sides = rows.join(steps, ["_e", "_s"]).select(
        "_e",
        "_k",
        F.explode(
            F.array(
                F.struct(F.when(~F.col("_first"), F.col("_s")).alias("at"), F.lit(None).cast("long").alias("old"), F.col("_h").alias("new")),
                F.struct(F.col("_next").alias("at"), F.col("_h").alias("old"), F.lit(None).cast("long").alias("new")),
            )
        ).alias("_x"),
    )
    both = (
        sides.where("_x.at is not null")
        .groupBy("_e", F.col("_x.at").alias("_s"), "_k")
        .agg(F.min("_x.old").alias("_old"), F.min("_x.new").alias("_new"))
    )
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return both.select(
        F.col("_e").alias(entity), F.col("_s").alias(snapshot), F.col("_k").alias(key), kind.alias("change_kind")
    ).where("change_kind is not null")
