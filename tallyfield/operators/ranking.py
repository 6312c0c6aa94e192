"""Ranks, windows over earlier rows, selections before an event and pool trimming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def ranked_top_n(df: DataFrame, groups: list[str], order: list[Column], n: int | None, rank: str = "rank") -> DataFrame:
    """Rows with their place in a group under a total order, the first n if n is given.

    With n the planner cuts each partition to n rows of a group before the shuffle.
    """
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked if n is None else ranked.where(F.col(rank) <= n)


def top_by_limits(df: DataFrame, group: str, order: list[Column], limits: dict[str, int]) -> DataFrame:
    """The first rows of each group, as many as its own limit; groups without a limit give none."""
    cap = F.element_at(F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))]), F.col(group))
    top = ranked_top_n(df.where(F.col(group).isin(*limits)), [group], order, max(limits.values()), "_rn")
    return top.where(F.col("_rn") <= cap).drop("_rn")


def with_average_rank(df: DataFrame, value: str, groups: list[str], rank: str, percentile: str | None = None) -> DataFrame:
    """Rows with the average rank of a value in its group and, if named, the rank over the number of values.

    Ties share the mean of their ranks; null values have none. Values are counted first and the
    counts summed up over ranges, so a few large groups spread over all tasks.
    """
    names = [f"_g{i}" for i in range(len(groups))]
    keys = [F.col(g).alias(n) for g, n in zip(groups, names)]
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_value")).agg(F.count("*").alias("_count"))
    upto = running_total(counts, "_value", "_count", "_upto", keys=names)
    sizes = counts.groupBy(*names).agg(F.sum("_count").alias("_size")) if names else counts.agg(F.sum("_count").alias("_size"))
    place = upto.withColumn("_rank", F.col("_upto") - (F.col("_count") - 1) / 2)
    same = F.col(value) == F.col("_value")
    for g, n in zip(groups, names):
        same = same & F.col(g).eqNullSafe(F.col(n))
    out = df.join(place.select(*names, "_value", "_rank"), same, "left").drop(*names, "_value").withColumnRenamed("_rank", rank)
    if percentile is None:
        return out
    if not names:
        return out.crossJoin(F.broadcast(sizes)).withColumn(percentile, F.col(rank) / F.col("_size")).drop("_size")
    own = F.lit(True)
    for g, n in zip(groups, names):
        own = own & F.col(g).eqNullSafe(F.col(n))
    return out.join(sizes, own, "left").withColumn(percentile, F.col(rank) / F.col("_size")).drop(*names, "_size")


def lagged_mean(value: str, groups: list[str], order: list[str], rows: int, least: int) -> Column:
    """Mean of the `rows` rows before this one, null with fewer than `least` values."""
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(-rows, -1)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def recency_weighted_mean(df: DataFrame, groups: list[str], order: list[Column], value: str, alpha: float, last: int | None = None, out: str = "weighted") -> DataFrame:
    """Mean with weight (1 - alpha)^k of the k-th newest value."""
    newest = ranked_top_n(df.where(F.col(value).isNotNull()), groups, order, last, "_k")
    weight = F.pow(F.lit(1 - alpha), F.col("_k") - 1)
    return newest.groupBy(*groups).agg((F.sum(F.col(value) * weight) / F.sum(weight)).alias(out))


def latest_before(df: DataFrame, keys: list[str], at: str, cutoff: str, tie: list[str]) -> DataFrame:
    """Per key the newest row strictly before its cutoff; later rows are left out."""
    order = [F.desc(at), *[F.desc(t) for t in tie]]
    return ranked_top_n(df.where(F.col(at) < F.col(cutoff)), keys, order, 1, "_rn").drop("_rn")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    return ranked_top_n(df, keys, order, 1, "_rn").drop("_rn")


def keep_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows whose key occurs once; null keys are left out."""
    there = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    return there.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")


def with_group_stats(df: DataFrame, groups: list[str], **aggregates: Column) -> DataFrame:
    """Rows with aggregates of their group; the aggregates are small and joined back, so a large group isn't gathered."""
    names = {g: f"_g{i}" for i, g in enumerate(groups)}
    stats = df.groupBy(*[F.col(g).alias(n) for g, n in names.items()]).agg(*[c.alias(out) for out, c in aggregates.items()])
    same = F.lit(True)
    for g, n in names.items():
        same = same & F.col(g).eqNullSafe(F.col(n))
    return df.join(stats, same).drop(*names.values())


def standardised(df: DataFrame, value: str, groups: list[str], out: str) -> DataFrame:
    """Value over the group's sample deviation; null where that is 0 or missing."""
    d = with_group_stats(df, groups, _sd=F.stddev_samp(value))
    return d.withColumn(out, F.when(F.col("_sd") > 0, F.col(value) / F.col("_sd"))).drop("_sd")


def z_score(df: DataFrame, value: str, groups: list[str], out: str) -> DataFrame:
    """(value - mean) over the population deviation, 0 where there is none."""
    d = with_group_stats(df, groups, _sd=F.stddev_pop(value), _mean=F.avg(value))
    return d.withColumn(out, F.when(F.col("_sd") > 1e-12, (F.col(value) - F.col("_mean")) / F.col("_sd")).otherwise(0.0)).drop("_sd", "_mean")


def running_total(df: DataFrame, order: str, value: str, out: str, including: bool = True, keys: list[str] | None = None) -> DataFrame:
    """Running sum of a value in order, for each key if there are any, without sending all rows to one task.

    Rows are divided by ranges of (keys, order); the order must be unique within a key. Sums
    within a part are added to the total of the same key's parts before it, of which there are
    at most as many as partitions.
    """
    keys = keys or []
    parts = cut(df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part", *keys).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("_part").alias("_end"), *[F.col(k).alias(f"_k_{k}") for k in keys], F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_end")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    w = Window.partitionBy("_part", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if including else -1)
    return parts.withColumn("_own", F.coalesce(F.sum(value).over(w), F.lit(0))).join(before, same).withColumn(out, F.col("_own") + F.col("_before")).select(*df.columns, out)


def at_positions(df: DataFrame, groups: list[str], value: str, **positions: Callable[[Column], Column]) -> DataFrame:
    """(groups, n, names): the values at positions of each group in order, given from its number of values.

    Positions count from 0. Equal values are counted first, and running totals of the counts go over ranges, so a
    group of any size, or one value of any frequency, is never in one task. Nulls take no part; a group
    without values gives no row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_c"))
    up_to = with_group_stats(running_total(counts, value, "_c", "_to", True, groups), groups, _n=F.sum("_c"))
    here = lambda p: (F.col("_to") - F.col("_c") <= p) & (p < F.col("_to"))
    return up_to.groupBy(*groups).agg(F.max("_n").alias("n"), *[F.max(F.when(here(p(F.col("_n"))), F.col(value))).alias(name) for name, p in positions.items()])


def medians(df: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """(groups, n, out): the exact median of each group, the mean of the two middle values of an even number."""
    d = at_positions(df, groups, value, _lo=lambda n: F.floor((n - 1) / 2), _hi=lambda n: F.floor(n / 2))
    return d.select(*groups, "n", ((F.col("_lo") + F.col("_hi")) / 2).alias(out))


def look_back(df: DataFrame, keys: list[str], order: list[str], previous: dict[str, str], carried: dict[str, str]) -> DataFrame:
    """Columns from the rows before each row of its key, without sending a whole key to one task.

    previous: new column -> column whose value in the row just before is wanted; carried: new
    column -> column whose last value that isn't null is wanted. Rows are divided by ranges of
    (keys, order), so a hot key spans many parts; what a part needs from earlier parts of the
    same key is one row for each part that the key spans. Null keys are one key; the order must
    be total.
    """
    parts = cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part", *keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumn("_first", F.row_number().over(w) == 1)
    for out, c in previous.items():
        local = local.withColumn(out, F.lag(c).over(w))
    for out, c in carried.items():
        local = local.withColumn(out, F.last(c, ignorenulls=True).over(before))
    at = F.struct(*order)
    ends = parts.groupBy("_part", *keys).agg(
        *[F.max_by(c, at).alias(f"_p_{out}") for out, c in previous.items()],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_c_{out}") for out, c in carried.items()],
    )
    we = Window.partitionBy(*keys).orderBy("_part")
    ends = ends.select(
        F.col("_part").alias("_end"),
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.lag(f"_p_{out}").over(we).alias(f"_p_{out}") for out in previous],
        *[F.last(f"_c_{out}", ignorenulls=True).over(we.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_c_{out}") for out in carried],
    )
    same = F.col("_part") == F.col("_end")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(ends, same, "left")
    for out in previous:
        joined = joined.withColumn(out, F.when(F.col("_first"), F.col(f"_p_{out}")).otherwise(F.col(out)))
    for out in carried:
        joined = joined.withColumn(out, F.coalesce(out, f"_c_{out}"))
    return joined.select(*df.columns, *previous, *carried)


def trim_pool(df: DataFrame, ident: str, team: str, value: str, price: str, size: int, reserved: int, anchors: int) -> DataFrame:
    """At most `size` entities: the best of each team, then top values, then a blend of value and value per price.

    Every entity gets the least of the priorities that it has; ties go to the identifier.
    """
    per = F.try_divide(F.col(value), F.col(price))
    d = df.withColumn("_per", per)
    d = d.withColumn("_team", F.row_number().over(Window.partitionBy(team).orderBy(F.desc(value), ident)))
    d = with_average_rank(with_average_rank(d, value, [], "_ra", "_pa"), "_per", [], "_rb", "_pb")
    d = d.withColumn("_blend", 0.7 * F.col("_pa") + 0.3 * F.col("_pb")).drop("_ra", "_pa", "_rb", "_pb")
    best = d.orderBy(F.desc(value), ident).limit(anchors).select(F.col(ident).alias("_anchor"))
    d = d.join(best, F.col(ident) == F.col("_anchor"), "left")
    step = F.when(F.col("_team") <= reserved, 0).when(F.col("_anchor").isNotNull(), 1).otherwise(2)
    order = [step, F.when(step == 2, -F.col("_blend")).otherwise(-F.col(value).cast("double")), F.col(ident)]
    return d.withColumn("priority", step).orderBy(*order).limit(size).drop("_per", "_team", "_blend", "_anchor")
