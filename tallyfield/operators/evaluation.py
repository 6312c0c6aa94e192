"""Forecast errors, calibration, intervals and resampling as aggregates that merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import medians


def error_metrics(df: DataFrame, groups: list[str], actual: str, forecast: str) -> DataFrame:
    """n, mean absolute error, root mean square error, bias, correlation and slope of each group."""
    e = F.col(forecast) - F.col(actual)
    d = df.where(f"{actual} is not null and {forecast} is not null")
    return d.groupBy(*groups).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("bias"),
        F.corr(actual, forecast).alias("correlation"),
        F.regr_slope(actual, forecast).alias("slope"),
    )


def with_overall(df: DataFrame, group: str, *aggregates: Column) -> DataFrame:
    """The aggregates over all rows and by group in one pass; `group` is null for all."""
    return df.groupingSets([[], [F.col(group)]], F.col(group)).agg(*aggregates)


def median_scale(df: DataFrame, group: str, value: str, reference: str, least: int) -> DataFrame:
    """Per group the median of reference over value, 1 with fewer than `least` ratios."""
    ratio = F.try_divide(F.col(reference), F.col(value))
    r = df.withColumn("_r", ratio).where("_r is not null")
    return medians(r, [group], "_r", "_m").select(group, "n", F.when(F.col("n") >= least, F.col("_m")).otherwise(F.lit(1.0)).alias("scale"))


def rate_with_error(df: DataFrame, groups: list[str], flag: Column, least: int) -> DataFrame:
    """Share of true flags with its standard error; groups under `least` rows are left out."""
    p = F.avg(flag.cast("double"))
    g = df.groupBy(*groups).agg(F.count("*").alias("n"), p.alias("rate")).where(F.col("n") >= least)
    return g.withColumn("se", F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n")))


def shrunken_rate(df: DataFrame, groups: list[str], flag: Column, prior: Column, weight: float) -> DataFrame:
    """(successes + weight * prior) / (n + weight) of each cell."""
    d = df.withColumn("_f", flag.cast("double")).withColumn("_p", prior)
    return d.groupBy(*groups).agg(F.count("*").alias("n"), ((F.sum("_f") + weight * F.avg("_p")) / (F.count("*") + weight)).alias("rate"))


def fisher_interval(pairs: DataFrame, groups: list[str], a: str, b: str, least: int) -> DataFrame:
    """Correlation with its 95 % interval by Fisher's z; groups under `least` pairs are left out."""
    g = pairs.groupBy(*groups).agg(F.count("*").alias("n"), F.corr(a, b).alias("r")).where(F.col("n") >= least)
    z, h = F.atanh("r"), F.lit(1.959963984540054) / F.sqrt(F.col("n") - 3)
    return g.withColumn("low", F.tanh(z - h)).withColumn("high", F.tanh(z + h))


def moments(df: DataFrame, groups: list[str], a: str, b: str) -> DataFrame:
    """n and sums from which correlations of any union of groups follow."""
    x, y = F.col(a), F.col(b)
    d = df.where(x.isNotNull() & y.isNotNull())
    return d.groupBy(*groups).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))


def correlation_of_moments() -> Column:
    """The correlation from columns n, sx, sy, sxx, syy, sxy."""
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    return F.try_divide(n * sxy - sx * sy, F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)))


def crps(df: DataFrame, groups: list[str], draw: str, actual: str) -> DataFrame:
    """Continuous ranked probability score of an ensemble: mean distance less half the mean spread."""
    w = Window.partitionBy(*groups)
    d = df.withColumn("_i", F.row_number().over(w.orderBy(draw))).withColumn("_n", F.count("*").over(w))
    spread = F.col(draw) * (2 * F.col("_i") - F.col("_n") - 1)
    return d.groupBy(*groups).agg((F.avg(F.abs(F.col(draw) - F.col(actual))) - F.sum(spread) / F.pow(F.max("_n"), F.lit(2))).alias("crps"))


def win_tie_loss(df: DataFrame, groups: list[str], difference: Column, eps: float = 1e-8) -> DataFrame:
    return df.groupBy(*groups).agg(F.count_if(difference > eps).alias("wins"), F.count_if(F.abs(difference) <= eps).alias("ties"), F.count_if(difference < -eps).alias("losses"))


def leave_one_out(df: DataFrame, value: str, out: str) -> DataFrame:
    """The mean of all other rows for each row."""
    total = df.agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return df.crossJoin(F.broadcast(total)).withColumn(out, F.try_divide(F.col("_s") - F.col(value), F.col("_n") - 1)).drop("_s", "_n")


def poisson_weight(u: Column) -> Column:
    """A Poisson(1) count from a uniform, up to 8."""
    out, p, total = F.lit(0), 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        out = out + (u > total).cast("int")
        p /= k + 1
    return out


def cluster_bootstrap(clusters: DataFrame, ident: str, total: str, count: str, reps: int, uniform: Column) -> DataFrame:
    """95 % interval of a ratio of sums over resampled clusters.

    clusters has a row for each cluster with its sum and its count; `uniform` is an expression
    of the identifier and of rep. Weights are Poisson(1), which come close to drawing
    clusters with replacement and need no draw that all tasks share.
    """
    reps_df = clusters.select(ident, total, count, F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")).withColumn("_w", poisson_weight(uniform))
    each = reps_df.groupBy("rep").agg(F.try_divide(F.sum(F.col(total) * F.col("_w")), F.sum(F.col(count) * F.col("_w"))).alias("m"))
    return each.agg(F.count("*").alias("reps"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.5).alias("middle"), F.percentile("m", 0.975).alias("high"))


def shared_members(rows: DataFrame, groups: list[str], ident: str, member: str) -> DataFrame:
    """(a, b, shared): how many members two sets of a group have in common, if any.

    Sets meet through their members, so sets that share none are never paired.
    """
    x = rows.select(*groups, F.col(member).alias("_m"), F.col(ident).alias("a"))
    y = rows.select(*groups, F.col(member).alias("_m"), F.col(ident).alias("b"))
    return x.join(y, [*groups, "_m"]).where("a < b").groupBy("a", "b").agg(F.count("*").cast("int").alias("shared"))


def apportion(weights: DataFrame, ident: str, weight: str, seats: int) -> DataFrame:
    """Seats by largest remainder; ties go to the larger weight, then the identifier."""
    w = Window.partitionBy()
    share = F.col(weight) / F.sum(weight).over(w) * seats
    d = weights.withColumn("_share", share).withColumn("_base", F.floor("_share"))
    d = d.withColumn("_left", seats - F.sum("_base").over(w))
    d = d.withColumn("_k", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_share") - F.col("_base"), 12)), F.desc(weight), ident)))
    return d.withColumn("seats", (F.col("_base") + (F.col("_k") <= F.col("_left")).cast("int")).cast("int")).drop("_share", "_base", "_left", "_k")
