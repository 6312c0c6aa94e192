"""Model selection, fallbacks, correlation bounds and inversions, chances against a field."""

from __future__ import annotations

from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fits import moment_matrix, predict, ridge_from_moments
from .ranking import running_total


def split_half(halves: DataFrame, ident: str, a: str, b: str, top: int) -> DataFrame:
    """Correlation of two halves, its Spearman-Brown value and how many of the top are shared."""
    r = halves.agg(F.count("*").alias("n"), F.corr(a, b).alias("half_r"))
    best = lambda c: halves.orderBy(F.desc(c), ident).limit(top).select(ident)
    shared = best(a).join(best(b), ident).agg(F.count("*").alias("top_overlap"))
    return r.crossJoin(shared).withColumn("reliability", 2 * F.col("half_r") / (1 + F.col("half_r")))


def grid_search(df: DataFrame, x: str, y: str, held: str, degrees: list[int], penalties: list[float]) -> DataFrame:
    """(degree, penalty, mae, rmse, chosen) of polynomial ridge fits on the rows that aren't held out.

    One pass of moments of the highest degree, of which every other fit takes a part, and one pass
    over the held-out rows for all fits; the choice is by absolute, then squared error, then the simpler fit.
    """
    most = max(degrees)
    d = df
    for k in range(2, most + 1):
        d = d.withColumn(f"{x}_{k}", F.pow(F.col(x), F.lit(k)))
    names = [x, *[f"{x}_{k}" for k in range(2, most + 1)]]
    moments = moment_matrix(d.where(~F.col(held)), names, y)
    errors, tried = [], []
    for degree in degrees:
        for penalty in penalties:
            fit = ridge_from_moments(*moments, names[:degree], penalty)
            e = F.col(y) - predict(fit)
            i = len(tried)
            tried.append((degree, penalty))
            errors += [F.avg(F.abs(e)).alias(f"mae{i}"), F.sqrt(F.avg(e * e)).alias(f"rmse{i}")]
    row = d.where(F.col(held)).agg(*errors).first()
    table = [(degree, penalty, row[f"mae{i}"], row[f"rmse{i}"]) for i, (degree, penalty) in enumerate(tried)]
    best = min(table, key=lambda t: (round(t[2], 9), round(t[3], 9), t[0], -t[1]))
    return df.sparkSession.createDataFrame([(*t, t == best) for t in table], "degree int, penalty double, mae double, rmse double, chosen boolean")


def shrunken_slopes(df: DataFrame, groups: list[str], x: Column, y: Column, extra: float, low: float, high: float) -> DataFrame:
    """Per group sum(xy) / (sum(xx) + extra), kept within bounds."""
    s = F.sum(x * y) / (F.sum(x * x) + extra)
    return df.groupBy(*groups).agg(F.count("*").alias("n"), F.least(F.greatest(s, F.lit(low)), F.lit(high)).alias("slope"))


def lines_with_fallback(df: DataFrame, group: str, x: str, y: str, least: int) -> DataFrame:
    """Each group's line, or that of all rows if the group has under `least`."""
    line = (F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    own = df.groupBy(group).agg(F.count("*").alias("n"), *line)
    every = df.agg(*line).toDF("_s", "_i")
    enough = F.col("n") >= least
    return own.crossJoin(F.broadcast(every)).select(group, "n", F.when(enough, F.col("slope")).otherwise(F.col("_s")).alias("slope"), F.when(enough, F.col("intercept")).otherwise(F.col("_i")).alias("intercept"))


def slopes_without_group(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """The slope of all rows but the group's, from total less own moments; no row is read twice."""
    a, b = F.col(x), F.col(y)
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"))
    w = Window.partitionBy()
    rest = {c: F.sum(c).over(w) - F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy")}
    r = g.select(group, *[v.alias(c) for c, v in rest.items()])
    return r.select(group, "n", F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")).alias("slope"))


def lognormal_bounds(sa: Column, sb: Column) -> tuple[Column, Column]:
    """Least and greatest correlation of two lognormals with those deviations of their logs."""
    scale = F.sqrt(F.expm1(sa * sa) * F.expm1(sb * sb))
    return F.expm1(-sa * sb) / scale, F.expm1(sa * sb) / scale


@lru_cache(maxsize=4096)
def hermite_coefficients(cv: float, zero: float, terms: int = 24, nodes: int = 20_001) -> tuple[float, ...]:
    """Coefficients of the standardised hurdle transform in normalised Hermite polynomials, from order 1.

    By the trapezoid rule over normal deviates in [-9, 9].
    """
    z = np.linspace(-9.0, 9.0, nodes)
    density = np.exp(-z * z / 2) / np.sqrt(2 * np.pi) * (z[1] - z[0])
    inner = np.sqrt(np.log1p(max(cv * cv * (1 - zero) - zero, 1e-12)))
    if zero > 0:
        cut = NormalDist().inv_cdf(zero)
        u = np.array([NormalDist().cdf(v) for v in z])
        above = z > cut
        q = np.clip((u - zero) / (1 - zero), 1e-15, 1 - 1e-15)
        x = np.where(above, np.exp(inner * np.array([NormalDist().inv_cdf(v) for v in q])), 0.0)
    else:
        x = np.exp(inner * z)
    mean = (x * density).sum()
    x = (x - mean) / np.sqrt(((x - mean) ** 2 * density).sum())
    before, now, out = np.ones_like(z), z.copy(), []
    for k in range(1, terms + 1):
        out.append(float((x * now * density).sum()))
        before, now = now, (z * now - np.sqrt(k) * before) / np.sqrt(k + 1)
    return tuple(out)


def score_from_latent(latent: np.ndarray, a: tuple[float, ...], b: tuple[float, ...]) -> np.ndarray:
    """Correlation of the transformed values: the sum of a_k b_k latent^k."""
    powers = np.cumprod(np.repeat(latent[:, None], len(a), axis=1), axis=1)
    return powers @ (np.array(a) * np.array(b))


def hurdle_latent(cells: DataFrame, cv: str, zero: str, score: float, steps: int = 60) -> DataFrame:
    """For each distinct (cv, zero) the latent correlation with itself that gives `score`, by bisection.

    Cells are few however many rows have them, as only distinct ones are solved.
    """

    def solve(it):
        for pdf in it:
            latent, back = [], []
            for c, p in zip(pdf[cv], pdf[zero]):
                a = hermite_coefficients(float(c), float(p))
                lo, hi = -0.999, 0.999
                for _ in range(steps):
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if score_from_latent(np.array([mid]), a, a)[0] < score else (lo, mid)
                latent.append((lo + hi) / 2)
                back.append(float(score_from_latent(np.array([latent[-1]]), a, a)[0]))
            yield pd.DataFrame({cv: pdf[cv], zero: pdf[zero], "latent": latent, "back": back})

    return cells.select(cv, zero).mapInPandas(solve, f"{cv} double, {zero} double, latent double, back double")


def rank_bounds(df: DataFrame, ident: str, value: str, field: DataFrame, other: str) -> DataFrame:
    """(ident, below, upto): how many values of the field are less, and less or equal.

    Both tables are counted by value and stacked; one running sum over the distinct values
    answers all, so no pair is made.
    """
    v = F.col(value).cast("double")
    a = df.select(v.alias("_v"), F.lit(0).cast("long").alias("_c")).distinct()
    b = field.where(F.col(other).isNotNull()).groupBy(F.col(other).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    total = a.unionByName(b).where("_v is not null").groupBy("_v").agg(F.sum("_c").alias("_c"))
    bounds = running_total(total, "_v", "_c", "upto").select("_v", (F.col("upto") - F.col("_c")).alias("below"), "upto")
    return df.select(ident, v.alias("_v")).join(bounds, "_v").select(ident, "below", "upto")


def win_chance(df: DataFrame, field: DataFrame, ident: str, value: str) -> DataFrame:
    """The share of the field that a value beats, ties counting half."""
    n = field.where(F.col(value).isNotNull()).agg(F.count("*").alias("_n"))
    bounds = rank_bounds(df, ident, value, field, value)
    return bounds.crossJoin(F.broadcast(n)).select(ident, ((F.col("below") + F.col("upto")) / 2 / F.col("_n")).alias("chance"))


def residuals(df: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """y less its line on x, fitted in each group."""
    line = df.groupBy(*groups).agg(F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_i"))
    return df.join(line, groups).withColumn("residual", F.col(y) - F.col("_i") - F.col("_s") * F.col(x)).drop("_s", "_i")


def known_before(cutoffs: DataFrame, ident: str, cutoff: str, rows: DataFrame, at: str, hours: int) -> DataFrame:
    """(ident, known): rows whose time plus `hours` lies before the cutoff, by a running count."""
    c = cutoffs.select(F.col(ident), F.col(cutoff).alias("_t"), F.lit(0).alias("_r"))
    r = rows.where(F.col(at).isNotNull()).select(F.lit(None).cast(dict(cutoffs.dtypes)[ident]).alias(ident), (F.col(at) + F.expr(f"interval {hours} hours")).alias("_t"), F.lit(1).alias("_r"))
    times = c.unionByName(r).groupBy("_t").agg(F.sum("_r").alias("_c"))
    running = running_total(times, "_t", "_c", "known", including=False).select("_t", "known")
    return c.join(running, "_t").select(ident, "known")


def signed_marginal(df: DataFrame, mean: str, cv: str, below: float, zero: float, low: float) -> DataFrame:
    """inner_mean and inner_cv of the part above zero of a mixture with chance `below` of `low` and `zero` of 0.

    They keep the mean and the variation of the whole.
    """
    m, rest = F.col(mean), 1 - below - zero
    inner = (m - below * low) / rest
    second = (F.col(cv) * F.col(cv) * m * m + m * m - below * low * low) / rest
    return df.withColumn("inner_mean", inner).withColumn("inner_cv", F.sqrt(F.greatest(second / (inner * inner) - 1, F.lit(0.0))))
