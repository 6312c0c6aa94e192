"""Blending of forecast sources by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_number, mean_of

OUT_STATUSES = ("OUT", "INJURY_RESERVE", "SUSPENSION")


def blend_two(df: DataFrame, first: str, second: str, status: str, starter: Column, group: list[str], trusted_out: tuple[str, ...] = OUT_STATUSES) -> DataFrame:
    """value and rule of two sources, by the first rule that holds.

    ruled_out: the second source says so, 0; stale: a starter of the group is out and the first
    source hasn't followed (the second is over it by half), so the second alone; mean: both;
    first, second: only one; none: neither, null.
    """
    a, b = clean_number(F.col(first)), clean_number(F.col(second))
    out = F.coalesce(F.upper(F.col(status)).isin(*trusted_out), F.lit(False))
    starter_out = F.max((starter & out).cast("int")).over(Window.partitionBy(*group)) == 1
    stale = starter_out & ~out & a.isNotNull() & b.isNotNull() & (b >= 1.5 * a)
    rule = F.when(out, "ruled_out").when(stale, "stale").when(a.isNotNull() & b.isNotNull(), "mean").when(a.isNotNull(), "first").when(b.isNotNull(), "second").otherwise("none")
    d = df.withColumn("rule", rule)
    value = F.when(F.col("rule") == "ruled_out", 0.0).when(F.col("rule").isin("stale", "second"), b).when(F.col("rule") == "mean", (a + b) / 2).when(F.col("rule") == "first", a)
    return d.withColumn("value", value)


def blend_three(df: DataFrame, sources: list[str], scale: str, agree: float) -> DataFrame:
    """Mean of the sources that are there, the third one rescaled, with their number and a verdict.

    If the first two differ by more than `agree` the verdict names the one that the third is nearer to.
    """
    s, e = clean_number(F.col(sources[0])), clean_number(F.col(sources[1]))
    c = clean_number(F.col(sources[2]) * F.col(scale))
    n = s.isNotNull().cast("int") + e.isNotNull().cast("int") + c.isNotNull().cast("int")
    verdict = (
        F.when(s.isNull() | e.isNull() | c.isNull(), "no referee")
        .when(F.abs(s - e) <= agree, "agree")
        .when(F.abs(c - s) < F.abs(c - e), "sides with first")
        .when(F.abs(c - e) < F.abs(c - s), "sides with second")
        .otherwise("between")
    )
    return df.withColumn("value", mean_of(s, e, c)).withColumn("n_sources", n).withColumn("verdict", verdict)
