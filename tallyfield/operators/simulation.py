"""Correlated scenarios, candidates scored over shared scenarios and portfolio selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import distributions as D

MAX_MEMBERS = 36


def exposure_limit(n: Column, share: Column) -> Column:
    """How many of n selections one member may be in: the share rounded down, 1 of 1."""
    return F.when(n == 1, F.lit(1)).otherwise(F.least(n, F.floor(n * share + 1e-9))).cast("int")


def latent_lognormal(score: Column, cv_a: Column, cv_b: Column) -> Column:
    """Correlation of the logs that gives lognormals the correlation `score`, kept within (-0.999, 0.999)."""
    va, vb = F.log1p(cv_a * cv_a), F.log1p(cv_b * cv_b)
    inner = F.greatest(1 + score * cv_a * cv_b, F.lit(1e-12))
    return F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.ln(inner) / F.sqrt(va * vb)))


def score_lognormal(latent: Column, cv_a: Column, cv_b: Column) -> Column:
    """The other way round."""
    v = F.sqrt(F.log1p(cv_a * cv_a) * F.log1p(cv_b * cv_b))
    return F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.expm1(latent * v) / (cv_a * cv_b)))


def repaired(matrix: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    """The nearest matrix with eigenvalues of at least `floor` and unit diagonal."""
    w, v = np.linalg.eigh((matrix + matrix.T) / 2)
    m = (v * np.maximum(w, floor)) @ v.T
    s = np.sqrt(np.diag(m))
    return m / np.outer(s, s)


def root(matrix: np.ndarray) -> np.ndarray:
    """The lower Cholesky root, with growing jitter if it needs any."""
    jitter = 0.0
    while True:
        try:
            return np.linalg.cholesky(matrix + jitter * np.eye(len(matrix)))
        except np.linalg.LinAlgError:
            jitter = max(1e-12, jitter * 10)
            if jitter > 1e-2:
                raise


def correlation_roots(pairs: DataFrame, members: DataFrame, group: str, member: str, a: str, b: str, value: str) -> DataFrame:
    """Rows (group, i, k, v) of the Cholesky root of each group's repaired correlation matrix.

    pairs holds the correlation of a < b, absent ones are 0; i and k count the members of a
    group in order. A group has at most MAX_MEMBERS members.
    """
    kind = dict(members.dtypes)[group]

    def solve(key: tuple, who: pd.DataFrame, rel: pd.DataFrame) -> pd.DataFrame:
        names = sorted(who[member].unique())
        if len(names) > MAX_MEMBERS:
            raise ValueError(f"group {key} has {len(names)} members, more than {MAX_MEMBERS}")
        at = {n: i for i, n in enumerate(names)}
        m = np.eye(len(names))
        for x, y, v in zip(rel[a], rel[b], rel[value]):
            if x in at and y in at:
                m[at[x], at[y]] = m[at[y], at[x]] = v
        if np.linalg.eigvalsh(m)[0] < 1e-8:
            m = repaired(m)
        low = root(m)
        i, k = np.tril_indices(len(names))
        return pd.DataFrame({group: key[0], "i": i + 1, "k": k + 1, "v": low[i, k]})

    return members.select(F.col(group).alias("_g"), member).groupBy("_g").cogroup(pairs.select(F.col(group).alias("_h"), a, b, value).groupBy("_h")).applyInPandas(solve, f"{group} {kind}, i int, k int, v double")


def scenarios(members: DataFrame, roots: DataFrame, group: str, member: str, mean: str, cv: str, zero: str, n: int, seed: int) -> DataFrame:
    """(group, scenario, member, score): correlated hurdle draws that don't depend on how data is divided.

    A member's normal deviate comes from a hash of seed, scenario, group and place; a row of the
    root mixes the deviates of a scenario and the mix is turned into a draw.
    """
    w = Window.partitionBy(group).orderBy(member)
    m = members.select(group, member, mean, cv, zero).withColumn("i", F.row_number().over(w))
    draws = m.select(group, F.col("i").alias("k")).withColumn("scenario", F.explode(F.sequence(F.lit(1), F.lit(n))))
    z = draws.withColumn("z", F.expr(D.normal_ppf_sql(D.uniform_sql(str(seed), "scenario", group, "k"))))
    mixed = z.join(roots, [group, "k"]).groupBy(group, "scenario", "i").agg(F.sum(F.col("v") * F.col("z")).alias("z"))
    u = mixed.withColumn("u", F.expr(D.normal_cdf_sql("z"))).join(m, [group, "i"])
    return u.select(group, "scenario", member, F.expr(D.hurdle_sql("u", mean, cv, zero)).alias("score"))


def lineup_variance(rows: DataFrame, covariance: DataFrame, lineup: str, member: str, star: str, a: str = "a", b: str = "b", value: str = "cov") -> DataFrame:
    """Variance of a sum in which the star counts one and a half times: sum of w_i w_j cov_ij.

    covariance holds every ordered pair, the diagonal included.
    """
    weight = F.when(F.col(member) == F.col(star), 1.5).otherwise(1.0)
    x = rows.select(lineup, F.col(member).alias(a), weight.alias("_wa"))
    y = rows.select(lineup, F.col(member).alias(b), weight.alias("_wb"))
    return x.join(y, lineup).join(covariance, [a, b]).groupBy(lineup).agg(F.sum(F.col("_wa") * F.col("_wb") * F.col(value)).alias("variance"))


def fill_slots(df: DataFrame, group: str, ident: str, pos: str, value: str, slots: dict[str, int], flex: int, flex_positions: list[str]) -> DataFrame:
    """(group, ident, slot): the best of each position for its slots, then the best of the rest as flex."""
    w = Window.partitionBy(group, pos).orderBy(F.desc(value), ident)
    cap = F.coalesce(F.element_at(F.create_map(*[x for k, v in slots.items() for x in (F.lit(k), F.lit(v))]), F.col(pos)), F.lit(0))
    need = max([*slots.values(), 0]) + flex
    d = df.where(F.col(value).isNotNull()).select(group, ident, pos, value).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= need)
    fixed = d.where(F.col("_rn") <= cap).withColumn("slot", F.col(pos))
    rest = d.where((F.col("_rn") > cap) & F.col(pos).isin(*flex_positions))
    more = rest.withColumn("_f", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), ident))).where(F.col("_f") <= flex).withColumn("slot", F.lit("FLEX"))
    return fixed.select(group, ident, "slot").unionByName(more.select(group, ident, "slot"))
