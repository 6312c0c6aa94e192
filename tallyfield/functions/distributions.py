"""Distribution functions as SQL text that Spark and other engines evaluate alike, without UDFs."""

from __future__ import annotations

#: Coefficients of Hart's rational approximation of the normal distribution function. Fixed values.
CDF_P = (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 3.52624965998911e-2)
CDF_Q = (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-2)
#: Acklam's coefficients of the inverse: centre and tail, numerators and denominators. Fixed values.
PPF_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
PPF_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
PPF_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
PPF_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
PPF_LOW = 0.02425


def number(v: float) -> str:
    """A literal that every engine reads as a double."""
    return f"CAST('{v!r}' AS DOUBLE)"


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    out = number(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {number(c)})"
    return out


def normal_cdf_sql(x: str) -> str:
    """P(Z <= x)."""
    z = f"abs({x})"
    e = f"exp(-{z} * {z} / 2)"
    middle = f"({e} * {_horner(CDF_P[::-1], z)} / {_horner(CDF_Q[::-1], z)})"
    chain = z
    for k in (0.65, 4.0, 3.0, 2.0, 1.0):
        chain = f"({z} + {number(k)} / {chain})" if k != 0.65 else f"({z} + {number(k)})"
    tail = f"({e} / ({chain} * {number(2.506628274631)}))"
    upper = f"(CASE WHEN {z} > 37 THEN {number(0.0)} WHEN {z} < {number(7.07106781186547)} THEN {middle} ELSE {tail} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {upper} ELSE {upper} END)"


def normal_ppf_sql(p: str) -> str:
    """The z with P(Z <= z) = p, for p clipped to [1e-300, 1 - 1e-16]."""
    c = f"least(greatest({p}, {number(1e-300)}), {number(1 - 1e-16)})"
    low = f"sqrt(-2 * ln({c}))"
    high = f"sqrt(-2 * ln(1 - {c}))"
    q = f"({c} - 0.5)"
    r = f"({q} * {q})"
    tail = lambda t: f"({_horner(PPF_C, t)} / {_horner(PPF_D, t)})"
    middle = f"({_horner(PPF_A, r)} * {q} / {_horner(PPF_B, r)})"
    return f"(CASE WHEN {c} < {number(PPF_LOW)} THEN {tail(low)} WHEN {c} > {number(1 - PPF_LOW)} THEN -{tail(high)} ELSE {middle} END)"


def conditional_cv_sql(cv: str, zero: str) -> str:
    """Coefficient of variation of the part above zero, given that of the whole and the chance of zero."""
    return f"sqrt(greatest({cv} * {cv} * (1 - {zero}) - {zero}, {number(1e-12)}))"


def representable_sql(cv: str, zero: str) -> str:
    """Whether a hurdle distribution can have that variation and that chance of zero."""
    return f"({cv} * {cv} * (1 - {zero}) - {zero} > 0)"


def band_sql(mean: str, cv: str, z: float) -> str:
    """The lognormal quantile at normal deviate z of a mean and a coefficient of variation."""
    s = f"ln(1 + {cv} * {cv})"
    return f"({mean} * exp({number(z)} * sqrt({s}) - {s} / 2))"


def hurdle_sql(u: str, mean: str, cv: str, zero: str) -> str:
    """A uniform as a draw that is 0 with chance `zero`, else lognormal; the mean of all is `mean`."""
    s = f"ln(1 + pow({conditional_cv_sql(cv, zero)}, 2))"
    z = normal_ppf_sql(f"(({u} - {zero}) / (1 - {zero}))")
    return f"(CASE WHEN {u} <= {zero} THEN {number(0.0)} ELSE {mean} / (1 - {zero}) * exp(sqrt({s}) * {z} - {s} / 2) END)"


def poisson_survival_sql(k: str, rate: str, engine: str = "spark") -> str:
    """P(X >= k) of a Poisson variable, for small k, by summing the terms below k."""
    if engine == "spark":
        return f"(1 - exp(-{rate}) * aggregate(sequence(1, greatest({k}, 1)), named_struct('s', CAST(0 AS DOUBLE), 't', CAST(1 AS DOUBLE)), (a, i) -> named_struct('s', a.s + IF(i <= {k}, a.t, CAST(0 AS DOUBLE)), 't', a.t * {rate} / i), a -> a.s))"
    return f"(1 - exp(-{rate}) * coalesce(list_sum(list_transform(range(0, {k}), lambda i: pow({rate}, i) / factorial(i::INTEGER)::DOUBLE)), 0))"


def weibull_survival_sql(t: str, shape: str, scale: str) -> str:
    return f"exp(-pow({t} / {scale}, {shape}))"


def uniform_sql(*parts: str, engine: str = "spark") -> str:
    """A uniform of (0, 1) that depends only on its parts: 52 bits of an md5, the same in both engines."""
    digest = f"substr(md5(concat_ws('|', {', '.join(f'CAST({p} AS {"STRING" if engine == "spark" else "VARCHAR"})' for p in parts)})), 1, 13)"
    whole = f"CAST(conv({digest}, 16, 10) AS BIGINT)" if engine == "spark" else f"CAST('0x' || {digest} AS BIGINT)"
    return f"(({whole} + {number(0.5)}) / {number(4503599627370496.0)})"


def logit_sql(p: str) -> str:
    c = f"least(greatest({p}, {number(1e-6)}), {number(1 - 1e-6)})"
    return f"ln({c} / (1 - {c}))"


def logistic_sql(x: str) -> str:
    return f"(CASE WHEN {x} >= 0 THEN 1 / (1 + exp(-{x})) ELSE exp({x}) / (1 + exp({x})) END)"
