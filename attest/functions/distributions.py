"""Tail probabilities, for results of a few rows (one per comparison)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                          -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            c = 1.0 + numerator / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_upper(s: float, x: float) -> float:
    """Upper regularised incomplete gamma."""
    if x <= 0:
        return 1.0
    scale = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1:
        term = total = 1.0 / s
        n = s
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1 - s
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - s)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_upper(f: float, df1: float, df2: float) -> float:
    return beta_cdf(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def rank_sum_counts(n1: int, n2: int) -> list[int]:
    """In how many ways n1 of n1 + n2 ranks give each value 0 ... n1 * n2 of U.

    The counts are the coefficients of the Gaussian binomial: one factor (1 - q^(n2 + i)) / (1 - q^i) after the other, each a
    shifted difference and a running sum, in whole numbers."""
    counts = [1] + [0] * (n1 * n2)
    for i in range(1, n1 + 1):
        for u in range(n1 * n2, n2 + i - 1, -1):
            counts[u] -= counts[u - n2 - i]
        for u in range(i, n1 * n2 + 1):
            counts[u] += counts[u - i]
    return counts


def rank_sum_two_sided(n1: float, n2: float, u: float) -> float:
    """Twice the chance of a U as far from the middle on one side, at most 1; for samples without ties."""
    few, many = sorted((int(n1), int(n2)))
    counts = rank_sum_counts(few, many)
    far = int(max(u, n1 * n2 - u))
    return min(1.0, 2 * sum(counts[far:]) / sum(counts))


# Rational approximations of the normal quantile, lowest power first, for the middle, the near and the far tail.
QUANTILE_MIDDLE = (
    (3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3))
QUANTILE_NEAR = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
     1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
QUANTILE_FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))


def polynomial(coefficients, x: Column) -> Column:
    """Lowest power first."""
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of 0 < p < 1, to double precision."""
    ratio = lambda pair, x: polynomial(pair[0], x) / polynomial(pair[1], x)
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(r <= 5, ratio(QUANTILE_NEAR, r - 1.6)).otherwise(ratio(QUANTILE_FAR, r - 5))
    return F.when(F.abs(q) <= 0.425, q * ratio(QUANTILE_MIDDLE, 0.180625 - q * q)).otherwise(F.signum(q) * tail)


def _column(function):
    @F.pandas_udf(DoubleType())
    def apply(*args: pd.Series) -> pd.Series:
        rows = zip(*args)
        return pd.Series([None if any(v is None or v != v for v in r) else float(function(*r)) for r in rows])
    return apply


t_p = _column(t_two_sided)
f_p = _column(f_upper)
chi2_p = _column(chi2_upper)
normal_p = _column(normal_two_sided)
rank_sum_p = _column(rank_sum_two_sided)
