"""Tail probabilities of the tests, applied to aggregated rows only."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


#: From this first parameter on the incomplete beta of a small second one is an expansion in gammas.
LARGE = 20.0


def _gamma_ratio(a: float) -> float:
    """gamma(a + 1/2) / gamma(a)."""
    if a < 100.0:
        return math.exp(math.lgamma(a + 0.5) - math.lgamma(a))
    # Stirling's series of the ratio; differences of log gammas would lose all digits for large a.
    r = 1.0 / a
    return math.sqrt(a) * (1.0 - r / 8 + r**2 / 128 + 5 * r**3 / 1024 - 21 * r**4 / 32768 - 399 * r**5 / 262144)


def half_beta_tail(a: float, odds: float) -> float:
    """Regularised incomplete beta function I_x(a, 1/2) at x = 1 / (1 + odds), for ``a`` of ``LARGE`` or more.

    The expansion of Didonato and Morris in incomplete gamma functions of t = a - 1/4: its terms fall like
    powers of 1 / t, whatever x is, so the number of terms does not grow with ``a``.
    """
    t, log_x = a - 0.25, -math.log1p(odds)
    z = -t * log_x
    tail = math.erfc(math.sqrt(z))
    density = math.exp(-z) * math.sqrt(z / math.pi)
    scale = _gamma_ratio(a) / math.sqrt(t)
    if density == 0.0:
        return scale * tail
    j, power, square, step = tail / density, 1.0, 0.25 * log_x * log_x, 0.25 / (t * t)
    sinh_terms, weights = [], []
    total, factorial = j, 1.0
    for n in range(1, 40):
        k = 0.5 + 2 * (n - 1)
        j = (k * (k + 1) * j + (z + k + 1) * power) * step
        power *= square
        factorial /= 2 * n * (2 * n + 1)
        sinh_terms.append(factorial)
        mixed = sum((0.5 * m - n) * sinh_terms[m - 1] * weights[n - m - 1] for m in range(1, n))
        weights.append(-0.5 * factorial + mixed / n)
        term = weights[-1] * j
        total += term
        if abs(term) <= 1e-17 * abs(total):
            break
    return min(1.0, scale * density * total)


def beta_tail(a: float, b: float, x: float, rest: float) -> float:
    """Regularised incomplete beta function by its continued fraction; ``rest`` is 1 - x, given apart so that
    it keeps its digits where x is near one."""
    if x <= 0.0:
        return 0.0
    if rest <= 0.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_tail(b, a, rest, x)
    log_rest = math.log(rest) if rest < 0.5 else math.log1p(-x)
    log_x = math.log(x) if x < 0.5 else math.log1p(-rest)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * log_x + b * log_rest) / a
    # Convergents by the three-term recurrence, rescaled at every step.
    p0, q0, p1, q1 = 0.0, 1.0, 1.0, 1.0
    value = 1.0
    # Convergence takes about the square root of the larger parameter.
    for i in range(1, 2000 + 20 * math.isqrt(int(max(a, b)))):
        m = i // 2
        if i % 2 == 0:
            d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        p0, q0, p1, q1 = p1, q1, p1 + d * p0, q1 + d * q0
        p0, p1, q0, q1 = p0 / q1, p1 / q1, q0 / q1, 1.0
        if abs(p1 - value) < 1e-16 * abs(p1):
            break
        value = p1
    return min(1.0, front * p1)


def t_two_sided_value(t: float, df: float) -> float:
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return math.nan
    return f_upper_value(t * t, 1.0, df)


def f_upper_value(f: float, d1: float, d2: float) -> float:
    if math.isnan(f) or f < 0 or d2 <= 0:
        return math.nan
    if math.isinf(f):
        return 0.0
    odds = d1 * f / d2
    if d1 == 1.0 and d2 >= 2 * LARGE and odds < 2.0:
        return half_beta_tail(d2 / 2.0, odds)
    return beta_tail(d2 / 2.0, d1 / 2.0, 1.0 / (1.0 + odds), odds / (1.0 + odds))


def signed_rank_exact_value(w: float, n: int) -> float:
    """Exact two-sided p of the smaller signed-rank sum, no ties and no zeros."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r].copy()
    return float(min(1.0, 2.0 * ways[: int(w) + 1].sum() / ways.sum()))


def _nullable(values: list[float]) -> pd.Series:
    return pd.Series([None if v is None or math.isnan(v) else v for v in values], dtype="float64")


def t_two_sided(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return _nullable([t_two_sided_value(float(x), float(y)) for x, y in zip(a, b)])
    return run(t.cast("double"), df.cast("double"))


def f_upper(f: Column, d1: Column, d2: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _nullable([f_upper_value(float(x), float(y), float(z)) for x, y, z in zip(a, b, c)])
    return run(f.cast("double"), d1.cast("double"), d2.cast("double"))


def normal_two_sided(z: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series) -> pd.Series:
        return _nullable([math.erfc(abs(float(x)) / math.sqrt(2.0)) for x in a])
    return run(z.cast("double"))


def signed_rank_exact(w: Column, n: Column) -> Column:
    """Exact p for at most fifty pairs; null beyond (the caller uses the normal form)."""
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return _nullable([signed_rank_exact_value(float(x), int(y)) if 0 < y <= 50 else math.nan
                          for x, y in zip(a, b)])
    return run(w.cast("double"), n.cast("long"))


# The rational approximations of the normal quantile by Wichura (1988), highest power first,
# for the centre, the tails and the far tails.
_CENTRE = ((2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
            13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
           (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
            5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0))
_TAIL = ((7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
          3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
         (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
          0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0))
_FAR = ((2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093,
         0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
        (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4,
         0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0))


def _rational(x: Column, parts: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    over, under = (functools.reduce(lambda acc, c: acc * x + F.lit(c), rest, F.lit(first)) for first, *rest in parts)
    return over / under


def probit(p: Column) -> Column:
    """Inverse of the standard normal distribution; null outside (0, 1).  Native, relative error about 1e-16."""
    p = p.cast("double")

    def value(p: Column) -> Column:
        q = p - 0.5
        low = F.sqrt(-F.log(F.least(p, 1.0 - p)))
        tail = F.when(low <= 5.0, _rational(low - 1.6, _TAIL)).otherwise(_rational(low - 5.0, _FAR))
        return F.when(F.abs(q) <= 0.425, q * _rational(0.180625 - q * q, _CENTRE)).otherwise(F.signum(q) * tail)
    # As a lambda's variable the argument is evaluated once.
    return F.when((p > 0) & (p < 1), F.get(F.transform(F.array(p), value), F.lit(0)))
