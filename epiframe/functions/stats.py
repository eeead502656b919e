"""Distribution functions as Spark columns, plus scalar twins for driver-side summaries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rational approximation of the normal tail (Hart 1968, double precision).
TAIL_NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376]
TAIL_DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
Z975 = 1.959963984540054


def _horner(coefs, x):
    total = coefs[0]
    for c in coefs[1:]:
        total = total * x + c
    return total


def norm_sf(z: Column) -> Column:
    """Upper normal tail P(Z > z)."""
    a = F.abs(z)
    bell = F.exp(-a * a / 2)
    mid = bell * _horner(TAIL_NUM, a) / _horner(TAIL_DEN, a)
    far = bell / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    upper = F.when(a < 7.07106781186547, mid).otherwise(far)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def norm_cdf(z: Column) -> Column:
    return norm_sf(-z)


def two_sided_p(z: Column) -> Column:
    return F.least(2 * norm_sf(F.abs(z)), F.lit(1.0))


def chi2_sf(x: Column, df: int) -> Column:
    """Upper chi-square tail for a whole number of degrees of freedom (closed form)."""
    h = x / 2
    if df % 2 == 0:
        term, total = F.lit(1.0), F.lit(1.0)
        for i in range(1, df // 2):
            term = term * h / i
            total = total + term
        return F.when(x <= 0, 1.0).otherwise(F.exp(-h) * total)
    total = 2 * norm_sf(F.sqrt(x))
    term = F.sqrt(2 * x / math.pi) * F.exp(-h)
    for i in range(1, (df - 1) // 2 + 1):
        total = total + term
        term = term * x / (2 * i + 1)
    return F.when(x <= 0, 1.0).otherwise(total)


def norm_ppf(p: float) -> float:
    """Normal quantile of one probability."""
    from statistics import NormalDist
    return NormalDist().inv_cdf(p)


def _beta_fraction(a, b, x, steps: int = 300):
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def betainc(a, b, x):
    """Regularised incomplete beta function on arrays."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0.0, 1.0)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    flip = inner > (a + 1) / (a + b + 2)
    left = front * _beta_fraction(np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - inner, inner))
    out = np.where(flip, 1 - left / b, left / a)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_two_sided(t, df):
    """Two-sided Student p value on arrays."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if ok.any():
        out[ok] = t_two_sided(t[ok].to_numpy(), df[ok].to_numpy())
    return out.where(ok, None)


def t_ppf(p: float, df: float) -> float:
    """Student quantile by bisection (scalar)."""
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        tail = float(t_two_sided(mid, df)) / 2
        if (1 - tail if mid > 0 else tail) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def gammainc(a, x):
    """Regularised lower incomplete gamma on arrays (series below a + 1, fraction above)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    x = np.maximum(x, 1e-300)
    front = np.exp(a * np.log(x) - x - _lgamma(a))
    low_x = np.minimum(x, a + 1)
    term = 1 / a
    total = term.copy()
    ap = a.copy()
    for _ in range(2000):
        ap = ap + 1
        term = term * low_x / ap
        total = total + term
        if np.all(np.abs(term) < np.abs(total) * 1e-15):
            break
    series = front * total
    high_x = np.maximum(x, a + 1)
    b = high_x + 1 - a
    c = np.full_like(b, 1e300)
    d = 1 / b
    h = d.copy()
    for i in range(1, 2000):
        an = -i * (i - a)
        b = b + 2
        d = 1 / (an * d + b)
        c = b + an / c
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return np.where(x < a + 1, series, 1 - front * h)


def gamma_ppf(p, a):
    """Quantile of the unit-scale gamma distribution on arrays, by bisection."""
    p, a = np.broadcast_arrays(np.asarray(p, float), np.asarray(a, float))
    lo = np.zeros_like(a)
    hi = a + 40 * np.sqrt(a) + 40
    for _ in range(120):
        mid = (lo + hi) / 2
        under = gammainc(a, mid) < p
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    return (lo + hi) / 2


def digamma(x):
    """Digamma on arrays by recurrence and asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while np.any(x < 8):
        out = np.where(x < 8, out - 1 / x, out)
        x = np.where(x < 8, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))
