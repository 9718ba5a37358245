"""Distribution functions for inference on the driver: normal, t, F and chi-squared."""

from __future__ import annotations

import math
from statistics import NormalDist

_Z = NormalDist()


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    return _Z.inv_cdf(p)


def norm_pdf(x: float) -> float:
    return math.exp(-0.5 * x * x) / math.sqrt(2.0 * math.pi)


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - betainc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0))
    f = d
    for m in range(1, 3000):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        for num in (even, odd):
            d = 1.0 / ((1.0 + num * d) or 1e-300)
            c = (1.0 + num / c) or 1e-300
            f *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * f


def gammainc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0.0:
        return 0.0
    if math.isinf(x):
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1.0
            term *= x / n
            total += term
        return front * total
    b, c, d = x + 1.0 - a, 1e300, 1.0 / (x + 1.0 - a)
    f = d
    for i in range(1, 5000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        f *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return 1.0 - front * f


def t_sf(x: float, df: float) -> float:
    if math.isinf(df):
        return norm_sf(x)
    half = 0.5 * betainc(0.5 * df, 0.5, df / (df + x * x))
    return half if x >= 0 else 1.0 - half


def t_cdf(x: float, df: float) -> float:
    return t_sf(-x, df)


def _invert(cdf, p: float, low: float, high: float) -> float:
    while cdf(high) < p:
        high *= 2.0
    while cdf(low) > p:
        low = low * 2.0 if low < 0 else low / 2.0
    for _ in range(200):
        mid = 0.5 * (low + high)
        if mid in (low, high):
            break
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return 0.5 * (low + high)


def t_ppf(p: float, df: float) -> float:
    if math.isinf(df):
        return norm_ppf(p)
    if p < 0.5:
        return -t_ppf(1.0 - p, df)
    return 0.0 if p == 0.5 else _invert(lambda v: t_cdf(v, df), p, 0.0, 4.0)


def f_sf(x: float, dfn: float, dfd: float) -> float:
    if x <= 0:
        return 1.0
    return chi2_sf(x * dfn, dfn) if math.isinf(dfd) else betainc(0.5 * dfd, 0.5 * dfn, dfd / (dfd + dfn * x))


def chi2_sf(x: float, df: float) -> float:
    return 1.0 if x <= 0 else 1.0 - gammainc(0.5 * df, 0.5 * x)


def chi2_ppf(p: float, df: float) -> float:
    return _invert(lambda v: 1.0 - chi2_sf(v, df), p, 1e-300, max(1.0, df))
