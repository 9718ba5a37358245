"""Column functions that Spark lacks, as expressions that stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Hart's rational approximation of the normal tail, highest power first.
_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def norm_pdf(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / F.lit(math.sqrt(2.0 * math.pi))


def norm_cdf(x: Column) -> Column:
    """Normal distribution function, to about fifteen digits."""
    a = F.abs(x)
    near = F.exp(-0.5 * a * a) * _horner(a, _TOP) / _horner(a, _BOTTOM)
    far = norm_pdf(a) / (a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65)))))
    tail = F.when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for positive values: Stirling's series eight steps up, then back."""
    z = x + 8.0
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1.0 / (12 * z) - 1.0 / (360 * F.pow(z, 3)) + 1.0 / (1260 * F.pow(z, 5)) - 1.0 / (1680 * F.pow(z, 7))
    back = F.ln(x)
    for i in range(1, 8):
        back = back + F.ln(x + float(i))
    return series - back


def clean_log(x: Column) -> Column:
    """ln, with non-positive and not-a-number values missing."""
    return F.when((x > 0) & ~F.isnan(x), F.ln(x))
