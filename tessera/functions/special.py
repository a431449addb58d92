"""Special functions and count-law derivatives as Column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.likelihood import HALF_LOG_TWO_PI, SHIFT, SMALL, STIRLING, lgamma

#: Coefficients of the asymptotic series of digamma, from 1/x^2 on.
DIGAMMA = [-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132]


def digamma(x: Column) -> Column:
    """The logarithmic derivative of Gamma for positive x: eight steps up, then the series."""
    x = x.cast("double")
    y = x + SHIFT
    steps = F.lit(0.0)
    for i in range(SHIFT):
        steps = steps + 1 / (x + i)
    square = 1 / (y * y)
    series = F.lit(0.0)
    for c in reversed(DIGAMMA):
        series = (series + c) * square
    return F.ln(y) - 0.5 / y + series - steps


def gamma_q(a: Column, x: Column, terms: int = 200) -> Column:
    """The upper regularised incomplete gamma function, by its series below a + 1 and its continued fraction above."""
    a, x = a.cast("double"), x.cast("double")
    front = F.exp(-x + a * F.ln(F.greatest(x, F.lit(1e-300))) - lgamma(a))
    count = F.sequence(F.lit(1), F.lit(terms))
    # sum of x^n / (a (a + 1) ... (a + n))
    series = F.aggregate(count, F.struct((1 / a).alias("term"), (1 / a).alias("sum")), lambda s, n: F.struct((s["term"] * x / (a + n)).alias("term"), (s["sum"] + s["term"] * x / (a + n)).alias("sum")))["sum"]
    lower = 1 - front * series
    # Lentz's steps for 1 / (x + 1 - a - 1 (1 - a) / (x + 3 - a - ...))
    b0 = x + 1 - a
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def step(s: Column, n: Column) -> Column:
        an, b = -n * (n - a), b0 + 2 * n
        d, c = 1 / safe(an * s["d"] + b), safe(b + an / s["c"])
        return F.struct(d.alias("d"), c.alias("c"), (s["h"] * d * c).alias("h"))

    d0 = 1 / safe(b0)
    fraction = F.aggregate(count, F.struct(d0.alias("d"), F.lit(1e300).alias("c"), d0.alias("h")), step)["h"]
    return F.when(x <= 0, F.lit(1.0)).when(x < a + 1, lower).otherwise(front * fraction)


def chi_square_tail(statistic: Column, degrees: Column) -> Column:
    """P(chi-squared with so many degrees > statistic)."""
    return gamma_q(degrees / 2.0, statistic / 2.0)


def chi_square_cut(level: float, degrees: int = 2) -> float:
    """The value that chi-squared stays below with probability ``level``; exact for two degrees, by halving for others."""
    if degrees == 2:
        return -2 * math.log(1 - level)
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _lower(degrees / 2, mid / 2) < level else (low, mid)
    return high


def _lower(a: float, x: float) -> float:
    term = total = 1 / a
    for n in range(1, 2000):
        term *= x / (a + n)
        total += term
    return total * math.exp(-x + a * math.log(max(x, 1e-300)) - math.lgamma(a))


def nb_partials(k: Column, base: Column, log_mu: Column, alpha: Column) -> dict[str, Column]:
    """Derivatives of the negative binomial's log-mass by ``log_mu`` and by ``log_alpha``; 0 where the mass is."""
    r = 1 / F.greatest(alpha.cast("double"), F.lit(SMALL))
    mean = base * F.exp(log_mu)
    whole = r + mean
    by_mu = k - mean * (k + r) / whole
    by_r = digamma(k + r) - digamma(r) + F.ln(r / whole) + 1 - (k + r) / whole
    scored = (mean > 0) & (k >= 0)
    return {"log_mu": F.when(scored, by_mu).otherwise(0.0), "log_alpha": F.when(scored, -r * by_r).otherwise(0.0)}


def bb_partials(k: Column, n: Column, share: Column, tau: Column) -> dict[str, Column]:
    """Derivatives of the beta-binomial's log-mass by ``logit_p`` and by ``log_tau``; 0 where the mass is."""
    a, b = F.greatest(share * tau, F.lit(SMALL)), F.greatest((1 - share) * tau, F.lit(SMALL))
    whole = digamma(n + tau) - digamma(tau.cast("double"))
    by_a, by_b = digamma(k + a) - digamma(a), digamma(n - k + b) - digamma(b)
    scored = (k >= 0) & (k <= n)
    by_p = tau * (by_a - by_b) * share * (1 - share)
    by_tau = tau * (share * by_a + (1 - share) * by_b - whole)
    return {"logit_p": F.when(scored, by_p).otherwise(0.0), "log_tau": F.when(scored, by_tau).otherwise(0.0)}


def log_gamma(x):
    """log Gamma of an array of positive numbers: the same recurrence and series as the Column."""
    import numpy as np

    x = np.asarray(x, np.float64)
    product = x.copy()
    for i in range(1, SHIFT):
        product = product * (x + i)
    y = x + SHIFT
    inverse = 1 / y
    square, series = inverse * inverse, 0.0
    for c in reversed(STIRLING):
        series = series * square + c
    return (y - 0.5) * np.log(y) - y + HALF_LOG_TWO_PI + series * inverse - np.log(product)
