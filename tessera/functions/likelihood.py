"""Count likelihoods as Column arithmetic, so that they stay in generated code: log-gamma, negative binomial, beta-binomial."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coefficients of the Stirling series of log-gamma, from 1/x on.
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360]
SHIFT = 8
HALF_LOG_TWO_PI = 0.9189385332046727
SMALL = 1e-10


def lgamma(x: Column) -> Column:
    """log Gamma of positive x: eight steps up by the recurrence, then Stirling's series."""
    x = x.cast("double")
    y = x + SHIFT
    product = x
    for i in range(1, SHIFT):
        product = product * (x + i)
    inverse = 1 / y
    square = inverse * inverse
    series = F.lit(0.0)
    for c in reversed(STIRLING):
        series = series * square + c
    return (y - 0.5) * F.ln(y) - y + HALF_LOG_TWO_PI + series * inverse - F.ln(product)


def log_beta(a: Column, b: Column) -> Column:
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def once_each(df: DataFrame, value: Column, name: str, *columns: str) -> DataFrame:
    """``df`` with ``value`` of ``columns`` as ``name``, computed once for each distinct tuple of them.

    Counts repeat far more often than they differ; the distinct tuples are few
    enough to be broadcast on most tables, and are shuffled where they are not.
    """
    keys = {f"__{c}": F.col(c) for c in columns}
    known = df.select(*columns).distinct().withColumn(name, value).withColumnsRenamed({c: f"__{c}" for c in columns})
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(columns, keys)]
    return df.join(known, same).drop(*keys)


def nb_log_pmf(k: Column, base: Column, log_mu: Column, alpha: Column) -> Column:
    """Negative binomial of mean base * exp(log_mu) and dispersion alpha; 0 where the mean is not positive or k negative."""
    r = 1 / F.greatest(alpha.cast("double"), F.lit(SMALL))
    mean = base * F.exp(log_mu)
    p = 1 / (1 + alpha * mean)
    body = lgamma(k + r) - lgamma(r) - lgamma(k + 1.0) + r * F.ln(p) + k * F.ln(1 - p)
    return F.when((mean <= 0) | (k < 0) | (p <= 0) | (p >= 1), F.lit(0.0)).otherwise(body)


def bb_log_pmf(k: Column, n: Column, share: Column, tau: Column) -> Column:
    """Beta-binomial of k among n with mean share and concentration tau; 0 where k is outside [0, n]."""
    a, b = F.greatest(share * tau, F.lit(SMALL)), F.greatest((1 - share) * tau, F.lit(SMALL))
    choose = lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0)
    return F.when((k < 0) | (k > n), F.lit(0.0)).otherwise(choose + log_beta(k + a, n - k + b) - log_beta(a, b))


def haldane(distance: Column, nu: float) -> Column:
    return (1 - F.exp(-2 * nu * distance)) / 2


def admixed_depth(a: Column, b: Column, purity: Column) -> Column:
    return purity * (a + b) / 2 + 1 - purity


def admixed_share(a: Column, b: Column, purity: Column) -> Column:
    return F.try_divide(purity * a + 1 - purity, purity * (a + b) + 2 * (1 - purity))
