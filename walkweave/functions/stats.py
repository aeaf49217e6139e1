"""Likelihoods, divergences and tail probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: means below this are raised to it before a divergence is taken (fixed value)
TINY = 1e-10


def lgamma(x: Column) -> Column:
    """ln Gamma for x > 0: Stirling's series after shifting the argument by eight."""
    y = x + 8.0
    inv = 1.0 / y
    inv2 = inv * inv
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680 - inv2 / 1188))))
    shift = x
    for k in range(1, 8):
        shift = shift * (x + float(k))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(shift)


def nb_logpmf(x: Column, mean: Column, theta: float) -> Column:
    """ln P(X = x) for a negative binomial with the given mean and size."""
    if theta == 2:
        return F.ln(x + 1) + 2 * F.ln(2 / (2 + mean)) + x * F.ln(mean / (2 + mean))
    t = float(theta)
    comb = lgamma(x + t) - math.lgamma(t) - lgamma(x + 1.0)
    return comb + t * F.ln(t / (t + mean)) + x * F.ln(mean / (t + mean))


def poisson_logpmf(x: Column, mean: Column) -> Column:
    return x * F.ln(mean) - mean - lgamma(x + 1.0)


def count_logpmf(x: Column, mean: Column, theta: float) -> Column:
    """NB for theta > 0, Poisson otherwise; the observation is rounded half to even.

    A zero mean contributes nothing.
    """
    k = F.bround(x)
    lp = nb_logpmf(k, mean, theta) if theta > 0 else poisson_logpmf(k, mean)
    return F.when(mean == 0, 0.0).otherwise(lp)


def nb_kl(mean1: Column, mean2: Column, theta: float = 2) -> Column:
    """KL divergence of two negative binomials of one size, never below zero."""
    a, b, r = F.greatest(mean1, F.lit(TINY)), F.greatest(mean2, F.lit(TINY)), float(theta)
    return F.greatest(a * F.ln(a / b) + (r + a) * F.ln((r + b) / (r + a)), F.lit(0.0))


def nb_upper_tail(m: Column, mean: Column, theta: int = 2) -> Column:
    """P(X >= m) for an integer size: the first ``theta`` terms of a binomial sum."""
    p = float(theta) / (float(theta) + mean)
    q = mean / (float(theta) + mean)
    trials = m + float(theta - 1)
    total, choose = F.lit(0.0), F.lit(1.0)
    for k in range(theta):
        total = total + choose * F.pow(p, F.lit(k)) * F.pow(q, trials - float(k))
        choose = choose * (trials - float(k)) / float(k + 1)
    return F.when(m <= 0, 1.0).otherwise(total)
