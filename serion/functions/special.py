"""Special functions as native column expressions (no user functions)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Euler's constant (fixed value).
EULER_GAMMA = 0.5772156649015329


def theta(t: Column) -> Column:
    """Phase of the zeta function on the critical line, by its asymptotic series; t >= 10."""
    return t / 2 * F.log(t / (2 * math.pi)) - t / 2 - math.pi / 8 + 1 / (48 * t) + 7 / (5760 * t * t * t) + 31 / (80640 * t * t * t * t * t)


def zeta_on_line(t: Column, phase: Column, terms: int) -> Column:
    """Re(exp(i phase) zeta(1/2 + i t)) by Euler-Maclaurin summation; terms should be 3 t or more.

    The sum runs inside the row, as a fold over a sequence: no join is needed.
    """
    n = float(terms)
    parts = F.transform(F.sequence(F.lit(1), F.lit(terms - 1)), lambda k: F.cos(phase - t * F.log(k.cast("double"))) / F.sqrt(k.cast("double")))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    end = phase - t * math.log(n)
    c, s = F.cos(end), F.sin(end)
    # s (s+1) (s+2) at s = 1/2 + i t
    re, im = 1.875 - 4.5 * t * t, 5.75 * t - t * t * t
    return total + math.sqrt(n) * (t * s - 0.5 * c) / (t * t + 0.25) + 0.5 * c / math.sqrt(n) + (0.5 * c - t * s) / (12 * n**1.5) - (re * c - im * s) / (720 * n**3.5)


def hardy_z(t: Column, terms: int) -> Column:
    return zeta_on_line(t, theta(t), terms)


def real_zeta(t: Column, terms: int) -> Column:
    """Re zeta(1/2 + i t), the detector without rotation."""
    return zeta_on_line(t, F.lit(0.0), terms)


def zero_estimate(t: Column, correction: float = 0.0) -> Column:
    """Main term of the number of zeros up to height t; correction 7/8 for the next term."""
    return t / (2 * math.pi) * F.log(t / (2 * math.pi * math.e)) + correction


def log_gamma(x: Column) -> Column:
    """ln Gamma for x > 0: eight steps of the recurrence, then Stirling's series."""
    y = x + 8
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.log(product)


def gamma(x: Column) -> Column:
    """Gamma, by reflection for x < 0.5; null at the poles."""
    below = math.pi / (F.sin(x * math.pi) * F.exp(log_gamma(1 - x)))
    pole = (x <= 0) & (x == F.floor(x))
    return F.when(pole, F.lit(None).cast("double")).when(x < 0.5, below).otherwise(F.exp(log_gamma(F.greatest(x, F.lit(0.5)))))


def digamma(x: Column) -> Column:
    """psi for x > 0: eight steps of the recurrence, then the asymptotic series."""
    y = x + 8
    steps = F.lit(0.0)
    for k in range(8):
        steps = steps + 1 / (x + k)
    return F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * y * y * y * y) - 1 / (252 * y * y * y * y * y * y) + 1 / (240 * F.pow(y, F.lit(8.0))) - steps


def zeta(s: Column, terms: int = 40) -> Column:
    """zeta for real s other than 1: Euler-Maclaurin, by the functional equation for s < 0.5; null at the pole."""

    def right(s: Column) -> Column:
        n = float(terms)
        parts = F.transform(F.sequence(F.lit(1), F.lit(terms - 1)), lambda k: F.pow(k.cast("double"), -s))
        total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
        at = F.pow(F.lit(n), -s)
        return total + n * at / (s - 1) + at / 2 + s * at / (12 * n) - s * (s + 1) * (s + 2) * at / (720 * n**3) + s * (s + 1) * (s + 2) * (s + 3) * (s + 4) * at / (30240 * n**5)

    mirrored = F.pow(F.lit(2.0), s) * F.pow(F.lit(math.pi), s - 1) * F.sin(s * (math.pi / 2)) * gamma(1 - s) * right(1 - s)
    return F.when(s == 1, F.lit(None).cast("double")).when(s < 0.5, mirrored).otherwise(right(s))


def xi(s: Column) -> Column:
    """Completed function s (s - 1) / 2 pi**(-s/2) Gamma(s/2) zeta(s), the same at s and 1 - s."""
    return s * (s - 1) / 2 * F.pow(F.lit(math.pi), -s / 2) * gamma(s / 2) * zeta(s)
