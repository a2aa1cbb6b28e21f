"""Threshold classes, unit scaling and small projections, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def error_tier(error: Column, fine: float = 1e-8, fair: float = 1e-4) -> Column:
    return F.when(error < fine, "ok").when(error < fair, "warn").otherwise("fail")


def temperature_class(degrees: Column) -> Column:
    return F.when(degrees >= 90, "critical").when(degrees >= 75, "warn").otherwise("normal")


def load_class(percent: Column) -> Column:
    return F.when(percent > 80, "danger").when(percent > 50, "warm").otherwise("normal")


def gauge_angle(percent: Column) -> Column:
    return 90 - percent / 100 * 360


def gigabytes(count: Column) -> Column:
    return count / 1e9


def degrees(millidegrees: Column) -> Column:
    return millidegrees / 1000


def rotated(modulus: Column, angle: Column) -> tuple[Column, Column, Column, Column]:
    """A vector of given modulus and phase -angle (degrees), and the same after rotation by the angle."""
    a = F.radians(angle)
    x, y = modulus * F.cos(a), -modulus * F.sin(a)
    return x, y, x * F.cos(a) - y * F.sin(a), x * F.sin(a) + y * F.cos(a)


def first_present(*values: Column) -> Column:
    """First reading that is there and above zero, in order of priority."""
    return F.coalesce(*[F.when(v > 0, v) for v in values])


def periodic(t: Column, step: float, every: int = 100) -> Column:
    """True on the grid point that is nearest to a multiple of ``every``."""
    return within_unit(t, every) & (F.abs(t - F.bround(t)) < step)


def within_unit(t: Column, every: int = 100) -> Column:
    """True on every point whose whole part is a multiple of ``every`` (earlier form: once per step of the unit)."""
    return F.floor(t).cast("long") % every == 0
