"""Axial angles: period 180 degrees, so 1 and 179 are 2 apart."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def axial_difference(a: Column, b: Column) -> Column:
    """a - b folded into [-90, 90). Folded in the same rounded steps as in SQL, so that a turn at a limit falls on the same side of it."""
    return ((a - b + F.lit(90.0)) % F.lit(180.0) + F.lit(180.0)) % F.lit(180.0) - F.lit(90.0)


def fold(a: Column) -> Column:
    """Angle in [0, 180)."""
    return F.pmod(a, F.lit(180.0))


def axial_mean(a: Column) -> Column:
    """Aggregate: direction of the mean doubled-angle vector, degrees in (-90, 90]."""
    t = F.radians(a * 2.0)
    return F.degrees(F.atan2(F.avg(F.sin(t)), F.avg(F.cos(t)))) / 2.0


def length2(dx: Column, dy: Column) -> Column:
    return dx * dx + dy * dy


def length(dx: Column, dy: Column) -> Column:
    # sqrt of squares rather than hypot: the same correctly rounded steps on every engine
    return F.sqrt(dx * dx + dy * dy)
