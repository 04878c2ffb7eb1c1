"""Position on the sensor and the polynomials defined on it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def field_uv(x: Column, y: Column, ox: Column | float, oy: Column | float, sensor: float = 2048.0) -> tuple[Column, Column]:
    """One-based image pixel to sensor coordinates in -1..1."""
    as_col = lambda o: o if isinstance(o, Column) else F.lit(float(o))
    centre, half = F.lit((sensor + 1) / 2), F.lit(sensor / 2)
    return (x + as_col(ox) - centre) / half, (y + as_col(oy) - centre) / half


def quadratic_terms(u: Column, v: Column) -> list[Column]:
    """1, u, v, u², uv, v²."""
    return [F.lit(1.0), u, v, u * u, u * v, v * v]


def lateral_terms(z: Column, u: Column, v: Column) -> list[Column]:
    """z, zu, zv, z², z²u, z²v; a missing z means no shift."""
    z = F.coalesce(z, F.lit(0.0))
    return [z, z * u, z * v, z * z, z * z * u, z * z * v]


def combine(terms: list[Column], coef: list[float] | Column) -> Column:
    """Sum of term x coefficient; ``coef`` is a list or an array column."""
    total = None
    for i, t in enumerate(terms):
        c = coef[i] if isinstance(coef, Column) else F.lit(float(coef[i]))
        total = t * c if total is None else total + t * c
    return total


def separation_offset(x: Column, y: Column, coef: Column, ox: Column | float = 0.0, oy: Column | float = 0.0, sensor: float = 2048.0) -> Column:
    """How much wider than calibrated lobes stand at an image pixel; 0 where ``coef`` is NULL, that is without a map."""
    u, v = field_uv(x, y, ox, oy, sensor)
    return F.coalesce(combine(quadratic_terms(u, v), coef), F.lit(0.0))


def sensor_offset(size: Column, sensor: float, roi_at: Column, roi_size: Column) -> Column:
    """Crop position on the sensor: the recorded one when its size matches the image, else centred."""
    return F.when(roi_size == size, roi_at.cast("double")).otherwise((F.lit(sensor) - size) / 2)
