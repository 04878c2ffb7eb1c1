"""Expressions on a pair of fitted lobes."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from moteflow.functions.axial import fold, length
from moteflow.settings import DEFAULTS, Settings


def swapped(dx: Column, dy: Column) -> Column:
    """True when the lobes must trade places so that dy >= 0 (ties: dx >= 0)."""
    return (dy < 0) | ((dy == 0) & (dx < 0))


def pair_angle(dx: Column, dy: Column) -> Column:
    s = swapped(dx, dy)
    return fold(F.degrees(F.atan2(F.when(s, -dy).otherwise(dy), F.when(s, -dx).otherwise(dx))))


def separation(dx: Column, dy: Column) -> Column:
    return length(dx, dy)


def pair_snr(a1: Column, s1: Column, a2: Column, s2: Column, noise: Column) -> Column:
    return F.sqrt(F.lit(math.pi) * (a1 * a1 * s1 * s1 + a2 * a2 * s2 * s2)) / F.greatest(noise, F.lit(1e-9))


def lobe_floor(noise: Column, cfg: Settings = DEFAULTS) -> Column:
    """Smallest amplitude of a lobe that may be paired."""
    return F.lit(cfg.lobe_floor_snr if cfg.min_pair_snr > 0 else cfg.min_snr) * noise


def lobe_signal(amp: Column, sigma: Column, shared: Column) -> Column:
    """Light of one fitted lobe; unknown for the lobe two beads share."""
    return F.when(~shared, F.lit(2 * math.pi) * amp * sigma * sigma)


def pair_cost(a1: Column, s1: Column, a2: Column, s2: Column, sep: Column, residual: Column,
              noise: Column | None = None, cfg: Settings = DEFAULTS) -> Column:
    """Implausibility of two lobes as one bead (lower is better), NULL when a hard limit is broken."""
    ratio = F.greatest(a1, a2) / F.least(a1, a2)
    shape = F.pow(F.log(ratio) / F.lit(cfg.ratio_log_sd), 2) + F.pow((s1 - s2) / F.lit(cfg.sigma_sd), 2)
    if cfg.sep_sd_mode == "precision" and noise is not None:
        e1, e2 = F.lit(0.8) * noise / a1, F.lit(0.8) * noise / a2
        sd = F.sqrt(F.lit(cfg.sep_sd_floor_px ** 2) + e1 * e1 + e2 * e2)
        gate = F.least(F.lit(cfg.sep_gate_px), F.greatest(F.lit(1.2), sd * 6))
    else:
        sd, gate = F.lit(cfg.sep_sd_px), F.lit(cfg.sep_gate_px)
    known = F.when(F.abs(residual) <= gate, shape + F.pow(residual / sd, 2))
    off = F.greatest(F.lit(15.0) - sep, F.lit(0.0), sep - F.lit(24.0))
    guess = shape + F.pow(off / F.lit(cfg.sep_sd_px), 2)
    ok = sep.between(cfg.min_separation, cfg.max_separation) & (F.least(a1, a2) > 0) & (ratio <= cfg.max_ratio)
    return F.when(ok, F.when(residual.isNotNull(), known).otherwise(guess))


def pair_precision(aa: list[Column], bb: list[Column], ab: list[Column], dx: Column, dy: Column) -> dict[str, Column]:
    """sd of the midpoint (px) and of the angle (deg) from the 2x2 blocks [xx, xy, yx, yy] of the centre
    covariance of lobes a and b and their cross block."""
    xx = (aa[0] + bb[0] + ab[0] * 2) / 4
    yy = (aa[3] + bb[3] + ab[3] * 2) / 4
    n = F.greatest(dx * dx + dy * dy, F.lit(1e-9))
    gx, gy = -dy / n, dx / n
    v = [aa[0] + bb[0] - ab[0] * 2, aa[1] + bb[1] - ab[1] - ab[2], aa[2] + bb[2] - ab[2] - ab[1], aa[3] + bb[3] - ab[3] * 2]
    var = gx * (v[0] * gx + v[1] * gy) + gy * (v[2] * gx + v[3] * gy)
    pos = lambda c: F.when(c.isNotNull(), F.sqrt(F.greatest(c, F.lit(0.0))))  # greatest skips NULL
    return {"xPrecisionPx": pos(xx), "yPrecisionPx": pos(yy), "anglePrecisionDeg": F.degrees(pos(var))}
