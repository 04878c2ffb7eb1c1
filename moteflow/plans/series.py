"""Per-movie frame series: filling, smoothing, nearest neighbours in time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


def frame_grid(rows: DataFrame, key: str, frame: str) -> DataFrame:
    """Every frame 1..last of every ``key``."""
    last = rows.groupBy(key).agg(F.max(frame).alias("_last"))
    return last.select(key, F.explode(F.sequence(F.lit(1), "_last")).alias(frame))


def fill_linear(df: DataFrame, key: str, frame: str, cols: list[str]) -> DataFrame:
    """Missing values of a complete frame series: linear between the neighbours, ends held."""
    back = Window.partitionBy(key).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(frame).rowsBetween(0, Window.unboundedFollowing)
    tmp, out = {}, {}
    for c in cols:
        at = F.when(F.col(c).isNotNull(), F.col(frame))
        tmp |= {f"_{c}p": F.last(c, ignorenulls=True).over(back), f"_{c}pf": F.last(at, ignorenulls=True).over(back),
                f"_{c}n": F.first(c, ignorenulls=True).over(ahead), f"_{c}nf": F.first(at, ignorenulls=True).over(ahead)}
        p, n = F.col(f"_{c}p"), F.col(f"_{c}n")
        w = (F.col(frame) - F.col(f"_{c}pf")) / (F.col(f"_{c}nf") - F.col(f"_{c}pf"))
        out[c] = F.coalesce(F.col(c), F.when(p.isNotNull() & n.isNotNull(), p + (n - p) * w), p, n)
    return df.withColumns(tmp).withColumns(out).drop(*tmp)


def gauss_weights(sigma: float, radius: int) -> list[float]:
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(w)
    return [v / total for v in w]


def gauss_smooth(col: str, key: str, frame: str, sigma: float, radius: int) -> Column:
    """Weighted sum over +-radius frames of a complete series, the end values held beyond the ends."""
    w = Window.partitionBy(key).orderBy(frame)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head, tail = F.first(col).over(whole), F.last(col).over(whole)
    total = None
    for k, g in zip(range(-radius, radius + 1), gauss_weights(sigma, radius)):
        v = F.col(col) if k == 0 else (F.coalesce(F.lag(col, -k).over(w), head) if k < 0
                                       else F.coalesce(F.lead(col, k).over(w), tail))
        total = v * F.lit(g) if total is None else total + v * F.lit(g)
    return total
