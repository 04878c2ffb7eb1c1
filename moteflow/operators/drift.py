"""Whole-field drift: estimate, smooth, re-reference, subtract."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from moteflow.plans.series import fill_linear, frame_grid, gauss_smooth
AXES = {"dx": "xMean", "dy": "yMean", "dz": "zMicrons"}


def median_polish(rows: DataFrame, axes: dict[str, str], sweeps: int = 6, key: str = "movie") -> DataFrame:
    """Per-frame shift of each axis from the two-way model value = c(track) + D(frame) + noise.

    Alternating medians over tracks and frames. Both keys are finer than the movie, so a movie of any
    size is spread over the cluster.
    """
    per_track = Window.partitionBy(key, "track_number")
    per_frame = Window.partitionBy(key, "frame_number")
    df = rows.select(key, "track_number", "frame_number", *[F.col(v).alias("_v" + d) for d, v in axes.items()])
    df = df.withColumns({"_D" + d: F.lit(0.0) for d in axes})
    for _ in range(sweeps):
        df = df.withColumns({"_c" + d: F.median(F.col("_v" + d) - F.col("_D" + d)).over(per_track) for d in axes})
        df = df.withColumns({"_D" + d: F.median(F.col("_v" + d) - F.col("_c" + d)).over(per_frame) for d in axes})
    return df.groupBy(key, "frame_number").agg(*[F.first("_D" + d).alias(d) for d in axes])


def estimate_drift(rows: DataFrame, axes: dict[str, str] = AXES, z_sigma: float = 3.0, sweeps: int = 6,
                   key: str = "movie") -> DataFrame:
    """drift(movie, frame_number, dx, dy, dz, dz_raw): every frame of the movie, gaps interpolated, each
    axis relative to its median over the movie; dz smoothed over time and centred again."""
    shift = median_polish(rows, axes, sweeps, key)
    full = frame_grid(rows, key, "frame_number").join(shift, [key, "frame_number"], "left")
    full = fill_linear(full, key, "frame_number", list(axes))
    movie = Window.partitionBy(key)
    full = full.withColumns({d: F.coalesce(F.col(d) - F.median(d).over(movie), F.lit(0.0)) for d in axes})
    if "dz" in axes and z_sigma > 0:
        full = full.withColumnRenamed("dz", "dz_raw")
        full = full.withColumn("dz", gauss_smooth("dz_raw", key, "frame_number", z_sigma, int(4 * z_sigma + 0.5)))
        full = full.withColumn("dz", F.col("dz") - F.median("dz").over(movie))
    return full


def smooth_legacy_dz(drift: DataFrame, sigma: float = 3.0, key: str = "movie") -> DataFrame:
    """Drift tables written without dz_raw hold unsmoothed dz: smooth with a radius of 3 sigma."""
    if "dz_raw" in drift.columns:
        return drift
    out = drift.withColumnRenamed("dz", "dz_raw")
    out = out.withColumn("dz", gauss_smooth("dz_raw", key, "frame_number", sigma, math.ceil(3 * sigma)))
    return out.withColumn("dz", F.col("dz") - F.median("dz").over(Window.partitionBy(key)))


def with_drift(rows: DataFrame, drift: DataFrame, key: str = "movie") -> DataFrame:
    """Row's dx, dy, dz by frame; zero where the drift table has no entry."""
    d = drift.select(key, "frame_number", "dx", "dy", "dz")
    return rows.join(d, [key, "frame_number"], "left") \
        .withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("dx", "dy", "dz")})


def add_stabilized(rows: DataFrame, drift: DataFrame, x: str = "xMean", y: str = "yMean", z: str = "zMicrons",
                   axial_scale: float = 1.0) -> DataFrame:
    """x/y/zStabilized where missing; columns already present are kept."""
    src = {"xStabilized": F.col(x) - F.col("dx"), "yStabilized": F.col(y) - F.col("dy"),
           "zStabilized": (F.col(z) - F.col("dz")) * F.lit(axial_scale)}
    todo = {c: e for c, e in src.items() if c not in rows.columns}
    if not todo:
        return rows
    return with_drift(rows, drift).withColumns(todo).drop("dx", "dy", "dz")


def rereference(drift: DataFrame, rows: DataFrame, key: str = "movie") -> tuple[DataFrame, DataFrame]:
    """Move a drift table to its median reference and the stabilized columns with it; a table already
    centred is left as it is, so repeating changes nothing."""
    axes = [c for c in ("dx", "dy", "dz") if c in drift.columns]
    med = drift.groupBy(key).agg(*[F.median(c).alias("_m" + c) for c in axes])
    moved = drift.join(med, key).withColumns({c: F.col(c) - F.col("_m" + c) for c in axes}).drop(*["_m" + c for c in axes])
    stab = {"dx": "xStabilized", "dy": "yStabilized", "dz": "zStabilized"}
    out = rows.join(med, key, "left").withColumns(
        {stab[c]: F.col(stab[c]) + F.coalesce("_m" + c, F.lit(0.0)) for c in axes if stab[c] in rows.columns})
    return moved, out.drop(*["_m" + c for c in axes])
