"""Exports with a shape: fields, regions, drift, motion tables and summaries, each written by Spark and read back the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from moteflow.settings import DIM_OVERRIDES, DIM_SNR, OBJECTIVE_Z_RANGE_UM
from moteflow.sources.tables import movie_summary, write_csv

FIELD_KEYS = ["movie", "frame_number", "x_um", "y_um", "z0_um"]
FIELD_VALUES = ["ux_um", "uy_um", "uz_um", "areal_strain_pct", "shear_strain_pct", "tilt_deg"]
ROI = "movie string, roi string, x double, y double, width double, height double, closed boolean, points array<struct<x double, y double>>"


# ------------------------------------------------------------------ fields

def grid_faults(field: DataFrame) -> DataFrame:
    """(movie, frame_number, nodes, expected, repeated): frames whose nodes are not exactly the movie's grid, which is every x with every y of it. A whole field gives no row."""
    grid = field.groupBy("movie").agg(F.countDistinct("x_um").alias("nx"), F.countDistinct("y_um").alias("ny"))
    per = field.groupBy("movie", "frame_number").agg(F.count("*").alias("rows"), F.countDistinct("x_um", "y_um").alias("nodes"))
    return per.join(grid, "movie").select("movie", "frame_number", "nodes", (F.col("nx") * F.col("ny")).alias("expected"), (F.col("rows") - F.col("nodes")).alias("repeated")) \
        .where("nodes <> expected OR repeated > 0")


def write_field(field: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One row per frame and grid node, frames of a movie in order. An inconsistent grid is refused before anything is written; missing values inside the grid stay empty."""
    fault = grid_faults(field).first()
    if fault is not None:
        raise ValueError(f"field of {fault.movie}, frame {fault.frame_number}: {fault.nodes} nodes ({fault.repeated} repeated), expected {fault.expected}")
    ordered = field.select(*FIELD_KEYS, *FIELD_VALUES).repartition("movie", "frame_number").sortWithinPartitions("movie", "frame_number", "y_um", "x_um")
    write_csv(ordered, path, mode=mode)


def read_field(spark: SparkSession, path: str) -> DataFrame:
    types = {"movie": "string", "frame_number": "int"}
    return spark.read.option("header", True).schema(", ".join(f"{c} {types.get(c, 'double')}" for c in FIELD_KEYS + FIELD_VALUES)).csv(path)


# ------------------------------------------------------------------ regions

def write_rois(rois: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Regions as JSON, a folder per movie: boxes (x, y, width, height) and polygons (points)."""
    rois.write.mode(mode).partitionBy("movie").option("ignoreNullFields", False).json(path)


def read_rois(spark: SparkSession, path: str) -> DataFrame:
    """Regions written by ``write_rois``; fields that an older file lacks are null."""
    return spark.read.schema(ROI).json(path)


# ------------------------------------------------------------------ drift, motion and summaries

def write_drift(drift: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Smoothed and raw drift by movie and frame."""
    cols = ["movie", "frame_number", "dx", "dy", "dz", *[c for c in ("dz_raw",) if c in drift.columns]]
    write_csv(drift.select(*cols).repartition("movie").sortWithinPartitions("movie", "frame_number"), path, mode=mode)


def write_motion(tracks: DataFrame, states: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Two tables by movie: one row per track, one row per localization with its state."""
    for name, df, order in (("track_motion", tracks, ["movie", "track_number"]), ("motion_states", states, ["movie", "track_number", "frame_number"])):
        df.repartition("movie").sortWithinPartitions(*order).write.mode(mode).partitionBy("movie").parquet(f"{path}/{name}")


def write_summaries(rows: DataFrame, rejected: DataFrame, path: str, motion: DataFrame | None = None, mode: str = "overwrite") -> None:
    """One nested JSON record per movie, with ``motion(movie, ...)`` as a record inside it where there is one."""
    out = movie_summary(rows, rejected)
    if motion is not None:
        out = out.join(motion.select("movie", F.struct(*[c for c in motion.columns if c != "movie"]).alias("motion")), "movie", "left")
    out.write.mode(mode).option("ignoreNullFields", False).json(path)


# ------------------------------------------------------------------ what a recording suggests

def suggested_planes(planes: Column, objective: Column, z_step_um: Column, margin_um: float = 5.0) -> Column:
    """(first, last) plane, one-based, of a scan that the depth range of its objective needs: the range and a margin on both sides of the middle. All planes for an
    objective without a known range."""
    known = F.create_map(*[F.lit(v) for k, r in OBJECTIVE_Z_RANGE_UM.items() for v in (k, float(r))])
    half = F.ceil((F.try_element_at(known, objective) + margin_um) / z_step_um)
    middle = (planes + 1) / F.lit(2.0)
    first = F.coalesce(F.greatest(F.lit(1), F.floor(middle - half)), F.lit(1))
    last = F.coalesce(F.least(planes, F.ceil(middle + half)), planes)
    return F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"))


def sidecar_fields(text: Column) -> Column:
    """(interval_ms, roi) of a metadata text: the first positive frame interval and the camera region [x, y, width, height]; null where it has none."""
    intervals = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r'"Interval_ms"\s*:\s*([0-9.]+)'), 1), lambda v: v.try_cast("double")), lambda v: v > 0)
    roi = F.regexp_extract_all(text, F.lit(r'"ROI"\s*:\s*"(\d+-\d+-\d+-\d+)"'), 1)
    return F.struct(F.get(intervals, F.lit(0)).alias("interval_ms"), F.transform(F.split(F.get(roi, F.lit(0)), "-"), lambda v: v.cast("int")).alias("roi"))


def dim_overrides(checks: DataFrame, priority: int) -> DataFrame:
    """Settings(movie, key, value, priority) of the movies in ``checks(movie, median_snr)`` that are dim; a movie without a median is not."""
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(str(v)).alias("value")) for k, v in DIM_OVERRIDES.items()]))
    return checks.where(F.col("median_snr") < DIM_SNR).select("movie", keys.alias("s")).select("movie", "s.key", "s.value", F.lit(priority).alias("priority"))


def refined_maxima(peaks: DataFrame, pixels: DataFrame) -> DataFrame:
    """``peaks(movie, frame, x, y)`` with fx and fy: the vertex of the parabola through the maximum and its two neighbours on each axis, at most half a pixel away. A peak on the
    image's edge, or with a neighbour missing, stays where it is."""
    spot = pixels.select("movie", "frame", F.col("x").alias("_x"), F.col("y").alias("_y"), "v")
    near = F.explode(F.array(*[F.struct(F.lit(n).alias("at"), (F.col("x") + i).alias("_x"), (F.col("y") + j).alias("_y")) for n, i, j in (("c", 0, 0), ("l", -1, 0), ("r", 1, 0), ("u", 0, -1), ("d", 0, 1))]))
    five = peaks.select("movie", "frame", "x", "y", near.alias("n")).select("movie", "frame", "x", "y", "n.*").join(spot, ["movie", "frame", "_x", "_y"]) \
        .groupBy("movie", "frame", "x", "y").agg(*[F.max(F.when(F.col("at") == n, F.col("v"))).alias("_" + n) for n in "clrud"])

    def vertex(low: str, high: str) -> Column:
        bend = F.col(low) - F.col("_c") * 2 + F.col(high)
        whole = F.col("_l").isNotNull() & F.col("_r").isNotNull() & F.col("_u").isNotNull() & F.col("_d").isNotNull()
        return F.when(whole & (bend < 0), F.greatest(F.lit(-0.5), F.least(F.lit(0.5), (F.col(low) - F.col(high)) / (bend * 2)))).otherwise(0.0)
    return peaks.join(five, ["movie", "frame", "x", "y"], "left").withColumns({"fx": F.col("x") + vertex("_l", "_r"), "fy": F.col("y") + vertex("_u", "_d")}).drop(*["_" + n for n in "clrud"])
