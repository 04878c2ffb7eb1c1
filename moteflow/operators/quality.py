"""Verdicts, audits and summaries of tracked movies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from moteflow.functions.axial import axial_difference
from moteflow.operators.tracks import TRACK
from moteflow.plans.quantile import exact_quantiles
from moteflow.settings import DIM_SNR, MIN_CALIBRATION_BEADS


def movie_verdicts(rows: DataFrame, dim: float = DIM_SNR) -> DataFrame:
    """empty / dim / bright per movie from beads per frame and the median lobe signal."""
    per_frame = rows.groupBy("movie", "frame_number").count()
    beads = per_frame.groupBy("movie").agg(F.median("count").alias("beads"))
    snr = exact_quantiles(rows, ["movie"], "minLobeSNR", {"snr": 0.5})
    verdict = F.when(F.col("beads") < 3, "empty").when(F.col("snr") < dim, "dim").otherwise("bright")
    return beads.join(snr, "movie").withColumn("verdict", verdict)


def calibration_verdicts(rows: DataFrame, min_beads: int = MIN_CALIBRATION_BEADS) -> DataFrame:
    """too_dim / not_zscan / ok per scan, from the planes at a quarter, half and three quarters."""
    last = rows.groupBy("movie").agg(F.max("frame_number").alias("n"))
    picks = F.array_distinct(F.array(*[(F.rint((F.col("n") - 1) * q) + 1).cast("int") for q in (0.25, 0.5, 0.75)]))
    picked = last.select("movie", "n", F.explode(picks).alias("frame_number"))
    t = F.radians(F.col("angleDegrees") * 2)
    plane = rows.join(picked, ["movie", "frame_number"]).groupBy("movie", "n", "frame_number").agg(
        F.count("*").alias("beads"), (F.degrees(F.atan2(F.median(F.sin(t)), F.median(F.cos(t)))) / 2).alias("a"))
    w = Window.partitionBy("movie").orderBy("frame_number")
    turn = F.abs(axial_difference(F.col("a"), F.lag("a").over(w)))
    g = plane.withColumn("turn", turn).groupBy("movie").agg(
        F.min("n").alias("n"), F.median("beads").alias("beads_per_plane"), F.sum("turn").alias("rotation"))
    bad = (F.col("n") < 10) | F.col("rotation").isNull() | (F.col("rotation") < 10)
    return g.select("movie", "beads_per_plane", "rotation",
                    F.when(F.col("beads_per_plane") < min_beads, "too_dim").when(bad, "not_zscan").otherwise("ok").alias("verdict"))


def frame_counts(rows: DataFrame) -> DataFrame:
    """Localizations per frame: min, median, max per movie."""
    c = rows.groupBy("movie", "frame_number").count()
    return c.groupBy("movie").agg(F.min("count").alias("min_rows"), F.median("count").alias("median_rows"),
                                  F.max("count").alias("max_rows"), F.count("*").alias("frames_with_rows"))


def track_lengths(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*TRACK).agg(F.count("*").alias("n"), F.min("frame_number").alias("f0"), F.max("frame_number").alias("f1"))


def tracking_summary(rows: DataFrame, min_length: int = 3, extra: list[str] | None = None) -> DataFrame:
    """Kept, total, full-length and short tracks and the median kept length per movie."""
    keys = ["movie"] + (extra or [])
    n = rows.groupBy(*keys, "track_number").agg(F.count("*").alias("n"), F.min("frame_number").alias("f0"), F.max("frame_number").alias("f1"))
    kept = F.col("n") >= min_length
    span = n.groupBy(*keys).agg((F.max("f1") - F.min("f0") + 1).alias("frames"))
    return n.join(span, keys).groupBy(*keys).agg(
        F.count("*").alias("tracks_total"), F.count_if(kept).alias("tracks_kept"),
        F.count_if(kept & (F.col("n") >= F.col("frames"))).alias("full_length"),
        F.coalesce(F.median(F.when(kept, F.col("n"))), F.lit(0.0)).alias("median_length"),
        F.count_if(~kept).alias("short_tracks"),
        F.coalesce(F.sum(F.when(~kept, F.col("n"))), F.lit(0).cast("long")).alias("short_rows"))


def compare_trackers(rows: DataFrame, far_px: float = 6) -> DataFrame:
    """Per movie and method: tracks, full-length and long ones, completeness, steps above ``far_px``."""
    keys = ["movie", "method"]
    w = Window.partitionBy(*keys, "track_number").orderBy("frame_number")
    dx, dy = F.col("xMean") - F.lag("xMean").over(w), F.col("yMean") - F.lag("yMean").over(w)
    per = rows.withColumn("_s", F.sqrt(dx * dx + dy * dy)).groupBy(*keys, "track_number").agg(
        F.count("*").alias("n"), F.count_if(F.col("_s") > far_px).alias("swaps"), F.max("frame_number").alias("f1"))
    last = per.groupBy(*keys).agg(F.max("f1").alias("nframes"))
    long_ = F.col("n") >= 10
    return per.join(last, keys).groupBy(*keys).agg(
        F.count("*").alias("tracks"), F.count_if(F.col("n") == F.col("nframes")).alias("full_length"),
        F.count_if(long_).alias("at_least_10"), F.count_if(F.col("n") < 3).alias("transient_lt3"),
        F.median("n").alias("median_length"),
        F.try_divide(F.sum(F.when(long_, F.col("n"))).cast("double"), F.max("nframes") * F.count_if(long_)).alias("completeness"),
        F.sum("swaps").alias(f"steps_over_{far_px:g}px"))


def audit(rows: DataFrame) -> DataFrame:
    """Invariants of a tracked movie (as counts of violations) and its completeness and quality."""
    w = Window.partitionBy(*TRACK).orderBy("frame_number")
    df = F.col("frame_number") - F.lag("frame_number").over(w)
    dx, dy = F.col("xMean") - F.lag("xMean").over(w), F.col("yMean") - F.lag("yMean").over(w)
    turn = axial_difference(F.col("angleDegrees"), F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))))
    r = rows.withColumns({"_df": df, "_step": F.sqrt(dx * dx + dy * dy)})
    bad = {"bad_x": F.abs(F.col("xMean") - (F.col("x1") + F.col("x2")) / 2) > 1e-7,
           "bad_y": F.abs(F.col("yMean") - (F.col("y1") + F.col("y2")) / 2) > 1e-7,
           "bad_angle": F.abs(turn) > 1e-6, "bad_range": ~((F.col("angleDegrees") >= 0) & (F.col("angleDegrees") < 180)),
           "bad_order": F.col("_df") <= 0}
    rec = F.col("recovered") == 1
    movie = r.groupBy("movie").agg(
        F.count("*").alias("n_rows"), F.max("frame_number").alias("frames"),
        *[F.count_if(c).alias(n) for n, c in bad.items()], F.count_if(rec).alias("recovered_rows"),
        F.count_if(F.col("_df") > 1).alias("gap_links"), F.coalesce(F.max(F.when(F.col("_df") > 1, F.col("_df"))), F.lit(0)).alias("max_gap"),
        F.max("_step").alias("max_step"), *[F.count_if(F.col("zStatus") == k).alias(f"z_status_{k}") for k in range(4)],
        F.sum("sharedLobe").alias("shared_rows"), F.count_if(F.col("templateScore") < 0.5).alias("template_below_half"))
    med = exact_quantiles(r, ["movie"], "_step", {"median_step": 0.5}) \
        .join(exact_quantiles(r, ["movie"], "minLobeSNR", {"median_snr": 0.5}), "movie") \
        .join(exact_quantiles(r.where(~rec), ["movie"], "templateScore", {"template_detected": 0.5}), "movie", "left") \
        .join(exact_quantiles(r.where(rec), ["movie"], "templateScore", {"template_recovered": 0.5}), "movie", "left")
    lengths = track_lengths(rows).join(movie.select("movie", "frames"), "movie")
    long_ = F.col("n") >= 10
    done = lengths.groupBy("movie").agg(
        F.count("*").alias("tracks"), F.count_if(F.col("n") == F.col("frames")).alias("full_length_tracks"),
        F.count_if(long_).alias("tracks_ge_10"),
        F.try_divide(F.sum(F.when(long_, F.col("n"))).cast("double"), F.sum(F.when(long_, F.col("f1") - F.col("f0") + 1))).alias("within_span"),
        F.try_divide(F.sum(F.when(long_, F.col("n"))).cast("double"), F.max("frames") * F.count_if(long_)).alias("whole_movie"))
    return movie.join(med, "movie").join(done, "movie")
