"""Row and track filters, regions, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from moteflow.operators.tracks import TRACK
from moteflow.plans.spatial import near_join


def upper_median(col: Column) -> Column:
    """Element n >> 1 of the sorted values (the upper of the two middle ones)."""
    a = F.array_sort(F.collect_list(col))
    return F.when(F.size(a) > 0, F.element_at(a, (F.floor(F.size(a) / 2) + 1).cast("int")))


def track_brightness(rows: DataFrame, radius: float = 150.0) -> DataFrame:
    """Weaker-lobe amplitude of each track in percent of the tracks around it (upper medians; fewer than
    three neighbours: of the whole movie). Tracks are reduced to one row each before the radius join."""
    one = rows.groupBy(*TRACK).agg(upper_median(F.least("amplitude1", "amplitude2")).alias("amp"),
                                   upper_median(F.col("xMean")).alias("cx"), upper_median(F.col("yMean")).alias("cy"))
    one = one.where(F.col("amp").isNotNull())
    near = one.select("movie", F.col("track_number").alias("t2"), F.col("amp").alias("amp2"),
                      F.col("cx").alias("cx2"), F.col("cy").alias("cy2"))
    pairs = near_join(one, near, radius, ["movie"], ("cx", "cy"), ("cx2", "cy2"), F.col("track_number") != F.col("t2"))
    local = pairs.groupBy(*TRACK).agg(F.count("*").alias("n"), upper_median(F.col("amp2")).alias("ref"))
    # one value per track of the movie
    whole = one.groupBy("movie").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY amp DESC)").alias("all_ref"))
    ref = F.when(F.col("n") >= 3, F.col("ref")).otherwise(F.col("all_ref"))
    return one.join(local, TRACK, "left").join(whole, "movie") \
        .select(*TRACK, F.when(ref > 0, F.lit(100.0) * F.col("amp") / ref).alias("brightness"))


def filter_rows(rows: DataFrame, z: str = "zMicrons", frames: tuple[int, int] | None = None, valid_only: bool = False,
                z_range: tuple[float | None, float | None] = (None, None), recovered: str = "all") -> DataFrame:
    out = rows
    if frames:
        out = out.where(F.col("frame_number").between(*frames))
    if valid_only:
        out = out.where(F.col("zMicrons").isNotNull() & (F.col("zStatus") == 0))
    if z_range[0] is not None:
        out = out.where(F.col(z) >= z_range[0])
    if z_range[1] is not None:
        out = out.where(F.col(z) <= z_range[1])
    if recovered in ("hide", "only"):
        out = out.where(F.col("recovered") == (0 if recovered == "hide" else 1))
    return out


def filter_tracks(rows: DataFrame, min_length: int = 1, min_brightness: float = 0.0, brightness: DataFrame | None = None,
                  motion: str = "all", classes: DataFrame | None = None) -> DataFrame:
    """Track filters on what the row filters left; brightness and class are those of the whole track."""
    out = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*TRACK))) \
        .where(F.col("_n") >= max(1, min_length)).drop("_n")
    if min_brightness > 0:
        out = out.join(brightness.where(F.col("brightness") >= min_brightness), TRACK, "left_semi")
    if motion == "moving":
        out = out.join(classes.where(F.col("frames_moving") > 0), TRACK, "left_semi")
    elif motion != "all":
        out = out.join(classes.where(F.col("motion_class") == motion), TRACK, "left_semi")
    return out


def in_polygon(x: Column, y: Column, pts: Column) -> Column:
    """Even-odd rule over an array of structs (x, y)."""
    n = F.size(pts)
    def crosses(i: Column) -> Column:
        p, q = F.get(pts, i), F.get(pts, (i + n - 1) % n)
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])
    return F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1


def in_rectangle(x: Column, y: Column, pts: Column) -> Column:
    a, b = F.get(pts, F.lit(0)), F.get(pts, F.lit(1))
    return x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def in_roi(rows: DataFrame, rois: DataFrame, x: str = "xMean", y: str = "yMean") -> DataFrame:
    """Rows inside each region: ``rois(movie, roi_id, kind, pts)``, equi-join on the movie."""
    inside = F.when(F.col("kind") == "rect", in_rectangle(F.col(x), F.col(y), F.col("pts"))) \
        .otherwise(in_polygon(F.col(x), F.col(y), F.col("pts")))
    return rows.join(rois, "movie").where(inside).drop("kind", "pts")


def tracks_in_roi(rows: DataFrame, rois: DataFrame, frame: int | None = None) -> DataFrame:
    r = rows if frame is None else rows.where(F.col("frame_number") == frame)
    return in_roi(r, rois).select("roi_id", *TRACK).distinct()


def eligible_tracks(rows: DataFrame, xyz: list[str], min_points: int = 10) -> DataFrame:
    """Rows with finite coordinates of tracks that have at least ``min_points`` of them."""
    ok = rows
    for c in xyz:
        ok = ok.where(F.col(c).isNotNull())
    return ok.withColumn("_n", F.count("*").over(Window.partitionBy(*TRACK))).where(F.col("_n") >= min_points).drop("_n")


def repair_precision(rows: DataFrame, cols: list[str], default: float = 0.1) -> DataFrame:
    """Missing or non-positive standard errors become the track's median, else the default."""
    w = Window.partitionBy(*TRACK)
    good = {c: F.when(F.col(c) > 0, F.col(c)) for c in cols}
    return rows.withColumns({c: F.coalesce(g, F.median(g).over(w), F.lit(default)) for c, g in good.items()})


def low_quality_tracks(rows: DataFrame, cfg) -> DataFrame:
    """(movie, track_number) with both a low signal and a poor template score, judged on detected rows
    when a track has any."""
    from moteflow.plans.quantile import exact_quantiles
    det = F.col("recovered") != 1
    any_det = F.max(det).over(Window.partitionBy(*TRACK))
    use = rows.withColumn("_u", det | ~any_det).where("_u")
    med = use.groupBy(*TRACK).agg(F.median("minLobeSNR").alias("snr"), F.median("templateScore").alias("score"))
    typical = exact_quantiles(med, ["movie"], "snr", {"typical": 0.5})
    cut_ = F.least(F.lit(cfg.reject_track_snr), F.col("typical") * cfg.reject_track_snr_fraction)
    return med.join(typical, "movie").where((F.col("snr") < cut_) & (F.col("score") < cfg.reject_track_template)).select(*TRACK)


def analysis_coordinates(rows: DataFrame, corr: bool, xy: bool, z: bool, refined: bool, pixel_um: float | None = None) -> DataFrame:
    """xAnalysis, yAnalysis, zAnalysis from four independent switches, each falling back to the raw value
    row by row; expects dx, dy, dz (and refine_*) columns for the switches that need them."""
    has = set(rows.columns)
    corr = corr and {"xCorrected", "yCorrected"} <= has
    xy, z = xy and "dx" in has, z and "dz" in has
    refined = refined and "refine_dx_px" in has
    x = F.coalesce("xCorrected", "xMean") if corr else F.col("xMean")
    y = F.coalesce("yCorrected", "yMean") if corr else F.col("yMean")
    h = F.col("zMicrons")
    if xy:
        x, y = x - F.coalesce("dx", F.lit(0.0)), y - F.coalesce("dy", F.lit(0.0))
    if z:
        h = h - F.coalesce("dz", F.lit(0.0))
    if refined:
        on = F.col("refine_dx_px").isNotNull()
        x = x + F.when(on, F.col("refine_dx_px")).otherwise(0.0)
        y = y + F.when(on, F.col("refine_dy_px")).otherwise(0.0)
        h = h + F.when(on, F.col("refine_dz_um")).otherwise(0.0)
    if pixel_um is not None:
        x, y = x * F.lit(pixel_um), y * F.lit(pixel_um)
    return rows.withColumns({"xAnalysis": x, "yAnalysis": y, "zAnalysis": h,
                             "coordinates": coordinate_label(F.lit(corr), F.lit(xy), F.lit(z), F.lit(refined))})


def coordinate_label(corr: Column, xy: Column, z: Column, refined: Column) -> Column:
    stab = F.concat_ws(" + ", F.when(xy, F.lit("XY")), F.when(z, F.lit("Z")))
    return F.concat_ws(" · ", F.when(corr, F.lit("lateral-corrected")).otherwise(F.lit("raw")),
                       F.when(xy | z, F.concat(stab, F.lit(" stabilized"))), F.when(refined, F.lit("refined")))


def position_sd(rows: DataFrame) -> DataFrame:
    """Position sd: the smoother's, else the reported one, else a default; must be positive."""
    def pick(ref: str, rep: str, default: float) -> Column:
        cands = [F.when(F.col(c) > 0, F.col(c)) for c in (ref, rep) if c in rows.columns]
        return F.coalesce(*cands, F.lit(default))
    return rows.withColumns({"sdX": pick("refined_sd_x_px", "xPrecisionPx", 0.1), "sdY": pick("refined_sd_y_px", "yPrecisionPx", 0.1),
                             "sdZ": pick("refined_sd_z_um", "zPrecisionUm", 0.5)})


def thin(beads: DataFrame, key: list[str], order: str, limit: int = 600) -> DataFrame:
    """Deterministic subset of at most ``limit`` beads per group: (i * 7919) mod n below the limit."""
    w = Window.partitionBy(*key)
    i = F.row_number().over(w.orderBy(order)) - 1
    n = F.count("*").over(w)
    return beads.withColumns({"_i": i, "_n": n}) \
        .where((F.col("_n") <= limit) | ((F.col("_i").cast("long") * 7919) % F.col("_n") < limit)).drop("_i", "_n")
