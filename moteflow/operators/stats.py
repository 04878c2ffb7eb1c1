"""Aggregations over localizations, tracks and pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from moteflow.functions.axial import axial_difference, axial_mean, fold
from moteflow.operators.tracks import TRACK
from moteflow.plans.quantile import exact_quantiles
from moteflow.plans.series import gauss_weights
from moteflow.plans.spatial import near_join
from moteflow.settings import DEFAULTS, Settings


def plane_consensus(rows: DataFrame, cfg: Settings = DEFAULTS, keys: tuple[str, ...] = ("movie", "frame_number")) -> DataFrame:
    """Robust angle and separation of the beads of each calibration plane: axial median, one trim, median
    again; angle and separation are NULL with fewer than the minimum of beads."""
    k, least = list(keys), cfg.calibration_min_beads_per_plane
    w = Window.partitionBy(*k)
    a = F.col("angleDegrees")
    t = rows.withColumn("_n", F.count("*").over(w)) \
        .withColumns({"_s": F.avg(F.sin(F.radians(a * 2))).over(w), "_c": F.avg(F.cos(F.radians(a * 2))).over(w)}) \
        .withColumn("_ref", F.degrees(F.atan2("_s", "_c")) / 2)
    t = t.withColumn("_med", F.col("_ref") + F.median(axial_difference(a, F.col("_ref"))).over(w))
    keep = F.abs(axial_difference(a, F.col("_med"))) <= cfg.calibration_max_residual_deg
    t = t.withColumn("_d", F.when(keep, axial_difference(a, F.col("_med"))))
    t = t.withColumn("_angle", fold(F.col("_med") + F.median("_d").over(w)))
    dev = F.when(F.col("_d").isNotNull(), F.abs(axial_difference(a, F.col("_angle"))))
    g = t.groupBy(*k).agg(F.first("_n").alias("n_all"), F.count("_d").alias("support"), F.first("_angle").alias("_angle"),
                          F.median(F.when(F.col("_d").isNotNull(), F.col("lobeSeparationPixels"))).alias("_sep"),
                          F.median(dev).alias("_mad"))
    ok = (F.col("n_all") >= least) & (F.col("support") >= least)
    return g.select(*k, F.when(F.col("n_all") >= least, F.col("support")).otherwise(F.col("n_all")).alias("support"),
                    F.when(ok, F.col("_angle")).alias("angle"), F.when(ok, F.col("_sep")).alias("separation"),
                    F.when(ok, F.col("_mad") * 1.4826).alias("scatter"))


def bead_residuals(rows: DataFrame, planes: DataFrame) -> DataFrame:
    """Median absolute angle difference of each bead to the plane consensus."""
    j = rows.join(planes.select("movie", "frame_number", "angle"), ["movie", "frame_number"])
    return j.groupBy(*TRACK).agg(F.median(F.abs(axial_difference(F.col("angleDegrees"), F.col("angle")))).alias("residual"))


def longest_run(planes: DataFrame) -> DataFrame:
    """The longest run of consecutive valid planes per scan (the first of equal ones)."""
    ok = planes.where(F.col("angle").isNotNull() & F.col("separation").isNotNull())
    w = Window.partitionBy("movie").orderBy("frame_number")
    isl = ok.withColumn("_isl", F.col("frame_number") - F.row_number().over(w))
    runs = isl.groupBy("movie", "_isl").agg(F.count("*").alias("n"), F.min("frame_number").alias("f0"))
    best = runs.groupBy("movie").agg(F.max_by("_isl", F.struct("n", -F.col("f0"))).alias("_isl"))
    return isl.join(best, ["movie", "_isl"]).drop("_isl")


def unwrap(df: DataFrame, key: str, order: str, angle: str, out: str = "unwrapped") -> DataFrame:
    """Remove jumps of 180 degrees along ``order``: first value plus the running sum of folded steps."""
    w = Window.partitionBy(key).orderBy(order)
    step = axial_difference(F.col(angle), F.lag(angle).over(w))
    # a step of exactly half a period keeps the sign of the raw difference
    raw = F.col(angle) - F.lag(angle).over(w)
    step = F.when((step == -90) & (raw > 0), F.lit(90.0)).otherwise(step)
    return df.withColumn("_st", F.coalesce(step, F.lit(0.0))).withColumn(
        out, F.first(angle).over(w) + F.sum("_st").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_st")


def error_scale(rows: DataFrame, axes: dict[str, tuple[str, str, float]], min_pairs: int = 20, min_points: int = 10) -> DataFrame:
    """Factor on the reported localization errors per axis: white noise makes consecutive steps
    anticorrelated. ``axes`` maps an axis to (position, sd, factor to µm)."""
    from moteflow.operators.filters import eligible_tracks, repair_precision
    r = eligible_tracks(rows, [p for p, _, _ in axes.values()], min_points)
    r = repair_precision(r.withColumns({f"_p{a}": F.col(p) * F.lit(u) for a, (p, _, u) in axes.items()})
                         .withColumns({f"_s{a}": F.col(s) * F.lit(u) for a, (_, s, u) in axes.items()}), [f"_s{a}" for a in axes])
    w = Window.partitionBy(*TRACK).orderBy("frame_number")
    near = F.col("frame_number") - F.lag("frame_number").over(w) == 1
    r = r.withColumns({f"_i{a}": F.when(near, F.col(f"_p{a}") - F.lag(f"_p{a}").over(w)) for a in axes})
    r = r.withColumns({f"_c{a}": F.median(f"_i{a}").over(Window.partitionBy(*TRACK)) for a in axes})
    prod = {a: (F.lag(f"_i{a}").over(w) - F.col(f"_c{a}")) * (F.col(f"_i{a}") - F.col(f"_c{a}")) for a in axes}
    r = r.withColumns({f"_q{a}": e for a, e in prod.items()})
    est = r.groupBy(*TRACK).agg(*[F.count(f"_q{a}").alias(f"n{a}") for a in axes],
                                *[(-F.avg(f"_q{a}") / F.avg(F.col(f"_s{a}") * F.col(f"_s{a}"))).alias(f"e{a}") for a in axes])
    long_ = est.select(F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"n{a}").alias("n"), F.col(f"e{a}").alias("est")) for a in axes])))
    mid = exact_quantiles(long_.where(F.col("n") >= min_pairs), ["axis"], "est", {"m": 0.5})
    names = long_.select("axis").distinct()
    return names.join(mid, "axis", "left").select(
        "axis", F.coalesce(F.sqrt(F.least(F.greatest(F.col("m"), F.lit(0.25)), F.lit(16.0))), F.lit(1.0)).alias("factor"))


def pair_profile(pairs: DataFrame, keys: list[str], max_r: float = 40.0, lo: float = 2.0, width: float = 0.5, peak_from: float = 6.0) -> DataFrame:
    """Pair density against distance (per annulus area, far tail = 1), its smoothed peak and half-width.
    Distances are counted per bin first; what remains is one short array per group."""
    n = math.ceil((max_r + width - lo) / width - 1e-9) - 1
    b = F.least(F.floor((F.col("distance") - lo) / width), F.lit(n - 1)).cast("int")
    c = pairs.where((F.col("distance") >= lo) & (F.col("distance") <= lo + n * width)).groupBy(*keys, b.alias("bin")).count()
    m = c.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("m"))
    idx = F.sequence(F.lit(0), F.lit(n - 1))
    r = lambda i: F.lit(lo + width / 2) + i * F.lit(width)
    g = F.transform(idx, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / (F.lit(2 * math.pi * width) * r(i)))
    far = [i for i in range(n) if lo + width / 2 + i * width > 0.8 * (lo + width / 2 + (n - 1) * width)]
    df = m.withColumn("g", g).withColumn("tail", sum((F.col("g")[i] for i in far), F.lit(0.0)) / len(far))
    df = df.withColumn("g", F.transform("g", lambda v: v / F.when(F.col("tail") > 0, F.col("tail")).otherwise(F.lit(1.0))))
    wts = gauss_weights(1.0, 4)
    mirror = lambda j: F.when(j < 0, -j - 1).when(j >= n, F.lit(2 * n - 1) - j).otherwise(j)
    smooth = F.transform(idx, lambda i: sum((F.get("g", mirror(i + (k - 4))) * F.lit(wts[k]) for k in range(9)), F.lit(0.0)))
    df = df.withColumn("s", smooth)
    first = next(i for i in range(n) if lo + width / 2 + i * width >= peak_from)
    top = F.array_max(F.transform(F.sequence(F.lit(first), F.lit(n - 1)), lambda i: F.struct(F.get("s", i).alias("v"), (-i).alias("i"))))
    df = df.withColumn("top", top).withColumn("pk", -F.col("top.i")).withColumn("half", F.lit(1.0) + (F.col("top.v") - 1) / 2)
    below = lambda i: F.get("s", i) <= F.col("half")
    left = F.coalesce(F.array_max(F.filter(idx, lambda i: (i < F.col("pk")) & below(i))), F.lit(0))
    right = F.coalesce(F.array_min(F.filter(idx, lambda i: (i > F.col("pk")) & below(i))), F.lit(n - 1))
    flat = F.col("top.v") <= F.col("half")
    return df.select(*keys, r(F.col("pk")).alias("peak_px"), F.col("top.v").alias("height"),
                     F.when(flat, F.lit(0.0)).otherwise((right - left) * F.lit(width)).alias("width_px"), F.col("g").alias("profile"))


def match_truth(truth: DataFrame, found: DataFrame, radius: float = 2.0) -> DataFrame:
    """Each labelled position with its nearest detection: hit when within ``radius``. truth and found carry
    movie, frame_number, x, y and an id (truth_id / found_id)."""
    t = truth.withColumnsRenamed({"x": "tx", "y": "ty"})
    f = found.select("movie", "frame_number", "found_id", F.col("x").alias("fx"), F.col("y").alias("fy"))
    d = F.sqrt((F.col("tx") - F.col("fx")) * (F.col("tx") - F.col("fx")) + (F.col("ty") - F.col("fy")) * (F.col("ty") - F.col("fy")))
    near = near_join(f, t.select("movie", "frame_number", "truth_id", "tx", "ty"), radius, ["movie", "frame_number"], ("fx", "fy"), ("tx", "ty"))
    best = near.withColumn("_d", d).groupBy("movie", "frame_number", "truth_id").agg(
        F.min_by(F.struct("found_id", "_d"), F.struct("_d", "found_id")).alias("b"))
    return t.join(best, ["movie", "frame_number", "truth_id"], "left").withColumns(
        {"hit": F.col("b").isNotNull(), "found_id": F.col("b.found_id"), "error_px": F.col("b._d")}).drop("b")


def banded_recall(matched: DataFrame, col: str, edges: list[float]) -> DataFrame:
    """Recall and matching error per band of ``col``, numbered by how many edges a value reaches: the first band
    is open below and the last above."""
    band = sum(F.when(F.col(col) >= a, 1).otherwise(0) for a in edges)
    return matched.withColumn("band", band).groupBy("band").agg(
        F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("recall"), F.avg("error_px").alias("mean_error"))


def displacement(rows: DataFrame, frame: Column, other: DataFrame | None = None) -> DataFrame:
    """Beads of the reference frame joined to their later positions by track (no pairs within a frame)."""
    cols = ["X", "Y", "Z", "vX", "vY", "vZ"]
    a = rows.where(frame).select(*TRACK, *[F.col(c).alias(c + "a") for c in cols])
    b = (other if other is not None else rows).select(*TRACK, "frame_number", *[F.col(c).alias(c + "b") for c in cols])
    j = b.join(a, TRACK)
    return j.select(*TRACK, "frame_number", *[F.col(c + "a").alias(c) for c in "XYZ"],
                    *[(F.col(c + "b") - F.col(c + "a")).alias("u" + c.lower()) for c in "XYZ"],
                    *[(F.col("v" + c + "a") + F.col("v" + c + "b")).alias("v" + c.lower()) for c in "XYZ"])


def busiest_frame(disp: DataFrame, reference: int, step: Column, min_beads: int = 8) -> DataFrame:
    """Frame with the largest 98th percentile of displacement per movie (the first of equal ones)."""
    mag = F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") + F.col("uz") * F.col("uz"))
    d = disp.where((F.col("frame_number") != reference) & ((F.col("frame_number") - 1) % step == 0) & F.col("uz").isNotNull())
    per = d.withColumn("_m", mag).groupBy("movie", "frame_number").agg(
        F.count("*").alias("n"), F.expr("percentile(_m, 0.98D)").alias("p98")).where(F.col("n") >= min_beads)
    return per.groupBy("movie").agg(F.max_by("frame_number", F.struct("p98", -F.col("frame_number"))).alias("frame"), F.max("p98").alias("p98"))
