"""Depth calibration: applying a curve (angle and lobe separation against z)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from moteflow.functions import field as L
from moteflow.functions.arrays import let

GRID_DEG = 0.05


@dataclass(frozen=True)
class FieldCurve:
    """A calibration curve with the maps(movie, coef) of ``calibrate.field_map`` for movies whose pixel (0, 0) is the sensor's pixel ``place``.
    It stands in for the curve wherever separations are judged: they are then judged against the curve's plus the map's at that place."""
    curve: DataFrame
    maps: DataFrame
    place: tuple[float, float] = (0.0, 0.0)
    sensor: float = 2048.0


def with_field_offset(rows: DataFrame, curve: DataFrame | FieldCurve, x: Column, y: Column, out: str = "fieldSeparationOffset") -> DataFrame:
    """``rows(movie, ...)`` with the map's separation at the one-based image pixel (x, y): 0 for movies without a map. One row per movie is joined."""
    if not isinstance(curve, FieldCurve):
        return rows.withColumn(out, F.lit(0.0))
    maps = curve.maps.select("movie", F.col("coef").alias("_coef"))
    return rows.join(maps, "movie", "left").withColumn(out, L.separation_offset(x, y, F.col("_coef"), *curve.place, curve.sensor)).drop("_coef")


def segments(curve: DataFrame, *extra: str, key: str | None = None) -> DataFrame:
    """Consecutive knots of a curve table (i, z, angle, sep) as segments; with ``key`` of one curve each."""
    w = Window.partitionBy(F.col(key) if key else F.lit(0)).orderBy("i")  # a curve is at most a few 10^4 knots
    cols = ["z", "angle", "sep", *extra]
    return curve.select(*([key] if key else []), "i", *[F.col(c).alias(c + "0") for c in cols], *[F.lead(c).over(w).alias(c + "1") for c in cols]) \
        .where(F.col("z1").isNotNull())


def _wrapped(seg: DataFrame) -> DataFrame:
    """Angle segments moved by multiples of 180 into the copies that meet [0, 180)."""
    lo, hi = F.least("angle0", "angle1"), F.greatest("angle0", "angle1")
    k = F.sequence(F.ceil((lo - 180) / 180), F.floor(hi / 180))
    return seg.withColumn("_k", F.explode(k)).withColumns(
        {"angle0": F.col("angle0") - F.col("_k") * 180, "angle1": F.col("angle1") - F.col("_k") * 180}).drop("_k")


def _lookup(seg: DataFrame, lo: Column, hi: Column, width: float, key: str | None = None) -> DataFrame:
    """(bin, segs): segments listed under every bin of ``width`` they touch, so that a range join on the
    curve becomes a broadcast equi-join with one match per row."""
    eps = 1e-9
    bins = F.sequence(F.floor((lo - eps) / width).cast("long"), F.floor((hi + eps) / width).cast("long"))
    fields = [c for c in seg.columns if c not in ("i", key)]
    return seg.withColumn("bin", F.explode(bins)).groupBy(*([key] if key else []), "bin").agg(F.collect_list(F.struct(*fields)).alias("segs"))


def angle_lookup(curve: DataFrame, width: float = 1.0, key: str | None = None) -> DataFrame:
    seg = _wrapped(segments(curve, key=key))
    return _lookup(seg, F.least("angle0", "angle1"), F.greatest("angle0", "angle1"), width, key)


def roots(angle: Column, segs: str = "segs") -> Column:
    """Sorted distinct depths where the curve has this angle, as structs (key, z, sep)."""
    def root(s: Column) -> Column:
        flat = F.abs(s["angle1"] - s["angle0"]) < 1e-10
        t = F.when(flat, F.lit(0.0)).otherwise((angle - s["angle0"]) / (s["angle1"] - s["angle0"]))
        z = s["z0"] + t * (s["z1"] - s["z0"])
        return F.struct(F.round(z, 6).alias("key"), z.alias("z"), (s["sep0"] + t * (s["sep1"] - s["sep0"])).alias("sep"))
    hits = F.filter(segs, lambda s: angle.between(F.least(s["angle0"], s["angle1"]), F.greatest(s["angle0"], s["angle1"])))
    return F.array_sort(F.transform(hits, root))


def angle_to_z(rows: DataFrame, curve: DataFrame, sep: Column | None, limits: tuple[float, float] | None = None,
               margin: float = 1.5, z: str = "zMicrons", status: str = "zStatus", angle: str = "angleDegrees", key: str | None = None) -> DataFrame:
    """Depth per angle. Status 0 unique, 1 outside the curve, 2 ambiguous, 3 told apart by the lobe
    separation (the best depth must win by ``margin`` px). z is NULL for 1 and 2. With a single curve there is no
    shuffle: its lookup is broadcast (bounded by the curve) and the roots stay an array inside the row.
    ``key`` names the column that picks each row's own curve."""
    out = rows.withColumn("_bin", F.floor(F.col(angle) / 1.0).cast("long"))
    look = angle_lookup(curve, key=key).withColumnRenamed("bin", "_bin")
    out = out.join(look, [key, "_bin"], "left") if key else out.join(F.broadcast(look), "_bin", "left")
    r = F.coalesce(roots(F.col(angle)), F.array().cast("array<struct<key:double,z:double,sep:double>>"))
    r = let(r, lambda a: F.filter(a, lambda x, i: (i == 0) | (x["key"] != F.get(a, i - 1)["key"])))
    if limits is not None:
        kept = r
        r = F.filter(kept, lambda x: x["z"].between(*limits))
    out = out.withColumn("_r", r)
    n = F.size("_r")
    if sep is None:
        out = out.withColumn("_best", F.lit(None).cast("array<struct<res:double,z:double>>"))
    else:
        out = out.withColumn("_sep", sep).withColumn("_best", F.array_sort(F.transform(
            "_r", lambda x: F.struct(F.abs(F.col("_sep") - x["sep"]).alias("res"), x["z"].alias("z"))))).drop("_sep")
    clear = (n > 1) & (F.col("_best")[1]["res"] - F.col("_best")[0]["res"] >= margin)
    zc = F.when(n == 1, F.col("_r")[0]["z"]).when(clear, F.col("_best")[0]["z"])
    st = F.when(n == 0, 1).when(n == 1, 0).when(F.coalesce(clear, F.lit(False)), 3).otherwise(2)
    return out.withColumns({z: zc, status: st}).drop("_bin", "segs", "_r", "_best")


def separation_lookup(curve: DataFrame, grid: float = GRID_DEG) -> DataFrame:
    """(slot, seps): calibrated separations at each angle of a fine grid over [0, 180)."""
    seg = _wrapped(segments(curve))
    lo, hi = F.least("angle0", "angle1"), F.greatest("angle0", "angle1")
    n = int(round(180 / grid))
    at = seg.withColumn("slot", F.explode(F.sequence(F.floor(lo / grid).cast("int"), F.ceil(hi / grid).cast("int")))) \
        .withColumn("_a", F.col("slot") * F.lit(grid)) \
        .where(F.col("slot").between(0, n - 1) & F.col("_a").between(lo, hi))
    t = F.when(F.abs(F.col("angle1") - F.col("angle0")) < 1e-10, F.lit(0.0)).otherwise(
        (F.col("_a") - F.col("angle0")) / (F.col("angle1") - F.col("angle0")))
    return at.groupBy("slot").agg(F.collect_set(F.col("sep0") + t * (F.col("sep1") - F.col("sep0"))).alias("seps"))


def separation_residual(rows: DataFrame, curve: DataFrame | FieldCurve, angle: Column, sep: Column, out: str = "residual", at: tuple[Column, Column] | None = None) -> DataFrame:
    """Observed minus calibrated separation at the best depth for the angle; NULL where the curve never
    shows that angle. Broadcast equi-join on the angle grid (3600 slots). With a ``FieldCurve`` the map's separation at
    ``at``, the one-based image pixel, is taken off first."""
    n = int(round(180 / GRID_DEG))
    df = rows.withColumns({"_slot": (F.rint(angle / GRID_DEG) % n).cast("int"), "_sep": sep})
    if isinstance(curve, FieldCurve):
        df = with_field_offset(df, curve, *at, "_off").withColumn("_sep", F.col("_sep") - F.col("_off")).drop("_off")
        curve = curve.curve
    look = F.broadcast(separation_lookup(curve).withColumnsRenamed({"slot": "_slot"}))
    best = F.array_min(F.transform("seps", lambda s: F.struct(F.abs(F.col("_sep") - s).alias("d"), (F.col("_sep") - s).alias("r"))))
    return df.join(look, "_slot", "left").withColumn(out, best["r"]).drop("_slot", "_sep", "seps")


def depths(rows: DataFrame, curve: DataFrame | FieldCurve, limits: tuple[float, float] | None = None, **names: str) -> DataFrame:
    """``angle_to_z`` of localizations by their field-corrected separations, with ``fieldSeparationOffset``."""
    rows = with_field_offset(rows, curve, F.col("xMean"), F.col("yMean"))
    plain = curve.curve if isinstance(curve, FieldCurve) else curve
    return angle_to_z(rows, plain, F.col("lobeSeparationPixels") - F.col("fieldSeparationOffset"), limits, **names)


def with_rate(curve: DataFrame) -> DataFrame:
    """Rotation rate d(angle)/dz at the knots: central differences, one-sided at the ends."""
    w = Window.partitionBy(F.lit(0)).orderBy("i")
    zl, zr, al, ar = F.lag("z").over(w), F.lead("z").over(w), F.lag("angle").over(w), F.lead("angle").over(w)
    a, z = F.col("angle"), F.col("z")
    hl, hr = z - zl, zr - z
    mid = (hl * hl * ar + (hr * hr - hl * hl) * a - hr * hr * al) / (hl * hr * (hl + hr))
    return curve.withColumn("rate", F.coalesce(mid, (ar - a) / hr, (a - al) / hl))


def interpolate_rate(rows: DataFrame, curve: DataFrame, z: str = "zMicrons", out: str = "rate", width: float = 1.0) -> DataFrame:
    """Rate at each row's depth, held beyond the ends of the curve."""
    c = with_rate(curve)
    ends = c.agg(F.min("z").alias("zlo"), F.max("z").alias("zhi")).first()
    seg = segments(c, "rate").select("i", "z0", "z1", "rate0", "rate1")
    look = F.broadcast(_lookup(seg, F.col("z0"), F.col("z1"), width).withColumnRenamed("bin", "_bin"))
    zc = F.when(F.col(z).isNotNull(), F.least(F.greatest(F.col(z), F.lit(ends.zlo)), F.lit(ends.zhi)))
    df = rows.withColumn("_z", zc).withColumn("_bin", F.floor(F.col("_z") / width).cast("long")).join(look, "_bin", "left")
    s = F.filter("segs", lambda s: F.col("_z").between(s["z0"], s["z1"]))[0]
    return df.withColumn(out, s["rate0"] + (F.col("_z") - s["z0"]) / (s["z1"] - s["z0"]) * (s["rate1"] - s["rate0"])) \
        .drop("_bin", "_z", "segs")


def depth_precision(rows: DataFrame, curve: DataFrame, out: str = "zPrecisionUm") -> DataFrame:
    """Standard deviation of the depth: that of the angle over the rotation rate at the row's depth; where it is unknown, the movie's median, and 1 in a movie without any."""
    rated = interpolate_rate(rows, curve, out="_rate").withColumn(out, F.col("anglePrecisionDeg") / F.greatest(F.abs("_rate"), F.lit(1e-6))).drop("_rate")
    middle = rated.groupBy("movie").agg(F.median(out).alias("_mid"))
    return rated.join(middle, "movie", "left").withColumn(out, F.coalesce(out, "_mid", F.lit(1.0))).drop("_mid")


def flip_z(df: DataFrame, columns: list[str], convention: str | None) -> DataFrame:
    """Stack-order z to height (up positive); tables already marked 'up' are returned unchanged."""
    if convention == "up":
        return df
    return df.withColumns({c: -F.col(c) for c in columns if c in df.columns})


def flip_calibration(cal: dict) -> dict:
    """Same for the small calibration record: limits swap, odd powers of z and the slide tilt change sign."""
    if cal.get("z_convention") == "up":
        return cal
    out = dict(cal, z_convention="up")
    if "z_limits" in cal:
        out["z_limits"] = (-cal["z_limits"][1], -cal["z_limits"][0])
    if "lateral" in cal:  # terms z, zu, zv are odd; z², z²u, z²v even
        out["lateral"] = [[-c if i < 3 else c for i, c in enumerate(row)] for row in cal["lateral"]]
    if "tilt" in cal:
        out["tilt"] = [-v for v in cal["tilt"]]
    return out


def flip_curve(curve: DataFrame) -> DataFrame:
    """The curve read in height: z negated, knots renumbered so that z ascends."""
    last = curve.agg(F.max("i")).first()[0]
    return curve.withColumns({"z": -F.col("z"), "i": F.lit(last) - F.col("i")})


def angle_crossing(curve: DataFrame, target: float) -> float | None:
    """Depth nearest zero where the unwrapped angle equals ``target`` modulo 180."""
    seg = segments(curve)
    lo, hi = F.least("angle0", "angle1"), F.greatest("angle0", "angle1")
    k = F.sequence(F.ceil((lo - target) / 180 - 1e-12), F.floor((hi - target) / 180 + 1e-12))
    some = F.ceil((lo - target) / 180 - 1e-12) <= F.floor((hi - target) / 180 + 1e-12)
    at = seg.where(some).withColumn("_k", F.explode(k)).withColumn("_t", F.lit(float(target)) + F.col("_k") * 180)
    z = F.when(F.col("angle1") == F.col("angle0"), F.col("z0")).otherwise(
        F.col("z0") + (F.col("_t") - F.col("angle0")) / (F.col("angle1") - F.col("angle0")) * (F.col("z1") - F.col("z0")))
    return at.select(z.alias("z")).agg(F.min_by("z", F.abs("z"))).first()[0]


def gamma_survival(mean: float, shape: float, frames: int, per_frame: int = 24) -> list[float]:
    """P(lifetime > n) for n = 0..frames of a gamma lifetime, summed on a fine grid."""
    rate = shape / mean
    dx = (frames + 1) / ((frames + 1) * per_frame)
    out, cdf = [1.0], 0.0
    for j in range(1, frames * per_frame + 1):
        x = j * dx
        cdf += math.exp(shape * math.log(rate) + (shape - 1) * math.log(x) - rate * x - math.lgamma(shape)) * dx
        if j % per_frame == 0:
            out.append(min(max(1 - cdf, 1e-12), 1.0))
    return out
