"""Calibration queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from moteflow.catalog import views as V
from moteflow.catalog.pairs import SLOTS, residual_sql
from moteflow.catalog.registry import R, register, rounded
from moteflow.operators import calibrate as B, calibration as K
from moteflow.functions import field
from moteflow.plans.fit import fit_terms
from moteflow.session import cut
from moteflow.settings import DEFAULTS

CFG = replace(DEFAULTS, calibration_min_planes=20)


@register("calibration_curve")
def calibration_curve(spark, sf):
    """Depth curve of every scan (height up), one row per sample."""
    return B.calibrate(V.cal_rows(spark, sf), CFG, lateral=False)["curve"]


@register("calibration_holdout")
def calibration_holdout(spark, sf):
    return B.holdout(B.calibrate(V.cal_rows(spark, sf), CFG, lateral=False), CFG)


@register("lateral_model")
def lateral_model(spark, sf):
    """Lateral shift with depth of every scan, beads given by their tracks."""
    r = V.cal_rows(spark, sf).withColumn("z", F.col("frame_number") - F.lit(15.5))
    return B.lateral_model(cut(r), (896.0, 896.0)).select("movie", "coef_x", "coef_y")


_T = ["1e0", "u", "v"]


@register("field_map_sums", f"""WITH {V.LOC}, {SLOTS}, {residual_sql('loc', 'row_id', 'angleDegrees', 'lobeSeparationPixels')},
 f AS (SELECT movie, residual AS y, (xMean + 896 - 1024.5e0)/1024 AS u, (yMean + 896 - 1024.5e0)/1024 AS v FROM loc JOIN res USING (row_id)),
 s AS (SELECT movie, count(*) AS n, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, covar_pop(u, u) AS uu, covar_pop(u, v) AS uv, covar_pop(v, v) AS vv, covar_pop(u, y) AS uy, covar_pop(v, y) AS vy FROM f GROUP BY movie)
 SELECT movie, n AS fit_rows, {R('(uy*vv - vy*uv)/(uu*vv - uv*uv)', 5)} AS c1, {R('(vy*uu - uy*uv)/(uu*vv - uv*uv)', 5)} AS c2, {R('my - mu*(uy*vv - vy*uv)/(uu*vv - uv*uv) - mv*(vy*uu - uy*uv)/(uu*vv - uv*uv)', 5)} AS c0 FROM s""")
def field_map_sums(spark, sf):
    """Linear map of the separation residual over the field, from sums."""
    r = V.loc(spark, sf)
    u, v = field.field_uv(F.col("xMean"), F.col("yMean"), 896.0, 896.0)
    r = K.separation_residual(r, V.curve(spark), F.col("angleDegrees"), F.col("lobeSeparationPixels")).where("residual IS NOT NULL").withColumns({"u": u, "v": v})
    c = fit_terms(r, ["movie"], [F.lit(1.0), F.col("u"), F.col("v")], F.col("residual"))
    return c.select("movie", "fit_rows", *[F.round(F.col("coef")[i], 5).alias(f"c{i}") for i in range(3)])


@register("field_map")
def field_map(spark, sf):
    """Robust separation map of every movie with its order chosen by the number of beads."""
    m = B.field_map(V.loc(spark, sf), V.curve(spark), (896.0, 896.0), (256, 256), isolation=12.0, min_snr=5.0)
    return m.select("movie", "terms", *[F.round(F.col("coef")[i], 4).alias(f"c{i}") for i in range(6)])


@register("curve_crossings", f"""WITH {V.LOC}, {V.CURVE}, t AS (SELECT movie, median(angleDegrees) AS target FROM loc GROUP BY movie),
 s AS (SELECT * FROM (SELECT z AS z0, angle AS a0, lead(z) OVER (ORDER BY i) AS z1, lead(angle) OVER (ORDER BY i) AS a1 FROM curve) WHERE z1 IS NOT NULL),
 h AS (SELECT movie, z0 + (target - a0)/(a1 - a0)*(z1 - z0) AS z FROM t JOIN s ON (a0 - target)*(a1 - target) <= 0)
 SELECT movie, {R('arg_min(z, abs(z))')} AS z0 FROM h GROUP BY movie""")
def curve_crossings(spark, sf):
    """Depth nearest zero at which the curve shows each movie's median angle."""
    t = V.loc(spark, sf).groupBy("movie").agg(F.median("angleDegrees").alias("target"))
    seg = K.segments(V.curve(spark))
    lo, hi = F.least("angle0", "angle1"), F.greatest("angle0", "angle1")
    bins = K._lookup(seg, lo, hi, 1.0)
    j = t.withColumn("bin", F.floor("target").cast("long")).join(F.broadcast(bins), "bin")
    hit = F.filter("segs", lambda s: (s["angle0"] - F.col("target")) * (s["angle1"] - F.col("target")) <= 0)
    z = F.transform(hit, lambda s: s["z0"] + (F.col("target") - s["angle0"]) / (s["angle1"] - s["angle0"]) * (s["z1"] - s["z0"]))
    best = F.array_min(F.transform(z, lambda v: F.struct(F.abs(v).alias("d"), v.alias("z"))))["z"]
    return rounded(j.select("movie", best.alias("z0")), "z0")
