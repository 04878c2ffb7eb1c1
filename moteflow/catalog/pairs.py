"""Lobe pairs, depth lookup and field coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from moteflow.catalog import views as V
from moteflow.catalog.registry import R, register, rounded
from moteflow.functions import axial, field, pairs as P
from moteflow.operators import calibration as C
from moteflow.plans.spatial import close_pairs
from moteflow.settings import DEFAULTS, Settings

NOISE = 2.0


@register("lobe_geometry", f"""WITH {V.LOC} SELECT row_id, {R('degrees(atan2(CASE WHEN y2<y1 THEN y1-y2 ELSE y2-y1 END, CASE WHEN y2<y1 THEN x1-x2 ELSE x2-x1 END))')} AS angle,
 {R('sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))')} AS sep, (y2 < y1 OR (y2 = y1 AND x2 < x1)) AS swap,
 {R('sqrt(pi()*(amplitude1*amplitude1*sigma1*sigma1+amplitude2*amplitude2*sigma2*sigma2))/2')} AS pair_snr,
 CASE WHEN sharedLobe = 0 THEN {R('2*pi()*amplitude1*sigma1*sigma1')} END AS lobeSignal1, least(amplitude1, amplitude2) >= 4 * 25e0 AS usable FROM loc""")
def lobe_geometry(spark, sf):
    r = V.loc(spark, sf)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    out = r.select("row_id", P.pair_angle(dx, dy).alias("angle"), P.separation(dx, dy).alias("sep"), P.swapped(dx, dy).alias("swap"),
                   P.pair_snr(F.col("amplitude1"), F.col("sigma1"), F.col("amplitude2"), F.col("sigma2"), F.lit(NOISE)).alias("pair_snr"),
                   P.lobe_signal(F.col("amplitude1"), F.col("sigma1"), F.col("sharedLobe") == 1).alias("lobeSignal1"),
                   (F.least("amplitude1", "amplitude2") >= P.lobe_floor(F.lit(25.0))).alias("usable"))
    return rounded(out, "angle", "sep", "pair_snr", "lobeSignal1")


@register("axial_turns", f"""WITH {V.LOC} SELECT a.row_id, {R('((b.angleDegrees - a.angleDegrees + 90) % 180 + 180) % 180 - 90')} AS turn
 FROM loc a JOIN loc b ON a.movie = b.movie AND a.track_number = b.track_number AND b.frame_number = a.frame_number + 1""")
def axial_turns(spark, sf):
    r = V.loc(spark, sf).select("movie", "track_number", "frame_number", "row_id", "angleDegrees")
    nxt = r.select("movie", "track_number", (F.col("frame_number") - 1).alias("frame_number"), F.col("angleDegrees").alias("b"))
    out = r.join(nxt, ["movie", "track_number", "frame_number"])
    return out.select("row_id", F.round(axial.axial_difference(F.col("b"), F.col("angleDegrees")), 6).alias("turn"))


SEGMENTS = f"""{V.CURVE}, seg AS (SELECT * FROM (SELECT i, z AS z0, angle AS a0, sep AS s0, lead(z) OVER (ORDER BY i) AS z1,
  lead(angle) OVER (ORDER BY i) AS a1, lead(sep) OVER (ORDER BY i) AS s1 FROM curve) WHERE z1 IS NOT NULL)"""
SLOTS = f"""{SEGMENTS}, slots AS (SELECT slot, s0 + (slot * 0.05e0 - a0) / (a1 - a0) * (s1 - s0) AS cal_sep
  FROM seg JOIN range(0, 3600) t(slot) ON slot * 0.05e0 BETWEEN least(a0, a1) AND greatest(a0, a1))"""


def residual_sql(src: str, key: str, angle: str = "angle", sep: str = "sep") -> str:
    return f"""res AS (SELECT {key}, arg_min({sep} - cal_sep, abs({sep} - cal_sep)) AS residual
  FROM {src} JOIN slots ON slot = CAST(round_even({angle} / 0.05e0, 0) AS BIGINT) % 3600 GROUP BY {key})"""


@register("separation_residual", f"""WITH {V.LOC}, {SLOTS}, {residual_sql('loc', 'row_id', 'angleDegrees', 'lobeSeparationPixels')}
 SELECT row_id, {R('residual')} AS residual FROM loc LEFT JOIN res USING (row_id)""")
def separation_residual(spark, sf):
    r = V.loc(spark, sf).select("row_id", "angleDegrees", "lobeSeparationPixels")
    out = C.separation_residual(r, V.curve(spark), F.col("angleDegrees"), F.col("lobeSeparationPixels"))
    return rounded(out.select("row_id", "residual"), "residual")


@register("angle_to_z", f"""WITH {V.LOC}, {SEGMENTS},
roots AS (SELECT row_id, lobeSeparationPixels AS sep, round(z0 + (angleDegrees - a0) / (a1 - a0) * (z1 - z0), 6) AS k,
  min(z0 + (angleDegrees - a0) / (a1 - a0) * (z1 - z0)) AS z, min(s0 + (angleDegrees - a0) / (a1 - a0) * (s1 - s0)) AS s
  FROM loc JOIN seg ON angleDegrees BETWEEN least(a0, a1) AND greatest(a0, a1) GROUP BY ALL),
g AS (SELECT row_id, count(*) AS n, min(z) AS z1, list(abs(sep - s) ORDER BY abs(sep - s)) AS d, arg_min(z, abs(sep - s)) AS zb FROM roots GROUP BY row_id)
SELECT row_id, CAST(CASE WHEN n IS NULL THEN 1 WHEN n = 1 THEN 0 WHEN d[2] - d[1] >= 1.5 THEN 3 ELSE 2 END AS INTEGER) AS zStatus,
 CASE WHEN n = 1 THEN {R('z1')} WHEN d[2] - d[1] >= 1.5 THEN {R('zb')} END AS zMicrons FROM loc LEFT JOIN g USING (row_id)""")
def angle_to_z(spark, sf):
    r = V.loc(spark, sf).select("row_id", "angleDegrees", "lobeSeparationPixels")
    out = C.angle_to_z(r, V.curve(spark), F.col("lobeSeparationPixels"))
    return rounded(out.select("row_id", "zStatus", "zMicrons"), "zMicrons")


def maps(spark, sf):
    """A separation map for two movies of three, on a 300 px sensor on which frames begin at (20, 10)."""
    k = F.substring("movie", 2, 9).cast("int")
    m = V.loc(spark, sf).select("movie").distinct().where(k % 3 != 0)
    return C.FieldCurve(V.curve(spark), m.select("movie", F.array(*[((k * 7 + i * 5) % 11 - 5) / F.lit(2.0 + i) for i in range(6)]).alias("coef")), (20.0, 10.0), 300.0)


_MAP = " + ".join(f"((k * 7 + {i * 5}) % 11 - 5) / {2.0 + i}e0 * {t}" for i, t in enumerate(("1", "u", "v", "u*u", "u*v", "v*v")))
FIELD = f"""fl AS (SELECT *, CASE WHEN k % 3 <> 0 THEN {_MAP} ELSE 0 END AS off FROM (SELECT *, CAST(substr(movie, 2) AS INTEGER) AS k, (xMean + 20 - 150.5e0)/150 AS u, (yMean + 10 - 150.5e0)/150 AS v FROM loc)),
lf AS (SELECT * REPLACE (lobeSeparationPixels - off AS lobeSeparationPixels) FROM fl)"""


@register("field_separation_residual", f"""WITH {V.LOC}, {FIELD}, {SLOTS}, {residual_sql('lf', 'row_id', 'angleDegrees', 'lobeSeparationPixels')}
 SELECT row_id, {R('off')} AS fieldSeparationOffset, {R('residual')} AS residual FROM lf LEFT JOIN res USING (row_id)""")
def field_separation_residual(spark, sf):
    """Separations against the curve and each movie's map."""
    at, curve = (F.col("xMean"), F.col("yMean")), maps(spark, sf)
    r = C.with_field_offset(V.loc(spark, sf), curve, *at)
    out = C.separation_residual(r, curve, F.col("angleDegrees"), F.col("lobeSeparationPixels"), at=at)
    return rounded(out.select("row_id", "fieldSeparationOffset", "residual"), "fieldSeparationOffset", "residual")


@register("field_depths", f"""WITH {V.LOC}, {FIELD}, {SEGMENTS},
roots AS (SELECT row_id, lobeSeparationPixels AS sep, round(z0 + (angleDegrees - a0) / (a1 - a0) * (z1 - z0), 6) AS k,
  min(z0 + (angleDegrees - a0) / (a1 - a0) * (z1 - z0)) AS z, min(s0 + (angleDegrees - a0) / (a1 - a0) * (s1 - s0)) AS s
  FROM lf JOIN seg ON angleDegrees BETWEEN least(a0, a1) AND greatest(a0, a1) GROUP BY ALL),
g AS (SELECT row_id, count(*) AS n, min(z) AS z1, list(abs(sep - s) ORDER BY abs(sep - s)) AS d, arg_min(z, abs(sep - s)) AS zb FROM roots GROUP BY row_id)
SELECT row_id, {R('off')} AS fieldSeparationOffset, CAST(CASE WHEN n IS NULL THEN 1 WHEN n = 1 THEN 0 WHEN d[2] - d[1] >= 1.5 THEN 3 ELSE 2 END AS INTEGER) AS zStatus,
 CASE WHEN n = 1 THEN {R('z1')} WHEN d[2] - d[1] >= 1.5 THEN {R('zb')} END AS zMicrons FROM lf LEFT JOIN g USING (row_id)""")
def field_depths(spark, sf):
    """Depths told apart by field-corrected separations."""
    out = C.depths(V.loc(spark, sf), maps(spark, sf))
    return rounded(out.select("row_id", "fieldSeparationOffset", "zStatus", "zMicrons"), "fieldSeparationOffset", "zMicrons")


@register("z_precision", f"""WITH {V.LOC}, {V.CURVE},
rate AS (SELECT i, z, coalesce((lead(angle) OVER w - lag(angle) OVER w) / (lead(z) OVER w - lag(z) OVER w),
  (lead(angle) OVER w - angle) / (lead(z) OVER w - z), (angle - lag(angle) OVER w) / (z - lag(z) OVER w)) AS rate FROM curve WINDOW w AS (ORDER BY i)),
rs AS (SELECT * FROM (SELECT z AS z0, rate AS r0, lead(z) OVER (ORDER BY i) AS z1, lead(rate) OVER (ORDER BY i) AS r1 FROM rate) WHERE z1 IS NOT NULL),
p AS (SELECT row_id, zMicrons, anglePrecisionDeg, CASE WHEN zMicrons IS NOT NULL THEN least(greatest(zMicrons, -10e0), 20e0) END AS zc FROM loc),
q AS (SELECT row_id, anglePrecisionDeg / greatest(abs(min(r0 + (zc - z0) / (z1 - z0) * (r1 - r0))), 1e-6) AS sd
  FROM p JOIN rs ON zc BETWEEN z0 AND z1 GROUP BY row_id, anglePrecisionDeg),
m AS (SELECT median(sd) AS mid FROM q)
SELECT row_id, {R('coalesce(sd, mid)', 4)} AS z_sd FROM loc LEFT JOIN q USING (row_id), m""")
def z_precision(spark, sf):
    from moteflow.plans.quantile import exact_quantiles
    r = V.loc(spark, sf).select("row_id", "zMicrons", "anglePrecisionDeg")
    out = C.interpolate_rate(r, V.curve(spark)).withColumn(
        "sd", F.when(F.col("rate").isNotNull(), F.col("anglePrecisionDeg") / F.greatest(F.abs("rate"), F.lit(1e-6))))
    mid = exact_quantiles(out, [], "sd", {"mid": 0.5}).first()[0]
    return out.select("row_id", F.round(F.coalesce("sd", F.lit(mid)), 4).alias("z_sd"))


PAIR_BASE = f"""{V.LOBES}, lp AS (SELECT a.movie, a.frame_number, a.lobe_id AS lobe_a, b.lobe_id AS lobe_b, a.amp AS a1, b.amp AS a2,
  a.sigma AS s1, b.sigma AS s2, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) AS sep,
  degrees(atan2(CASE WHEN b.y<a.y THEN a.y-b.y ELSE b.y-a.y END, CASE WHEN b.y<a.y THEN a.x-b.x ELSE b.x-a.x END)) AS angle
  FROM lobes a JOIN lobes b ON a.movie = b.movie AND a.frame_number = b.frame_number AND a.lobe_id < b.lobe_id
  AND (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y) <= 729)"""


def cost_sql(precision: bool) -> str:
    shape = "pow(ln(greatest(a1,a2)/least(a1,a2))/0.5e0, 2) + pow((s1-s2)/0.6e0, 2)"
    sd = "sqrt(0.15e0*0.15e0 + pow(0.8e0*2/a1, 2) + pow(0.8e0*2/a2, 2))" if precision else "1e0"
    gate = f"least(3.5e0, greatest(1.2e0, 6*{sd}))" if precision else "3.5e0"
    return (f"CASE WHEN sep BETWEEN 9 AND 27 AND least(a1,a2) > 0 AND greatest(a1,a2)/least(a1,a2) <= 4 THEN "
            f"CASE WHEN residual IS NOT NULL THEN CASE WHEN abs(residual) <= {gate} THEN {shape} + pow(residual/({sd}), 2) END "
            f"ELSE {shape} + pow(greatest(15e0 - sep, 0e0, sep - 24e0), 2) END END")


def lobe_pairs(spark, sf, cfg: Settings = DEFAULTS):
    """Plausible lobe pairs of every frame with their cost."""
    ab = close_pairs(V.lobes(spark, sf), cfg.max_separation, ["movie", "frame_number"], "x", "y", "lobe_id")
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    ab = ab.select("movie", "frame_number", F.col("a.lobe_id").alias("lobe_a"), F.col("b.lobe_id").alias("lobe_b"),
                   F.col("a.amp").alias("a1"), F.col("b.amp").alias("a2"), F.col("a.sigma").alias("s1"), F.col("b.sigma").alias("s2"),
                   P.separation(dx, dy).alias("sep"), P.pair_angle(dx, dy).alias("angle"))
    ab = C.separation_residual(ab, V.curve(ab.sparkSession), F.col("angle"), F.col("sep"))
    cost = P.pair_cost(F.col("a1"), F.col("s1"), F.col("a2"), F.col("s2"), F.col("sep"), F.col("residual"), F.lit(NOISE), cfg)
    return ab.withColumn("cost", cost).where(F.col("cost") <= cfg.pair_gate_cost)


for _name, _mode in (("pair_cost", "fixed"), ("pair_cost_precision", "precision")):
    @register(_name, f"""WITH {V.LOC}, {PAIR_BASE}, {SLOTS}, {residual_sql('lp', 'lobe_a, lobe_b')},
c AS (SELECT movie, frame_number, lobe_a, lobe_b, sep, residual, {cost_sql(_mode == 'precision')} AS cost FROM lp LEFT JOIN res USING (lobe_a, lobe_b))
SELECT movie, frame_number, lobe_a, lobe_b, {R('sep')} AS sep, {R('residual')} AS residual, {R('cost')} AS cost FROM c WHERE cost <= 25""")
    def pair_cost(spark, sf, mode=_mode):
        out = lobe_pairs(spark, sf, Settings(sep_sd_mode=mode))
        return rounded(out.select("movie", "frame_number", "lobe_a", "lobe_b", "sep", "residual", "cost"), "sep", "residual", "cost")


@register("pair_precision", f"""WITH {V.LOC}, p AS (SELECT row_id, x2-x1 AS dx, y2-y1 AS dy, xPrecisionPx AS sx, yPrecisionPx AS sy, zPrecisionUm/100 AS c FROM loc)
SELECT row_id, {R('sqrt((sx*sx + 2*sx*sx + 2*c*c)/4)')} AS xPrecisionPx, {R('sqrt((sy*sy + 3*sy*sy + 2*c*c)/4)')} AS yPrecisionPx,
 {R('degrees(sqrt((dy*dy*(3*sx*sx-2*c*c) + dx*dx*(4*sy*sy-2*c*c) - 2*dx*dy*0)/pow(dx*dx+dy*dy, 2)))')} AS anglePrecisionDeg FROM p""")
def pair_precision(spark, sf):
    r = V.loc(spark, sf)
    sx, sy, c = F.col("xPrecisionPx"), F.col("yPrecisionPx"), F.col("zPrecisionUm") / 100
    z = F.lit(0.0)
    prec = P.pair_precision([sx * sx, z, z, sy * sy], [sx * sx * 2, z, z, sy * sy * 3], [c * c, z, z, c * c],
                            F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return rounded(r.select("row_id", *[e.alias(n) for n, e in prec.items()]), *prec)


# Example coefficients of the two field polynomials.
SEP_COEF = [0.1, 0.4, -0.3, 0.2, 1.5, -0.25]
LATERAL_COEF = [[-0.08, -0.3, 0.01, 0.002, -0.001, 0.0005], [0.07, 0.02, -0.3, -0.001, 0.0004, 0.002]]


@register("field_coordinates", f"""WITH {V.LOC}, p AS (SELECT row_id, xMean, yMean, lobeSeparationPixels, coalesce(zMicrons, 0) AS z,
  (xMean + 896 - 1024.5e0)/1024 AS u, (yMean + 896 - 1024.5e0)/1024 AS v FROM loc)
SELECT row_id, {R('u')} AS u, {R('v')} AS v, {R('0.1e0+0.4e0*u-0.3e0*v+0.2e0*u*u+1.5e0*u*v-0.25e0*v*v')} AS fieldSeparationOffset,
 {R('xMean - (-0.08e0*z-0.3e0*z*u+0.01e0*z*v+0.002e0*z*z-0.001e0*z*z*u+0.0005e0*z*z*v)')} AS xCorrected,
 {R('yMean - (0.07e0*z+0.02e0*z*u-0.3e0*z*v-0.001e0*z*z+0.0004e0*z*z*u+0.002e0*z*z*v)')} AS yCorrected FROM p""")
def field_coordinates(spark, sf):
    r = V.loc(spark, sf)
    off = (2048 - 256) / 2
    u, v = field.field_uv(F.col("xMean"), F.col("yMean"), off, off)
    r = r.withColumns({"u": u, "v": v})
    lat = field.lateral_terms(F.col("zMicrons"), F.col("u"), F.col("v"))
    out = r.select("row_id", "u", "v", field.combine(field.quadratic_terms(F.col("u"), F.col("v")), SEP_COEF).alias("fieldSeparationOffset"),
                   (F.col("xMean") - field.combine(lat, LATERAL_COEF[0])).alias("xCorrected"),
                   (F.col("yMean") - field.combine(lat, LATERAL_COEF[1])).alias("yCorrected"))
    return rounded(out, "u", "v", "fieldSeparationOffset", "xCorrected", "yCorrected")


@register("field_range", f"""WITH {V.LOC}, ext AS (SELECT movie, CAST(ceil(max(xMean)) AS BIGINT) AS w, CAST(ceil(max(yMean)) AS BIGINT) AS h FROM loc GROUP BY movie),
 lat AS (SELECT movie, (x + (2048 - w)/2e0 - 1024.5e0)/1024 AS u, (y + (2048 - h)/2e0 - 1024.5e0)/1024 AS v
  FROM (SELECT movie, w, h, unnest(range(1, w, 32)) AS x FROM ext) JOIN (SELECT movie, unnest(range(1, h, 32)) AS y FROM ext) USING (movie)),
 f AS (SELECT movie, 0.1e0+0.4e0*u-0.3e0*v+0.2e0*u*u+1.5e0*u*v-0.25e0*v*v AS s FROM lat)
SELECT movie, {R('min(s)')} AS lo, {R('max(s)')} AS hi FROM f GROUP BY movie""")
def field_range(spark, sf):
    """Smallest and largest separation offset a field map implies over each movie's image (32 px lattice)."""
    ext = V.loc(spark, sf).groupBy("movie").agg(F.ceil(F.max("xMean")).alias("w"), F.ceil(F.max("yMean")).alias("h"))
    lat = ext.withColumn("x", F.explode(F.sequence(F.lit(1).cast("long"), F.col("w") - 1, F.lit(32).cast("long")))) \
        .withColumn("y", F.explode(F.sequence(F.lit(1).cast("long"), F.col("h") - 1, F.lit(32).cast("long"))))
    u, v = field.field_uv(F.col("x"), F.col("y"), (F.lit(2048) - F.col("w")) / 2, (F.lit(2048) - F.col("h")) / 2)
    s = field.combine(field.quadratic_terms(u, v), SEP_COEF)
    return rounded(lat.withColumn("s", s).groupBy("movie").agg(F.min("s").alias("lo"), F.max("s").alias("hi")), "lo", "hi")


@register("sensor_offset", """SELECT p_partkey, CASE WHEN p_size * 40 = CAST(p_partkey % 50 AS INTEGER) * 40 THEN CAST(p_partkey % 7 AS DOUBLE)
 ELSE (2048 - p_size * 40) / 2e0 END AS offset_x FROM part""")
def sensor_offset(spark, sf):
    """Parts as a catalogue of images: size in px, recorded crop size and position."""
    p = V.table(spark, sf, "part")
    return p.select("p_partkey", field.sensor_offset(F.col("p_size") * 40, 2048.0, F.col("p_partkey") % 7,
                                                    (F.col("p_partkey") % 50) * 40).alias("offset_x"))
