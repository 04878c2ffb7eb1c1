"""Imaging queries."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from moteflow.catalog import views as V
from moteflow.catalog.registry import R, register, rounded
from moteflow.operators import imaging as I
from moteflow.settings import DEFAULTS
from moteflow.session import cut

_OFF = ", ".join(f"({k}, CAST({math.exp(-k * k / 2)!r} AS DOUBLE))" for k in range(-2, 3))


@register("frame_window_average", f"""WITH {V.PIXELS}, o AS (SELECT * FROM (VALUES {_OFF}) t(k, w)),
 s AS (SELECT p.movie, p.frame, p.y, p.x, sum(o.w * q.v) / sum(o.w) AS v FROM pixels p JOIN o ON true JOIN pixels q ON q.movie = p.movie AND q.frame = p.frame + o.k AND q.y = p.y AND q.x = p.x GROUP BY ALL)
 SELECT movie, frame, y, x, {R('v')} AS v FROM s""")
def frame_window_average(spark, sf):
    s = I.seed_average(V.frames(spark, sf)).select("movie", "frame", "height", "width", F.col("seed").alias("pixels"))
    return rounded(V.pixel_view(s).select("movie", "frame", "y", "x", "v"), "v")


@register("pixel_stats", f"WITH {V.PIXELS} SELECT movie, y, x, {R('avg(v)')} AS mean, {R('var_samp(v)')} AS variance, count(*) AS n FROM pixels GROUP BY ALL")
def pixel_stats(spark, sf):
    return rounded(I.pixel_stats(V.pixels(spark, sf), ["movie"]), "mean", "variance")


CAMERA = """st AS (SELECT plane, y, x, avg(v) AS mean, var_samp(v) AS var, count(*) AS n FROM (SELECT * REPLACE (CASE WHEN plane >= 2 THEN v * (1 + plane * 0.3e0) ELSE v END AS v) FROM pixels) GROUP BY ALL),
 dk AS (SELECT y, x, sum(mean*n)/sum(n) AS off, sum(var*(n-1))/greatest(sum(n) - count(*), 1) AS variance FROM st WHERE plane < 2 GROUP BY ALL),
 sl AS (SELECT y, x, sum((mean-off)*(var-variance))/greatest(sum((mean-off)*(mean-off)), 1e-9) AS slope, min(mean-off) AS low, count(*) AS lv FROM st JOIN dk USING (y, x) WHERE plane >= 2 GROUP BY ALL),
 g AS (SELECT median(slope) AS mid FROM sl WHERE low > 20)"""


def camera(spark, sf):
    """Planes 0 and 1 as dark stacks, the others as flat fields of rising brightness."""
    p = V.pixels(spark, sf).withColumn("v", F.when(F.col("plane") >= 2, F.col("v") * (F.col("plane") * F.lit(0.3) + 1)).otherwise(F.col("v")))
    st = I.pixel_stats(p, ["plane"])
    return I.camera_maps(st.where("plane < 2"), st.where("plane >= 2"), "plane", per_pixel=True)


@register("camera_maps", f"WITH {V.PIXELS}, {CAMERA} SELECT y, x, {R('off')} AS \"offset\", {R('variance')} AS variance, {R('CASE WHEN low > 20 AND lv >= 3 THEN slope ELSE mid END')} AS gain FROM dk JOIN sl USING (y, x), g")
def camera_maps(spark, sf):
    return rounded(camera(spark, sf), "offset", "variance", "gain")


@register("camera_summary", f"""WITH {V.PIXELS}, {CAMERA}, c AS (SELECT off, variance, sqrt(variance) AS sd, CASE WHEN low > 20 AND lv >= 3 THEN slope ELSE mid END AS gain FROM dk JOIN sl USING (y, x), g), m AS (SELECT median(sd) AS q, median(gain) AS gm FROM c)
 SELECT {R('median(off)')} AS offset_median, {R('stddev_pop(off)')} AS offset_sd, {R('min(q)')} AS read_noise_median, {R('min(gm)')} AS gain, {R('min(q)/min(gm)', 4)} AS read_noise_median_e, {R('sqrt(avg(variance))/min(gm)', 4)} AS read_noise_rms_e,
 {R('avg(CASE WHEN sd > 3*q THEN 1e0 ELSE 0e0 END)')} AS noisy_fraction FROM c, m""")
def camera_summary(spark, sf):
    s = I.camera_summary(cut(camera(spark, sf)))
    return rounded(s, "offset_median", "offset_sd", "read_noise_median", "gain", "noisy_fraction").withColumns({c: F.round(c, 4) for c in ("read_noise_median_e", "read_noise_rms_e")})


@register("binned_frames", f"WITH {V.PIXELS} SELECT movie, frame, CAST(y // 2 AS INTEGER) AS by, CAST(x // 2 AS INTEGER) AS bx, {R('avg(v)')} AS v FROM pixels GROUP BY ALL")
def binned_frames(spark, sf):
    return rounded(I.binned(V.pixels(spark, sf), 2), "v")


@register("frame_contrast", f"WITH {V.PIXELS} SELECT movie, frame, {R('quantile_cont(v, 0.01)')} AS p1, {R('quantile_cont(v, 0.998)')} AS p998 FROM pixels GROUP BY ALL")
def frame_contrast(spark, sf):
    return rounded(I.frame_contrast(V.frames(spark, sf), {"p1": 0.01, "p998": 0.998}), "p1", "p998")


@register("shifted_frames", f"""WITH {V.PIXELS}, s AS (SELECT movie, frame, v, x - ((frame % 5)/3e0 - 0.61e0) AS sx, y - ((frame % 7)/4e0 - 0.73e0) AS sy FROM pixels),
 t AS (SELECT movie, frame, v, floor(sx) + i AS tx, floor(sy) + j AS ty, (CASE WHEN i = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE WHEN j = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS w FROM s, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j))
 SELECT movie, frame, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, {R('sum(v*w)/sum(w)')} AS v FROM t WHERE w > 0 AND tx BETWEEN 0 AND 7 AND ty BETWEEN 0 AND 7 GROUP BY ALL""")
def shifted_frames(spark, sf):
    p = V.pixels(spark, sf)
    d = V.frames(spark, sf).select("movie", "frame", ((F.col("frame") % 5) / F.lit(3.0) - F.lit(0.61)).alias("dx"), ((F.col("frame") % 7) / F.lit(4.0) - F.lit(0.73)).alias("dy"))
    return rounded(I.shifted(p, d), "v")


@register("central_crop", f"WITH {V.PIXELS} SELECT movie, frame, count(*) AS n, {R('avg(v)')} AS mean, 4e0 AS count_scale FROM pixels WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 GROUP BY ALL")
def central_crop(spark, sf):
    c = I.central_crop(V.pixels(spark, sf), 4)
    return rounded(c.groupBy("movie", "frame").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.max("count_scale").alias("count_scale")), "mean", "count_scale")


@register("spaced_frames", f"""WITH l AS (SELECT 'e' || CAST(vec_id // 100 AS VARCHAR) AS movie, max(vec_id % 100 + 1) AS n FROM embeddings GROUP BY 1)
 SELECT DISTINCT movie, CAST((i * (n - 1)) // 11 + 1 AS INTEGER) AS frame FROM l, range(0, 12) t(i)""")
def spaced_frames(spark, sf):
    f = V.frames(spark, sf)
    return f.join(I.spaced_frames(f), ["movie", "frame"], "left_semi").select("movie", "frame")


def _clip(k: int) -> str:
    prev = "sd0" if k == 0 else f"n{k - 1}"
    return f"n{k} AS (SELECT d.movie, d.frame, sqrt(avg(d*d))/0.997e0 AS sd FROM d JOIN {prev} s USING (movie, frame) WHERE abs(d) < 3.5e0*sd GROUP BY ALL)"


@register("frame_noise", f"""WITH {V.PIXELS}, d AS (SELECT a.movie, a.frame, b.v - a.v AS d FROM pixels a JOIN pixels b ON a.movie = b.movie AND a.frame = b.frame AND a.x = b.x AND b.y = a.y + 2 WHERE a.y % 2 = 0 AND a.x % 2 = 0),
 sd0 AS (SELECT movie, frame, stddev_pop(d) AS sd FROM d GROUP BY ALL), {_clip(0)}, {_clip(1)}, {_clip(2)} SELECT movie, frame, {R('greatest(sd/sqrt(2e0), 1e-3)')} AS noise FROM n2""")
def frame_noise(spark, sf):
    return rounded(I.frame_noise(V.frames(spark, sf)), "noise")


@register("frame_robust_noise", f"""WITH {V.PIXELS}, m AS (SELECT movie, frame, median(v) AS mid FROM pixels GROUP BY ALL) SELECT p.movie, p.frame, {R('6e0*1.4826e0*median(abs(v - mid))')} AS strong, count(*) FILTER (v - mid > 0.55e0*40) AS bright_pixels FROM pixels p JOIN m USING (movie, frame) GROUP BY ALL""")
def frame_robust_noise(spark, sf):
    from moteflow.functions.arrays import array_median
    f = V.frames(spark, sf).withColumn("mid", array_median(F.col("pixels")))
    dev = F.transform("pixels", lambda v: F.abs(v - F.col("mid")))
    return rounded(f.select("movie", "frame", (array_median(dev) * 1.4826 * 6).alias("strong"),
                            F.size(F.filter("pixels", lambda v: v - F.col("mid") > 0.55 * 40)).cast("long").alias("bright_pixels")), "strong")


TEMPLATE = """px AS (SELECT vec_id, label AS plane, unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE)*50 + 100 AS v FROM embeddings),
 bd AS (SELECT vec_id, median(v) AS b FROM (SELECT vec_id, v FROM px WHERE i // 8 IN (0, 7) OR i % 8 IN (0, 7) UNION ALL SELECT vec_id, v FROM px WHERE i IN (0, 7, 56, 63)) GROUP BY vec_id),
 sm AS (SELECT vec_id, b, sum(v - b) AS s FROM px JOIN bd USING (vec_id) GROUP BY ALL),
 np AS (SELECT vec_id, plane, i, (v - b)/s AS v FROM px JOIN sm USING (vec_id)),
 tpl AS (SELECT plane, i, median(v) AS v, count(*) AS n FROM np GROUP BY ALL HAVING count(*) >= 3)"""


def patches(spark, sf):
    f = V.table(spark, sf, "embeddings")
    return f.select(F.col("vec_id").alias("row_id"), F.col("label").alias("plane"), F.transform("embedding", lambda v: v.cast("double") * 50 + 100).alias("patch"))


@register("median_template", f"WITH {TEMPLATE} SELECT plane, CAST(i AS INTEGER) AS i, {R('v', 8)} AS v, n FROM tpl")
def median_template(spark, sf):
    t = I.median_templates(I.normalized_patches(patches(spark, sf), 8))
    return t.select("plane", "n", F.posexplode("pixels").alias("i", "v")).withColumn("v", F.round("v", 8))


@register("patch_scores", f"""WITH {TEMPLATE}, c AS (SELECT p.vec_id, t.plane, count(*) AS n, sum(p.v) AS sa, sum(t.v) AS sb, sum(p.v*t.v) AS sab, sum(p.v*p.v) AS saa, sum(t.v*t.v) AS sbb FROM px p JOIN tpl t ON p.i = t.i AND abs(p.plane - t.plane) <= 1 GROUP BY ALL)
 SELECT vec_id AS row_id, {R('max((sab - sa*sb/n)/sqrt((saa - sa*sa/n)*(sbb - sb*sb/n)))', 5)} AS templateScore FROM c GROUP BY vec_id""")
def patch_scores(spark, sf):
    p = patches(spark, sf)
    t = I.median_templates(I.normalized_patches(p, 8)).withColumn("z", F.col("plane").cast("double"))
    s = I.template_scores(p.withColumn("z", F.col("plane").cast("double")), t)
    return s.select("row_id", F.round("templateScore", 5).alias("templateScore"))


@register("camera_windows", f"""WITH {V.LOC}, cam AS (SELECT event_id // 100 AS y, event_id % 100 AS x, 100 + (event_id * 7 % 13) / 3e0 AS o, 1 + (event_id * 11 % 17) / 5e0 AS v, 0.8e0 + (event_id * 3 % 5) / 10e0 AS g FROM events),
 w AS (SELECT movie, row_id, greatest(CAST(floor(xMean) AS BIGINT) - 9, 0) AS x0, greatest(CAST(floor(yMean) AS BIGINT) - 9, 0) AS y0, CAST(floor(xMean) AS BIGINT) + 9 AS x1, CAST(floor(yMean) AS BIGINT) + 9 AS y1 FROM loc),
 j AS (SELECT movie, row_id, (x1 - x0 + 1) * (y1 - y0 + 1) AS area, count(cam.x) AS n, sum(o) AS o, sum(v) AS v, sum(g) AS g, sum(o * (cam.x - 3 - x0 + 1) * (cam.y - 5 - y0 + 1)) AS m
   FROM w LEFT JOIN cam ON cam.x BETWEEN x0 + 3 AND x1 + 3 AND cam.y BETWEEN y0 + 5 AND y1 + 5 GROUP BY movie, row_id, x0, y0, x1, y1)
 SELECT movie, row_id, n = area AS on_sensor, {R("CASE WHEN n = area THEN o END", 4)} AS offsets, {R("CASE WHEN n = area THEN v END", 4)} AS variances, {R("CASE WHEN n = area THEN g END", 4)} AS gains, {R("CASE WHEN n = area THEN m END", 2)} AS placed FROM j""")
def camera_windows(spark, sf):
    """The camera maps under each bead's window on a sensor on which frames begin at (3, 5): their sums, and the offsets weighted by place."""
    e = F.col("event_id")
    cam = V.table(spark, sf, "events").select(F.expr("event_id div 100").alias("y"), (e % 100).alias("x"), (F.lit(100.0) + (e * 7 % 13) / F.lit(3.0)).alias("offset"),
                                              (F.lit(1.0) + (e * 11 % 17) / F.lit(5.0)).alias("variance"), (F.lit(0.8) + (e * 3 % 5) / F.lit(10.0)).alias("gain"))
    mid = {c: F.floor(F.col(f"{c}Mean")) for c in "xy"}
    w = cut(V.loc(spark, sf).select("movie", "row_id", *[F.greatest(mid[c] - 9, F.lit(0)).alias(c + "0") for c in "xy"], *[(mid[c] + 9).alias(c + "1") for c in "xy"]))
    total = lambda f: F.aggregate("camera", F.lit(0.0), lambda s, p: s + F.aggregate(f(p), F.lit(0.0), lambda t, v: t + v))
    weight = lambda p: F.transform(p["offset"], lambda v, i: v * (p["x"] - F.col("x0") + i % p["wide"] + 1) * (p["y"] - F.col("y0") + F.floor(i / p["wide"]) + 1))
    sums = I.camera_places(w, cam, (3, 5)).select(*I.CORNERS, *[F.round(total(lambda p, c=c: p[c]), 4).alias(c + "s") for c in ("offset", "variance", "gain")], F.round(total(weight), 2).alias("placed"))
    return w.join(sums, I.CORNERS, "left").select("movie", "row_id", F.col("offsets").isNotNull().alias("on_sensor"), "offsets", "variances", "gains", "placed")


@register("localized_beads")
def localized_beads(spark, sf):
    """Detection on drawn frames with a calibration curve."""
    return I.localize(V.bead_shots(spark, sf), DEFAULTS, V.bead_curve(spark)).drop("background")


@register("detection_preview")
def detection_preview(spark, sf):
    """Beads of each movie's first frame with a permissive threshold, for choosing one."""
    rows = I.localize(V.bead_shots(spark, sf, first=True), replace(DEFAULTS, min_snr=1.5), seeded=False, signals=False)
    return rows.select("movie", "frame_number", "x1", "y1", "x2", "y2", "angleDegrees", "lobeSeparationPixels", "minLobeSNR")


@register("injection_recall")
def injection_recall(spark, sf):
    """Detections on drawn frames scored against the drawn positions, by brightness."""
    from moteflow.operators import stats as S
    scale = (V.IMAGE - 40) / 262.0
    r = V.loc(spark, sf, per_movie=V.PER_IMAGE)
    truth = r.select("movie", "frame_number", F.col("row_id").alias("truth_id"), (F.col("xMean") * scale + 21).alias("x"), (F.col("yMean") * scale + 21).alias("y"),
                     (F.lit(60.0) + F.col("track_number") * 13 % 140).alias("amp"))
    rows = I.localize(V.bead_shots(spark, sf), DEFAULTS, V.bead_curve(spark), signals=False)
    found = rows.select("movie", "frame_number", F.col("row_id").alias("found_id"), F.col("xMean").alias("x"), F.col("yMean").alias("y"))
    return S.banded_recall(S.match_truth(truth, found), "amp", [0.0, 80.0, 120.0, 160.0, 220.0])
