"""Aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from moteflow.catalog import views as V
from moteflow.catalog.registry import R, register, rounded
from moteflow.operators import quality as Q, stats as S
from moteflow.plans.fit import clipped_fit
from moteflow.plans.quantile import exact_quantiles, group_robust_sd
from moteflow.plans.series import gauss_weights
from moteflow.plans.spatial import close_pairs, nearest_k

PX = 0.325
AX = "((({a}) - ({b}) + 90) % 180 + 180) % 180 - 90"


def ax(a: str, b: str) -> str:
    return "(" + AX.format(a=a, b=b) + ")"


@register("frame_counts", f"""WITH {V.LOC}, c AS (SELECT movie, frame_number, count(*) AS n FROM loc GROUP BY ALL)
 SELECT movie, min(n) AS min_rows, median(n) AS median_rows, max(n) AS max_rows, count(*) AS frames_with_rows FROM c GROUP BY movie""")
def frame_counts(spark, sf):
    return Q.frame_counts(V.loc(spark, sf))


@register("status_counts", f"""WITH {V.LOC} SELECT movie, zStatus, count(*) AS n, count(*) FILTER (recovered = 1) AS recovered,
 CAST(sum(sharedLobe) AS BIGINT) AS shared, count(DISTINCT track_number) AS tracks FROM loc GROUP BY ALL""")
def status_counts(spark, sf):
    return V.loc(spark, sf).groupBy("movie", "zStatus").agg(
        F.count("*").alias("n"), F.count_if(F.col("recovered") == 1).alias("recovered"), F.sum("sharedLobe").alias("shared"),
        F.count_distinct("track_number").alias("tracks"))


@register("movie_audit", f"""WITH {V.LOC}, r AS (SELECT *, frame_number - lag(frame_number) OVER w AS df, sqrt(pow(xMean - lag(xMean) OVER w, 2) + pow(yMean - lag(yMean) OVER w, 2)) AS step
  FROM loc WINDOW w AS (PARTITION BY movie, track_number ORDER BY frame_number)),
m AS (SELECT movie, count(*) AS n_rows, max(frame_number) AS frames, count(*) FILTER (df > 1) AS gap_links, coalesce(max(CASE WHEN df > 1 THEN df END), 0) AS max_gap, max(step) AS max_step,
  median(step) AS median_step, median(minLobeSNR) AS median_snr, count(*) FILTER (recovered = 1) AS recovered_rows, CAST(sum(sharedLobe) AS BIGINT) AS shared_rows,
  count(*) FILTER (templateScore < 0.5) AS template_below_half, median(templateScore) FILTER (recovered <> 1) AS template_detected, median(templateScore) FILTER (recovered = 1) AS template_recovered,
  count(*) FILTER (df <= 0) AS bad_order FROM r GROUP BY movie),
l AS (SELECT movie, track_number, count(*) AS n, max(frame_number) - min(frame_number) + 1 AS span FROM loc GROUP BY ALL),
d AS (SELECT movie, count(*) AS tracks, count(*) FILTER (n = frames) AS full_length_tracks, count(*) FILTER (n >= 10) AS tracks_ge_10,
  CAST(sum(n) FILTER (n >= 10) AS DOUBLE) / sum(span) FILTER (n >= 10) AS within_span, CAST(sum(n) FILTER (n >= 10) AS DOUBLE) / (max(frames) * count(*) FILTER (n >= 10)) AS whole_movie
  FROM l JOIN m USING (movie) GROUP BY movie)
SELECT movie, n_rows, frames, gap_links, max_gap, {R('max_step')} AS max_step, {R('median_step')} AS median_step, {R('median_snr')} AS median_snr, recovered_rows, shared_rows,
 template_below_half, {R('template_detected')} AS template_detected, {R('template_recovered')} AS template_recovered, bad_order, tracks, full_length_tracks, tracks_ge_10,
 {R('within_span')} AS within_span, {R('whole_movie')} AS whole_movie FROM m JOIN d USING (movie)""")
def movie_audit(spark, sf):
    out = Q.audit(V.loc(spark, sf)).drop("bad_x", "bad_y", "bad_angle", "bad_range", "z_status_0", "z_status_1", "z_status_2", "z_status_3")
    return rounded(out, "max_step", "median_step", "median_snr", "template_detected", "template_recovered", "within_span", "whole_movie")


@register("robust_noise", f"""WITH {V.LOC}, s AS (SELECT movie, zMicrons - lag(zMicrons) OVER (PARTITION BY movie, track_number ORDER BY frame_number) AS d,
  frame_number - lag(frame_number) OVER (PARTITION BY movie, track_number ORDER BY frame_number) AS df FROM loc),
 c AS (SELECT movie, median(d) AS mid FROM s WHERE df = 1 AND d IS NOT NULL GROUP BY movie)
 SELECT movie, {R('mid')} AS mid, {R('1.4826e0 * median(abs(d - mid)) / sqrt(2e0)')} AS jitter FROM s JOIN c USING (movie) WHERE df = 1 AND d IS NOT NULL GROUP BY movie, mid""")
def robust_noise(spark, sf):
    """Depth noise of one localization per movie, from frame-to-frame steps within tracks."""
    w = Window.partitionBy("movie", "track_number").orderBy("frame_number")
    s = V.loc(spark, sf).select("movie", (F.col("zMicrons") - F.lag("zMicrons").over(w)).alias("d"),
                                (F.col("frame_number") - F.lag("frame_number").over(w)).alias("df"))
    g = group_robust_sd(s.where("df = 1 AND d IS NOT NULL"), ["movie"], "d", "sd")
    return rounded(g.select("movie", F.col("sd_centre").alias("mid"), (F.col("sd") / F.sqrt(F.lit(2.0))).alias("jitter")), "mid", "jitter")


@register("depth_percentiles", f"""WITH {V.LOC} SELECT movie, {R('quantile_cont(zMicrons, 0.01)')} AS p1, {R('median(zMicrons)')} AS p50, {R('quantile_cont(zMicrons, 0.99)')} AS p99 FROM loc GROUP BY movie""")
def depth_percentiles(spark, sf):
    return rounded(exact_quantiles(V.loc(spark, sf), ["movie"], "zMicrons", {"p1": 0.01, "p50": 0.5, "p99": 0.99}), "p1", "p50", "p99")


def consensus_sql(src: str, name: str = "planes") -> str:
    return f"""k1 AS (SELECT *, count(*) OVER w AS n_all, degrees(atan2(avg(sin(radians(angleDegrees*2))) OVER w, avg(cos(radians(angleDegrees*2))) OVER w))/2 AS ref FROM {src} WINDOW w AS (PARTITION BY movie, frame_number)),
k2 AS (SELECT *, ref + median({ax('angleDegrees', 'ref')}) OVER (PARTITION BY movie, frame_number) AS med FROM k1),
k3 AS (SELECT *, CASE WHEN abs({ax('angleDegrees', 'med')}) <= 8 THEN {ax('angleDegrees', 'med')} END AS d FROM k2),
k4 AS (SELECT *, ((med + median(d) OVER (PARTITION BY movie, frame_number)) % 180 + 180) % 180 AS ang FROM k3),
{name} AS (SELECT movie, frame_number, CASE WHEN min(n_all) >= 5 THEN count(d) ELSE min(n_all) END AS support, CASE WHEN min(n_all) >= 5 AND count(d) >= 5 THEN min(ang) END AS angle,
  CASE WHEN min(n_all) >= 5 AND count(d) >= 5 THEN median(lobeSeparationPixels) FILTER (d IS NOT NULL) END AS separation,
  CASE WHEN min(n_all) >= 5 AND count(d) >= 5 THEN 1.4826e0 * median(abs({ax('angleDegrees', 'ang')})) FILTER (d IS NOT NULL) END AS scatter FROM k4 GROUP BY movie, frame_number)"""


@register("axial_consensus", f"""WITH {V.LOC}, {V.CAL}, {consensus_sql('cal')} SELECT movie, frame_number, support, {R('angle', 5)} AS angle, {R('separation', 5)} AS separation, {R('scatter', 5)} AS scatter FROM planes""")
def axial_consensus(spark, sf):
    out = S.plane_consensus(V.cal_rows(spark, sf))
    return out.withColumns({c: F.round(c, 5) for c in ("angle", "separation", "scatter")})


@register("bead_residuals", f"""WITH {V.LOC}, {V.CAL}, {consensus_sql('cal')} SELECT c.movie, track_number, {R('median(abs(' + ax('angleDegrees', 'angle') + '))', 5)} AS residual
 FROM cal c JOIN planes USING (movie, frame_number) GROUP BY c.movie, track_number""")
def bead_residuals(spark, sf):
    rows = V.cal_rows(spark, sf)
    return S.bead_residuals(rows, S.plane_consensus(rows)).withColumn("residual", F.round("residual", 5))


@register("plane_runs", f"""WITH {V.LOC}, {V.CAL}, {consensus_sql('cal')}, ok AS (SELECT *, frame_number - row_number() OVER (PARTITION BY movie ORDER BY frame_number) AS isl FROM planes WHERE angle IS NOT NULL AND separation IS NOT NULL),
 rl AS (SELECT movie, isl, count(*) AS n, min(frame_number) AS f0 FROM ok GROUP BY ALL), b AS (SELECT movie, arg_max(isl, n * 100000 - f0) AS isl FROM rl GROUP BY movie),
 run AS (SELECT movie, frame_number, angle FROM ok JOIN b USING (movie, isl)),
 st AS (SELECT *, coalesce({ax('angle', 'lag(angle) OVER (PARTITION BY movie ORDER BY frame_number)')}, 0) AS step, first_value(angle) OVER (PARTITION BY movie ORDER BY frame_number) AS a0 FROM run)
 SELECT movie, frame_number, {R('a0 + sum(step) OVER (PARTITION BY movie ORDER BY frame_number)', 5)} AS unwrapped FROM st""")
def plane_runs(spark, sf):
    run = S.longest_run(S.plane_consensus(V.cal_rows(spark, sf)))
    return S.unwrap(run, "movie", "frame_number", "angle").select("movie", "frame_number", F.round("unwrapped", 5).alias("unwrapped"))


def _scale_axis(axis: str, pos: str, sd: str, u: float) -> str:
    return f"""e{axis}0 AS (SELECT movie, track_number, frame_number, {pos} * {u}e0 AS p,
  coalesce(CASE WHEN {sd} * {u}e0 > 0 THEN {sd} * {u}e0 END, median(CASE WHEN {sd} > 0 THEN {sd} * {u}e0 END) OVER (PARTITION BY movie, track_number), 0.1e0) AS s FROM elig),
e{axis}1 AS (SELECT *, CASE WHEN frame_number - lag(frame_number) OVER w = 1 THEN p - lag(p) OVER w END AS i FROM e{axis}0 WINDOW w AS (PARTITION BY movie, track_number ORDER BY frame_number)),
e{axis}2 AS (SELECT *, median(i) OVER (PARTITION BY movie, track_number) AS c FROM e{axis}1),
e{axis}3 AS (SELECT *, (lag(i) OVER (PARTITION BY movie, track_number ORDER BY frame_number) - c) * (i - c) AS q FROM e{axis}2),
e{axis}4 AS (SELECT -avg(q) / avg(s * s) AS est FROM e{axis}3 GROUP BY movie, track_number HAVING count(q) >= 15)"""


SCALE_AXES = {"x": ("xMean", "xPrecisionPx", PX), "y": ("yMean", "yPrecisionPx", PX), "z": ("zMicrons", "zPrecisionUm", 1.0)}


@register("error_scale", f"""WITH {V.LOC}, elig AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY movie, track_number) AS n FROM loc WHERE zMicrons IS NOT NULL) WHERE n >= 10),
{', '.join(_scale_axis(a, *v) for a, v in SCALE_AXES.items())} """ + " UNION ALL ".join(
    f"SELECT '{a}' AS axis, {R('coalesce(sqrt(least(greatest(median(est), 0.25e0), 16e0)), 1e0)')} AS factor FROM e{a}4" for a in SCALE_AXES))
def error_scale(spark, sf):
    return rounded(S.error_scale(V.loc(spark, sf), SCALE_AXES, min_pairs=15), "factor")


_N = 76
_W = gauss_weights(1.0, 4)


@register("pair_distance_profile", f"""WITH {V.LOC}, p AS (SELECT a.movie, sqrt(pow(a.xMean-b.xMean, 2) + pow(a.yMean-b.yMean, 2)) AS d FROM loc a JOIN loc b ON a.movie = b.movie AND a.frame_number = b.frame_number AND a.row_id < b.row_id
  AND greatest(a.amplitude1, b.amplitude1) <= 2 * least(a.amplitude1, b.amplitude1)),
c AS (SELECT movie, CAST(least(floor((d - 2) / 0.5e0), {_N - 1}) AS INTEGER) AS i, count(*) AS n FROM p WHERE d >= 2 AND d <= {2 + _N * 0.5} AND d <= 40 GROUP BY ALL),
grid AS (SELECT movie, CAST(i AS INTEGER) AS i FROM (SELECT DISTINCT movie FROM c), range(0, {_N}) t(i)),
g0 AS (SELECT movie, i, 2.25e0 + i * 0.5e0 AS r, coalesce(n, 0) / (2 * pi() * 0.5e0 * (2.25e0 + i * 0.5e0)) AS g FROM grid LEFT JOIN c USING (movie, i)),
t AS (SELECT movie, avg(g) AS tail FROM g0 WHERE r > 0.8e0 * {2.25 + (_N - 1) * 0.5} GROUP BY movie),
g AS (SELECT movie, i, r, g / CASE WHEN tail > 0 THEN tail ELSE 1 END AS g FROM g0 JOIN t USING (movie)),
o AS (SELECT * FROM (VALUES {', '.join(f'({k - 4}, {w!r}::DOUBLE)' for k, w in enumerate(_W))}) v(k, w)),
s AS (SELECT a.movie, a.i, a.r, sum(o.w * b.g) AS s FROM g a JOIN o ON true JOIN g b ON b.movie = a.movie AND b.i = CASE WHEN a.i + k < 0 THEN -(a.i + k) - 1 WHEN a.i + k >= {_N} THEN {2 * _N - 1} - (a.i + k) ELSE a.i + k END GROUP BY ALL),
pk AS (SELECT movie, arg_max(i, s) AS pi_, max(s) AS top, 1 + (max(s) - 1) / 2 AS half FROM s WHERE r >= 6 GROUP BY movie)
SELECT pk.movie, {R(f'2.25e0 + pi_ * 0.5e0')} AS peak_px, {R('top')} AS height,
 {R(f'CASE WHEN top <= half THEN 0 ELSE 0.5e0 * (coalesce(min(i) FILTER (i > pi_ AND s <= half), {_N - 1}) - coalesce(max(i) FILTER (i < pi_ AND s <= half), 0)) END')} AS width_px
FROM pk JOIN s ON pk.movie = s.movie GROUP BY pk.movie, pi_, top, half""")
def pair_distance_profile(spark, sf):
    """Characteristic spacing of similar beads per movie."""
    ab = close_pairs(V.loc(spark, sf).select("movie", "frame_number", "row_id", "xMean", "yMean", "amplitude1"), 40.0,
                     ["movie", "frame_number"], "xMean", "yMean", "row_id")
    alike = F.greatest("a.amplitude1", "b.amplitude1") <= F.least("a.amplitude1", "b.amplitude1") * 2
    dx, dy = F.col("a.xMean") - F.col("b.xMean"), F.col("a.yMean") - F.col("b.yMean")
    pairs = ab.where(alike).select("movie", F.sqrt(dx * dx + dy * dy).alias("distance"))
    return rounded(S.pair_profile(pairs, ["movie"]).drop("profile"), "peak_px", "height", "width_px")


@register("recall_bands", f"""WITH {V.LOC}, det AS (SELECT movie, frame_number, row_id AS found_id, xMean + (row_id % 41) / 10.3e0 - 1.9e0 AS x, yMean AS y FROM loc WHERE row_id % 5 <> 0),
 near AS (SELECT t.row_id AS truth_id, min(sqrt(pow(t.xMean - d.x, 2) + pow(t.yMean - d.y, 2))) AS err FROM loc t JOIN det d ON t.movie = d.movie AND t.frame_number = d.frame_number
   AND (t.xMean-d.x)*(t.xMean-d.x) + (t.yMean-d.y)*(t.yMean-d.y) <= 4 GROUP BY t.row_id),
 m AS (SELECT *, CASE WHEN amplitude1 < 25 THEN 0 WHEN amplitude1 < 50 THEN 1 WHEN amplitude1 < 100 THEN 2 WHEN amplitude1 < 200 THEN 3 WHEN amplitude1 < 450 THEN 4 ELSE 5 END AS band
   FROM loc LEFT JOIN near ON row_id = truth_id)
SELECT CAST(band AS INTEGER) AS band, count(*) AS n, {R('avg(CASE WHEN err IS NOT NULL THEN 1e0 ELSE 0e0 END)')} AS recall, {R('avg(err)')} AS mean_error FROM m GROUP BY band""")
def recall_bands(spark, sf):
    """Detections (the rows, shifted, four fifths kept) scored against the rows as truth, by brightness."""
    rows = V.loc(spark, sf)
    truth = rows.select("movie", "frame_number", F.col("row_id").alias("truth_id"), F.col("xMean").alias("x"), F.col("yMean").alias("y"), "amplitude1")
    found = rows.where("row_id % 5 <> 0").select("movie", "frame_number", F.col("row_id").alias("found_id"),
                                                 (F.col("xMean") + (F.col("row_id") % 41) / F.lit(10.3) - F.lit(1.9)).alias("x"), F.col("yMean").alias("y"))
    return rounded(S.banded_recall(S.match_truth(truth, found), "amplitude1", [25.0, 50.0, 100.0, 200.0, 450.0]), "recall", "mean_error")


def bead_positions(spark, sf):
    """Analysis positions in µm with variances."""
    return V.loc(spark, sf).select(
        "movie", "track_number", "frame_number", (F.col("xMean") * PX).alias("X"), (F.col("yMean") * PX).alias("Y"), F.col("zMicrons").alias("Z"),
        F.pow(F.coalesce("xPrecisionPx", F.lit(0.1)) * PX, 2).alias("vX"), F.pow(F.col("yPrecisionPx") * PX, 2).alias("vY"), F.pow("zPrecisionUm", 2).alias("vZ"))


BEADS = f"""beads AS (SELECT movie, track_number, frame_number, xMean * {PX}e0 AS X, yMean * {PX}e0 AS Y, zMicrons AS Z,
  pow(coalesce(xPrecisionPx, 0.1e0) * {PX}e0, 2) AS vX, pow(yPrecisionPx * {PX}e0, 2) AS vY, pow(zPrecisionUm, 2) AS vZ FROM loc),
disp AS (SELECT b.movie, b.track_number, b.frame_number, a.X, a.Y, a.Z, b.X - a.X AS ux, b.Y - a.Y AS uy, b.Z - a.Z AS uz, a.vX + b.vX AS vx_, a.vY + b.vY AS vy_, a.vZ + b.vZ AS vz_
  FROM beads b JOIN beads a ON a.movie = b.movie AND a.track_number = b.track_number AND a.frame_number = 2)"""


@register("displacement_ab", f"""WITH {V.LOC}, {BEADS} SELECT movie, track_number, {R('ux')} AS ux, {R('uy')} AS uy, {R('uz')} AS uz, {R('vx_')} AS vx, {R('vz_')} AS vz FROM disp WHERE frame_number = 20""")
def displacement_ab(spark, sf):
    p = bead_positions(spark, sf)
    d = S.displacement(p, F.col("frame_number") == 2, p.where("frame_number = 20"))
    return rounded(d.select("movie", "track_number", "ux", "uy", "uz", "vx", "vz"), "ux", "uy", "uz", "vx", "vz")


@register("busiest_frame", f"""WITH {V.LOC}, {BEADS}, p AS (SELECT movie, frame_number, count(*) AS n, quantile_cont(sqrt(ux*ux+uy*uy+uz*uz), 0.98) AS p98 FROM disp WHERE frame_number <> 2 AND uz IS NOT NULL GROUP BY ALL HAVING count(*) >= 8),
 b AS (SELECT movie, max(p98) AS p98 FROM p GROUP BY movie) SELECT movie, min(frame_number) AS frame, {R('p98')} AS p98 FROM p JOIN b USING (movie, p98) GROUP BY movie, p98""")
def busiest_frame(spark, sf):
    d = S.displacement(bead_positions(spark, sf), F.col("frame_number") == 2)
    return rounded(S.busiest_frame(d, 2, F.lit(1)), "p98")


@register("nearest_spacing", f"""WITH {V.LOC}, {BEADS}, r AS (SELECT * FROM beads WHERE frame_number = 2 AND Z IS NOT NULL),
 d AS (SELECT a.movie, a.track_number, min(sqrt((a.X-b.X)*(a.X-b.X) + (a.Y-b.Y)*(a.Y-b.Y) + (a.Z-b.Z)*(a.Z-b.Z))) AS d FROM r a JOIN r b ON a.movie = b.movie AND a.track_number <> b.track_number GROUP BY ALL)
 SELECT movie, {R('list_sort(list(d))[count(*)//2 + 1]')} AS spacing FROM d GROUP BY movie""")
def nearest_spacing(spark, sf):
    from moteflow.operators.deformation import nearest_spacing as spacing
    return rounded(spacing(bead_positions(spark, sf).where("frame_number = 2 AND Z IS NOT NULL")), "spacing")


@register("principal_direction_sums", f"""WITH {V.LOC}, v AS (SELECT movie, track_number, xMean - lag(xMean) OVER w AS vx, yMean - lag(yMean) OVER w AS vy, zMicrons - lag(zMicrons) OVER w AS vz FROM loc WHERE zMicrons IS NOT NULL WINDOW w AS (PARTITION BY movie, track_number ORDER BY frame_number))
 SELECT movie, track_number, {R('sum(vx*vx)', 5)} AS xx, {R('sum(vx*vy)', 5)} AS xy, {R('sum(vz*vz)', 5)} AS zz FROM v WHERE vx IS NOT NULL GROUP BY ALL""")
def principal_direction_sums(spark, sf):
    w = Window.partitionBy("movie", "track_number").orderBy("frame_number")
    v = V.loc(spark, sf).where("zMicrons IS NOT NULL").select("movie", "track_number", *[(F.col(c) - F.lag(c).over(w)).alias(n) for c, n in (("xMean", "vx"), ("yMean", "vy"), ("zMicrons", "vz"))])
    g = v.where("vx IS NOT NULL").groupBy("movie", "track_number").agg(F.sum(F.expr("vx*vx")).alias("xx"), F.sum(F.expr("vx*vy")).alias("xy"), F.sum(F.expr("vz*vz")).alias("zz"))
    return g.withColumns({c: F.round(c, 5) for c in ("xx", "xy", "zz")})


def _plane_pass(k: int) -> str:
    prev = f"pk{k}"
    return f"""ps{k} AS (SELECT movie, count(*) AS n, avg(X) AS mx, avg(Y) AS my, avg(Z) AS mz, covar_pop(X, X) AS xx, covar_pop(X, Y) AS xy, covar_pop(Y, Y) AS yy, covar_pop(X, Z) AS xz, covar_pop(Y, Z) AS yz FROM {prev} WHERE ok GROUP BY movie),
pc{k} AS (SELECT movie, n, (xz*yy - yz*xy)/(xx*yy - xy*xy) AS c1, (yz*xx - xz*xy)/(xx*yy - xy*xy) AS c2, mz - mx*(xz*yy - yz*xy)/(xx*yy - xy*xy) - my*(yz*xx - xz*xy)/(xx*yy - xy*xy) AS c0 FROM ps{k}),
pr{k} AS (SELECT r.*, abs(Z - c0 - c1*X - c2*Y) AS res FROM {prev} r JOIN pc{k} USING (movie)), pm{k} AS (SELECT movie, 1.4826e0*median(res) AS mad FROM pr{k} GROUP BY movie),
pk{k + 1} AS (SELECT movie, X, Y, Z, ok AND res < 3*mad AS ok FROM pr{k} JOIN pm{k} USING (movie))"""


PLANE = f"pk0 AS (SELECT movie, X, Y, Z, true AS ok FROM beads WHERE frame_number = 2 AND Z IS NOT NULL), {_plane_pass(0)}, {_plane_pass(1)}, {_plane_pass(2)}"


@register("robust_plane", f"""WITH {V.LOC}, {BEADS}, {PLANE} SELECT movie, {R('c0', 5)} AS c0, {R('c1', 5)} AS c1, {R('c2', 5)} AS c2, n AS fit_rows FROM pc2""")
def robust_plane(spark, sf):
    from moteflow.operators.deformation import median_plane
    p = median_plane(bead_positions(spark, sf).where("frame_number = 2 AND Z IS NOT NULL"))
    return p.select("movie", "fit_rows", *[F.round(F.col("coef")[i], 5).alias(f"c{i}") for i in range(3)])


@register("grid_extent", f"""WITH {V.LOC}, {BEADS}, e AS (SELECT movie, min(X) AS x0, max(X) AS x1, min(Y) AS y0, max(Y) AS y1 FROM beads WHERE frame_number = 2 AND Z IS NOT NULL GROUP BY movie),
 p AS (SELECT movie, x0 - 0.03e0*greatest(x1-x0, 1) AS xlo, x1 + 0.03e0*greatest(x1-x0, 1) AS xhi, y0 - 0.03e0*greatest(y1-y0, 1) AS ylo, y1 + 0.03e0*greatest(y1-y0, 1) AS yhi FROM e)
 SELECT movie, {R('xlo')} AS xlo, {R('xhi')} AS xhi, {R('ylo')} AS ylo, {R('yhi')} AS yhi, CAST(greatest(8, least(60, floor(44*(yhi-ylo)/(xhi-xlo) + 0.5e0))) AS INTEGER) AS ny FROM p""")
def grid_extent(spark, sf):
    from moteflow.operators.deformation import grid_extent as extent
    e = extent(bead_positions(spark, sf).where("frame_number = 2 AND Z IS NOT NULL"))
    return rounded(e.select("movie", "xlo", "xhi", "ylo", "yhi", "ny"), "xlo", "xhi", "ylo", "yhi")
