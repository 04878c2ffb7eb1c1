"""Filters, regions, selections, coordinates."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from moteflow.catalog import views as V
from moteflow.catalog.drift import DRIFT, STAB, STATS_COLS, STATS_SELECT, stats_sql, PX
from moteflow.catalog.registry import R, register, rounded
from moteflow.operators import drift as D, filters as X, tracks as T
from moteflow.settings import DEFAULTS

BRIGHT = """one AS (SELECT movie, track_number, list_sort(list(least(amplitude1, amplitude2)))[count(*)//2 + 1] AS amp,
  list_sort(list(xMean))[count(*)//2 + 1] AS cx, list_sort(list(yMean))[count(*)//2 + 1] AS cy FROM loc GROUP BY ALL),
nb AS (SELECT a.movie, a.track_number, count(*) AS n, list_sort(list(b.amp))[count(*)//2 + 1] AS ref FROM one a JOIN one b
  ON a.movie = b.movie AND a.track_number <> b.track_number AND (a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy) <= 22500 GROUP BY ALL),
wm AS (SELECT movie, list_sort(list(amp))[count(*)//2 + 1] AS all_ref FROM one GROUP BY movie),
bright AS (SELECT movie, track_number, 100e0 * amp / CASE WHEN coalesce(n, 0) >= 3 THEN ref ELSE all_ref END AS brightness
  FROM one LEFT JOIN nb USING (movie, track_number) JOIN wm USING (movie))"""


@register("track_brightness", f"WITH {V.LOC}, {BRIGHT} SELECT movie, track_number, {R('brightness')} AS brightness FROM bright")
def track_brightness(spark, sf):
    return rounded(X.track_brightness(V.loc(spark, sf)), "brightness")


@register("filtered_tracks", f"""WITH {V.LOC}, {BRIGHT},
ok AS (SELECT * FROM loc WHERE frame_number BETWEEN 3 AND 27 AND zMicrons IS NOT NULL AND zStatus = 0 AND zMicrons BETWEEN -18 AND 19 AND recovered = 0),
keep AS (SELECT *, count(*) OVER (PARTITION BY movie, track_number) AS n FROM ok),
f AS (SELECT k.* FROM keep k JOIN bright USING (movie, track_number) WHERE n >= 5 AND brightness >= 40),
{stats_sql('f', 'xMean', 'yMean', 'zMicrons')} {STATS_SELECT} FROM stats""")
def filtered_tracks(spark, sf):
    rows = V.loc(spark, sf)
    ok = X.filter_rows(rows, frames=(3, 27), valid_only=True, z_range=(-18.0, 19.0), recovered="hide")
    kept = X.filter_tracks(ok, min_length=5, min_brightness=40.0, brightness=X.track_brightness(rows))
    return rounded(T.track_stats(kept, "xMean", "yMean", "zMicrons", PX), *STATS_COLS)


def rois(spark, sf):
    """One region per supplier: a rectangle or a quadrilateral in the movie of the same number."""
    k = F.col("s_suppkey") - 1
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, y0 = k * 7 % 90 + 20, k * 11 % 80 + 15
    rect = F.array(pt(x0 + 120, y0 + 110), pt(x0, y0))
    poly = F.array(pt(x0, y0), pt(x0 + 130, y0 + 20), pt(x0 + 90, y0 + 140), pt(x0 + 40, y0 + 60))
    return V.table(spark, sf, "supplier").select(
        F.concat(F.lit("m"), k.cast("string")).alias("movie"), k.alias("roi_id"),
        F.when(k % 2 == 0, F.lit("rect")).otherwise(F.lit("poly")).alias("kind"), F.when(k % 2 == 0, rect).otherwise(poly).alias("pts"))


def _edge(i: int, j: int) -> str:
    px = ["x0", "x0+130", "x0+90", "x0+40"]
    py = ["y0", "y0+20", "y0+140", "y0+60"]
    return (f"CASE WHEN ({py[i]} > yMean) <> ({py[j]} > yMean) AND xMean < (({px[j]})-({px[i]})) * (yMean-({py[i]})) / CAST(({py[j]})-({py[i]}) AS DOUBLE) + {px[i]} THEN 1 ELSE 0 END")


ROI = f"""rois AS (SELECT 'm' || k AS movie, k AS roi_id, k * 7 % 90 + 20 AS x0, k * 11 % 80 + 15 AS y0 FROM (SELECT s_suppkey - 1 AS k FROM supplier)),
inroi AS (SELECT loc.*, roi_id FROM loc JOIN rois USING (movie) WHERE CASE WHEN roi_id % 2 = 0 THEN xMean BETWEEN x0 AND x0+120 AND yMean BETWEEN y0 AND y0+110
  ELSE ({_edge(0, 3)} + {_edge(1, 0)} + {_edge(2, 1)} + {_edge(3, 2)}) % 2 = 1 END)"""


@register("roi_rows", f"WITH {V.LOC}, {ROI} SELECT roi_id, row_id FROM inroi")
def roi_rows(spark, sf):
    return X.in_roi(V.loc(spark, sf), rois(spark, sf)).select("roi_id", "row_id")


@register("roi_tracks", f"WITH {V.LOC}, {ROI} SELECT DISTINCT roi_id, movie, track_number FROM inroi")
def roi_tracks(spark, sf):
    return X.tracks_in_roi(V.loc(spark, sf), rois(spark, sf))


@register("roi_tracks_at_frame", f"WITH {V.LOC}, {ROI} SELECT DISTINCT roi_id, movie, track_number FROM inroi WHERE frame_number = 12")
def roi_tracks_at_frame(spark, sf):
    return X.tracks_in_roi(V.loc(spark, sf), rois(spark, sf), 12)


@register("eligible_rows", f"""WITH {V.LOC}, ok AS (SELECT *, count(*) OVER (PARTITION BY movie, track_number) AS n FROM loc WHERE zMicrons IS NOT NULL)
 SELECT row_id, {R("coalesce(CASE WHEN xPrecisionPx > 0 THEN xPrecisionPx END, median(CASE WHEN xPrecisionPx > 0 THEN xPrecisionPx END) OVER (PARTITION BY movie, track_number), 0.1e0)")} AS xPrecisionPx FROM ok WHERE n >= 10""")
def eligible_rows(spark, sf):
    ok = X.eligible_tracks(V.loc(spark, sf), ["xMean", "yMean", "zMicrons"])
    return rounded(X.repair_precision(ok, ["xPrecisionPx"]).select("row_id", "xPrecisionPx"), "xPrecisionPx")


LOWQ = """usable AS (SELECT * FROM (SELECT *, recovered <> 1 AS det, max(CASE WHEN recovered <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY movie, track_number) AS anyd FROM loc) WHERE det OR anyd = 0),
tm AS (SELECT movie, track_number, median(minLobeSNR) AS snr, median(templateScore) AS score FROM usable GROUP BY ALL),
typ AS (SELECT movie, median(snr) AS typical FROM tm GROUP BY movie),
lowq AS (SELECT movie, track_number FROM tm JOIN typ USING (movie) WHERE snr < least(15e0, {frac}e0 * typical) AND score < {score}e0)"""


@register("low_quality_tracks", f"WITH {V.LOC}, {LOWQ.format(frac='0.95', score='0.66')} SELECT movie, track_number FROM lowq")
def low_quality_tracks(spark, sf):
    from dataclasses import replace
    return X.low_quality_tracks(V.loc(spark, sf), replace(DEFAULTS, reject_track_snr_fraction=0.95, reject_track_template=0.66))


@register("movie_verdicts", f"""WITH {V.LOC}, c AS (SELECT movie, frame_number, count(*) AS n FROM loc GROUP BY ALL),
 b AS (SELECT movie, median(n) AS beads FROM c GROUP BY movie), s AS (SELECT movie, median(minLobeSNR) AS snr FROM loc GROUP BY movie)
 SELECT movie, beads, {R('snr')} AS snr, CASE WHEN beads < 3 THEN 'empty' WHEN snr < 6 THEN 'dim' ELSE 'bright' END AS verdict FROM b JOIN s USING (movie)""")
def movie_verdicts(spark, sf):
    from moteflow.operators.quality import movie_verdicts as verdicts
    return rounded(verdicts(V.loc(spark, sf)), "snr")


@register("calibration_verdicts", f"""WITH {V.LOC}, {V.CAL}, last AS (SELECT movie, max(frame_number) AS n FROM cal GROUP BY movie),
 pick AS (SELECT movie, n, unnest([CAST(round_even((n-1)*0.25e0, 0) AS INTEGER)+1, CAST(round_even((n-1)*0.5e0, 0) AS INTEGER)+1, CAST(round_even((n-1)*0.75e0, 0) AS INTEGER)+1]) AS frame_number FROM last),
 p AS (SELECT movie, n, frame_number, count(*) AS beads, degrees(atan2(median(sin(radians(angleDegrees*2))), median(cos(radians(angleDegrees*2)))))/2 AS a
   FROM pick JOIN cal USING (movie, frame_number) GROUP BY ALL),
 t AS (SELECT *, abs(((a - lag(a) OVER (PARTITION BY movie ORDER BY frame_number) + 90) % 180 + 180) % 180 - 90) AS turn FROM p),
 g AS (SELECT movie, min(n) AS n, median(beads) AS beads_per_plane, sum(turn) AS rotation FROM t GROUP BY movie)
SELECT movie, beads_per_plane, {R('rotation')} AS rotation, CASE WHEN beads_per_plane < 20 THEN 'too_dim' WHEN n < 10 OR rotation IS NULL OR rotation < 10 THEN 'not_zscan' ELSE 'ok' END AS verdict FROM g""")
def calibration_verdicts(spark, sf):
    from moteflow.operators.quality import calibration_verdicts as verdicts
    return rounded(verdicts(V.cal_rows(spark, sf)), "rotation")


@register("analysis_coordinates", f"""WITH {V.LOC}, {DRIFT}, c AS (SELECT l.*, CASE WHEN row_id % 19 <> 0 THEN xMean - 0.01e0 * zMicrons END AS xCorrected,
  CASE WHEN row_id % 17 <> 0 THEN yMean + 0.02e0 * zMicrons END AS yCorrected, dx, dy, dz FROM loc l LEFT JOIN drift USING (movie, frame_number))
SELECT row_id, {R(f'(coalesce(xCorrected, xMean) - dx) * {PX}e0')} AS xAnalysis, {R(f'(coalesce(yCorrected, yMean) - dy) * {PX}e0')} AS yAnalysis,
 {R('zMicrons - dz')} AS zAnalysis, 'lateral-corrected · XY + Z stabilized' AS coordinates,
 {R('coalesce(CASE WHEN xPrecisionPx > 0 THEN xPrecisionPx END, 0.1e0)')} AS sdX, {R('zPrecisionUm')} AS sdZ FROM c""")
def analysis_coordinates(spark, sf):
    rows = V.loc(spark, sf)
    with_d = D.with_drift(rows, D.estimate_drift(rows)).withColumns({
        "xCorrected": F.when(F.col("row_id") % 19 != 0, F.col("xMean") - F.lit(0.01) * F.col("zMicrons")),
        "yCorrected": F.when(F.col("row_id") % 17 != 0, F.col("yMean") + F.lit(0.02) * F.col("zMicrons"))})
    out = X.position_sd(X.analysis_coordinates(with_d, True, True, True, True, PX))
    return rounded(out.select("row_id", "xAnalysis", "yAnalysis", "zAnalysis", "coordinates", "sdX", "sdZ"),
                   "xAnalysis", "yAnalysis", "zAnalysis", "sdX", "sdZ")


@register("selection_sets", f"""WITH {V.LOC}, a AS (SELECT DISTINCT movie, track_number FROM loc WHERE amplitude1 > 300), b AS (SELECT DISTINCT movie, track_number FROM loc WHERE minLobeSNR > 40),
 everything AS (SELECT DISTINCT movie, track_number FROM loc)
 SELECT 'add' AS op, * FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'remove', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
 UNION ALL SELECT 'toggle', * FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a))
 UNION ALL SELECT 'invert', * FROM (SELECT * FROM everything EXCEPT SELECT * FROM a)""")
def selection_sets(spark, sf):
    from moteflow.operators.selection import change_selection
    rows = V.loc(spark, sf)
    ids = lambda c: rows.where(c).select("movie", "track_number").distinct()
    a, b = ids(F.col("amplitude1") > 300), ids(F.col("minLobeSNR") > 40)
    parts = [change_selection(a, b if op != "invert" else ids(F.lit(True)), op).select(F.lit(op).alias("op"), "movie", "track_number")
             for op in ("add", "remove", "toggle", "invert")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("thinned_beads", f"""WITH {V.LOC}, i AS (SELECT movie, frame_number, row_id, row_number() OVER (PARTITION BY movie ORDER BY row_id) - 1 AS i, count(*) OVER (PARTITION BY movie) AS n FROM loc)
 SELECT movie, row_id FROM i WHERE n <= 600 OR (i * 7919) % n < 600""")
def thinned_beads(spark, sf):
    return X.thin(V.loc(spark, sf), ["movie"], "row_id").select("movie", "row_id")


@register("sorted_track_list", f"""WITH {V.LOC}, s AS (SELECT movie, track_number, avg(zMicrons) AS mean_z FROM loc GROUP BY ALL)
 SELECT CAST(row_number() OVER (PARTITION BY movie ORDER BY mean_z DESC NULLS LAST, track_number) AS INTEGER) AS position, movie, track_number, {R('mean_z')} AS mean_z FROM s""")
def sorted_track_list(spark, sf):
    s = V.loc(spark, sf).groupBy("movie", "track_number").agg(F.avg("zMicrons").alias("mean_z"))
    w = Window.partitionBy("movie").orderBy(F.col("mean_z").desc_nulls_last(), "track_number")
    return rounded(s.withColumn("position", F.row_number().over(w)), "mean_z")


@register("first_selected_tracks", f"""WITH {V.LOC}, s AS (SELECT DISTINCT movie, track_number FROM loc WHERE amplitude1 > 300 ORDER BY track_number LIMIT 30),
 d AS (SELECT l.movie, track_number, frame_number, xMean - first_value(xMean) OVER w AS ux, zMicrons - first_value(zMicrons) OVER w AS uz
  FROM loc l JOIN s USING (movie, track_number) WINDOW w AS (PARTITION BY l.movie, track_number ORDER BY frame_number))
 SELECT movie, track_number, frame_number, {R('ux')} AS ux, {R('uz')} AS uz FROM d""")
def first_selected_tracks(spark, sf):
    """The first 30 selected tracks and their displacement from their first localization."""
    rows = V.loc(spark, sf)
    sel = rows.where("amplitude1 > 300").select("movie", "track_number").distinct().orderBy("track_number").limit(30)
    w = Window.partitionBy("movie", "track_number").orderBy("frame_number")
    out = rows.join(F.broadcast(sel), ["movie", "track_number"], "left_semi").select(
        "movie", "track_number", "frame_number", (F.col("xMean") - F.first("xMean").over(w)).alias("ux"),
        (F.col("zMicrons") - F.first("zMicrons").over(w)).alias("uz"))
    return rounded(out, "ux", "uz")
