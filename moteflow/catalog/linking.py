"""Tracking queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from moteflow.catalog import views as V
from moteflow.catalog.pairs import lobe_pairs
from moteflow.catalog.registry import R, register, rounded
from moteflow.catalog.stats import ax
from moteflow.operators import linking as L, quality as Q, trackers as K


@register("link_candidates", f"""WITH {V.LOC} SELECT a.movie, a.frame_number AS frame, a.row_id AS aid, b.row_id AS bid,
 {R(f"(b.xMean-a.xMean)*(b.xMean-a.xMean) + (b.yMean-a.yMean)*(b.yMean-a.yMean) + pow({ax('a.angleDegrees', 'b.angleDegrees')}/15e0, 2)")} AS cost
 FROM loc a JOIN loc b ON a.movie = b.movie AND b.frame_number = a.frame_number + 1 AND (b.xMean-a.xMean)*(b.xMean-a.xMean) + (b.yMean-a.yMean)*(b.yMean-a.yMean) <= 64
 AND coalesce(abs(a.zMicrons - b.zMicrons) <= greatest(8e0, 4 * sqrt(a.zPrecisionUm*a.zPrecisionUm + b.zPrecisionUm*b.zPrecisionUm)), true)""")
def link_candidates(spark, sf):
    rows = V.loc(spark, sf).withColumns({"z": F.col("zMicrons"), "z_sd": F.col("zPrecisionUm")})
    return rounded(L.adjacent_candidates(rows, depth=True), "cost")


SEGMENTS = """seg AS (SELECT *, frame_number - row_number() OVER (PARTITION BY movie, track_number ORDER BY frame_number) AS isl FROM loc),
segr AS (SELECT *, min(row_id) OVER (PARTITION BY movie, track_number, isl) AS s, row_number() OVER (PARTITION BY movie, track_number, isl ORDER BY frame_number) AS ra,
  row_number() OVER (PARTITION BY movie, track_number, isl ORDER BY frame_number DESC) AS rd FROM seg)"""


def segments(spark, sf):
    """Runs of consecutive frames of the given tracks."""
    w = Window.partitionBy("movie", "track_number").orderBy("frame_number")
    r = V.loc(spark, sf).withColumn("isl", F.col("frame_number") - F.row_number().over(w))
    return r.withColumns({"seg": F.min("row_id").over(Window.partitionBy("movie", "track_number", "isl")), "z": F.col("zMicrons"), "z_sd": F.col("zPrecisionUm")})


@register("gap_candidates", f"""WITH {V.LOC}, {SEGMENTS},
en AS (SELECT movie, s, max(CASE WHEN rd = 1 THEN row_id END) AS id, max(frame_number) AS f, max(CASE WHEN rd = 1 THEN xMean END) AS x, max(CASE WHEN rd = 1 THEN yMean END) AS y, max(CASE WHEN rd = 1 THEN angleDegrees END) AS a, median(zMicrons) AS z, median(zPrecisionUm) AS sd FROM segr WHERE rd <= 5 GROUP BY movie, s),
st AS (SELECT movie, s, max(CASE WHEN ra = 1 THEN row_id END) AS id, min(frame_number) AS f, max(CASE WHEN ra = 1 THEN xMean END) AS x, max(CASE WHEN ra = 1 THEN yMean END) AS y, max(CASE WHEN ra = 1 THEN angleDegrees END) AS a, median(zMicrons) AS z, median(zPrecisionUm) AS sd FROM segr WHERE ra <= 5 GROUP BY movie, s),
c AS (SELECT e.movie, e.id AS aid, t.id AS bid, t.f - e.f AS dt, (e.x-t.x)*(e.x-t.x) + (e.y-t.y)*(e.y-t.y) AS d2, (e.x-t.x)*(e.x-t.x) + (e.y-t.y)*(e.y-t.y) + pow({ax('e.a', 't.a')}/15e0, 2) AS cost,
  abs(e.z - t.z) AS dz, greatest(8e0, 4*sqrt(e.sd*e.sd + t.sd*t.sd)) + greatest(t.f - e.f - 1, 0) AS tol FROM en e JOIN st t ON e.movie = t.movie AND t.f - e.f BETWEEN 1 AND 6)
SELECT movie, aid, bid, CAST(dt AS INTEGER) AS dt, {R('cost')} AS cost FROM c WHERE d2 <= 144 AND coalesce(dz <= tol, true) AND (dt > 1 OR cost <= 64)""")
def gap_candidates(spark, sf):
    s = segments(spark, sf)
    ends, starts = L.segment_ends(s, "seg", True)
    return rounded(L.gap_candidates(ends, starts, "seg", depth=True).drop("aseg", "bseg"), "cost")


@register("tracks_lap")
def tracks_lap(spark, sf):
    """Two-stage assignment with depth gates over all movies."""
    rows = V.loc(spark, sf).withColumns({"z": F.col("zMicrons"), "z_sd": F.col("zPrecisionUm")})
    return L.track_lap(rows, depth=True)


@register("tracks_kalman")
def tracks_kalman(spark, sf):
    return K.track_kalman(V.loc(spark, sf))


@register("tracks_nearest")
def tracks_nearest(spark, sf):
    return K.track_nearest(V.loc(spark, sf))


@register("tracker_comparison")
def tracker_comparison(spark, sf):
    """The three trackers side by side."""
    rows = V.loc(spark, sf)
    xy = rows.select("movie", "row_id", "xMean", "yMean")
    parts = [K.retrack(rows, m).join(xy, ["movie", "row_id"]).withColumn("method", F.lit(m)) for m in ("lap", "kalman", "nearest")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rounded(Q.compare_trackers(out), "completeness")


@register("retracking_summary")
def retracking_summary(spark, sf):
    return Q.tracking_summary(K.retrack(V.loc(spark, sf), "lap"))


@register("given_tracking_summary", f"""WITH {V.LOC}, n AS (SELECT movie, track_number, count(*) AS n, min(frame_number) AS f0, max(frame_number) AS f1 FROM loc GROUP BY ALL),
 s AS (SELECT movie, max(f1) - min(f0) + 1 AS frames FROM n GROUP BY movie)
 SELECT movie, count(*) AS tracks_total, count(*) FILTER (n >= 26) AS tracks_kept, count(*) FILTER (n >= 26 AND n >= frames) AS full_length, coalesce(median(n) FILTER (n >= 26), 0) AS median_length,
 count(*) FILTER (n < 26) AS short_tracks, coalesce(CAST(sum(n) FILTER (n < 26) AS BIGINT), 0) AS short_rows FROM n JOIN s USING (movie) GROUP BY movie""")
def given_tracking_summary(spark, sf):
    return Q.tracking_summary(V.loc(spark, sf), 26)


@register("given_tracker_comparison", f"""WITH {V.LOC}, r AS (SELECT movie, track_number, frame_number, sqrt(pow(xMean - lag(xMean) OVER w, 2) + pow(yMean - lag(yMean) OVER w, 2)) AS s FROM loc WINDOW w AS (PARTITION BY movie, track_number ORDER BY frame_number)),
 p AS (SELECT movie, track_number, count(*) AS n, count(*) FILTER (s > 2) AS swaps, max(frame_number) AS f1 FROM r GROUP BY ALL), l AS (SELECT movie, max(f1) AS nf FROM p GROUP BY movie)
 SELECT movie, 'given' AS method, count(*) AS tracks, count(*) FILTER (n = nf) AS full_length, count(*) FILTER (n >= 10) AS at_least_10, count(*) FILTER (n < 3) AS transient_lt3, median(n) AS median_length,
 {R('CAST(sum(n) FILTER (n >= 10) AS DOUBLE) / (max(nf) * count(*) FILTER (n >= 10))')} AS completeness, CAST(sum(swaps) AS BIGINT) AS steps_over_2px FROM p JOIN l USING (movie) GROUP BY movie""")
def given_tracker_comparison(spark, sf):
    return rounded(Q.compare_trackers(V.loc(spark, sf).withColumn("method", F.lit("given")), far_px=2), "completeness")


@register("matched_lobes")
def matched_lobes(spark, sf):
    """Lobes of every frame paired by maximum total weight (26 - cost)."""
    e = lobe_pairs(spark, sf).select(F.col("lobe_a").alias("a"), F.col("lobe_b").alias("b"), (F.lit(26.0) - F.col("cost")).alias("weight"))
    return rounded(L.match_pairs(e), "weight")


@register("renumbered_tracks", f"""WITH {V.LOC}, k AS (SELECT * FROM loc),
 f AS (SELECT movie, track_number, arg_min(row_id, frame_number) AS fr, min(frame_number) AS ff FROM k GROUP BY ALL),
 n AS (SELECT movie, track_number, row_number() OVER (PARTITION BY movie ORDER BY ff, fr) AS num FROM f)
 SELECT k.movie, row_id, CAST(num AS INTEGER) AS track_number FROM k JOIN n USING (movie, track_number)""")
def renumbered_tracks(spark, sf):
    k = V.loc(spark, sf).select("movie", "row_id", "frame_number", F.col("track_number").alias("old"))
    return L.number_tracks(k, "old").select("movie", "row_id", "track_number")
