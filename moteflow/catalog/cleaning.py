"""Cleaning and recovery queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window, functions as F

from moteflow.catalog import views as V
from moteflow.catalog.registry import R, register, rounded
from moteflow.catalog.filters import LOWQ
from moteflow.catalog.stats import ax
from moteflow.functions.arrays import theil_sen
from moteflow.operators import cleaning as C, recovery as Y
from moteflow.operators.linking import number_tracks
from moteflow.settings import DEFAULTS


def rows_z(spark, sf):
    return V.loc(spark, sf).withColumn("z", F.col("zMicrons"))


@register("jump_scores", f"""WITH {V.LOC},
s AS (SELECT movie, track_number, zMicrons - lag(zMicrons) OVER (PARTITION BY movie, track_number ORDER BY frame_number) AS st FROM loc),
sm AS (SELECT movie, track_number, median(st) AS mid, count(st) AS ns FROM s GROUP BY ALL),
sd AS (SELECT movie, track_number, CASE WHEN min(ns) >= 6 THEN 1.4826e0 * median(abs(st - mid)) / sqrt(2e0) END AS sd FROM s JOIN sm USING (movie, track_number) GROUP BY ALL),
p AS (SELECT a.movie, a.track_number, a.row_id, a.frame_number, a.xMean AS x, a.yMean AS y, a.zMicrons AS z, b.xMean AS bx, b.yMean AS by_, b.zMicrons AS bz, {ax('b.angleDegrees', 'a.angleDegrees')} AS turn
  FROM loc a JOIN loc b ON a.movie = b.movie AND a.track_number = b.track_number AND abs(a.frame_number - b.frame_number) <= 5 AND a.row_id <> b.row_id),
r AS (SELECT row_id, median(bx) AS rx, median(by_) AS ry, median(turn) AS turn, median(bz) AS zm, count(*) AS k, count(bz) AS kz FROM p GROUP BY row_id),
q AS (SELECT p.movie, p.track_number, p.row_id, p.frame_number, p.x, p.y, p.z, rx, ry, r.turn, zm, k, kz, median(sqrt((bx-rx)*(bx-rx) + (by_-ry)*(by_-ry))) AS spread, median(abs(bz - zm)) AS zmad FROM p JOIN r USING (row_id) GROUP BY ALL),
n AS (SELECT movie, track_number, count(*) AS n FROM loc GROUP BY ALL)
SELECT movie, track_number, row_id, frame_number, {R('sqrt((x-rx)*(x-rx)+(y-ry)*(y-ry))')} AS xy_off, {R('3 + 2*spread')} AS xy_cut, {R('turn')} AS turn,
 {R('CASE WHEN kz >= 2 AND z IS NOT NULL THEN abs(z - zm) ELSE 0 END')} AS dz, {R('CASE WHEN kz >= 2 AND z IS NOT NULL THEN greatest(2.5e0, coalesce(4*sd, 3*1.4826e0*zmad)) ELSE 2.5e0 END')} AS z_cut, {R('sd')} AS track_sd
FROM q JOIN sd USING (movie, track_number) JOIN n USING (movie, track_number) WHERE n >= 4 AND k >= 2""")
def jump_scores(spark, sf):
    return rounded(C.jump_scores(rows_z(spark, sf)), "xy_off", "xy_cut", "turn", "dz", "z_cut", "track_sd")


@register("jump_outliers")
def jump_outliers(spark, sf):
    return C.jump_outliers(rows_z(spark, sf))


@register("trend_slopes", f"""WITH {V.LOC}, nb AS (SELECT a.row_id, b.frame_number AS t, b.zMicrons AS v, row_number() OVER (PARTITION BY a.row_id ORDER BY abs(b.frame_number - a.frame_number), b.frame_number) AS k
  FROM loc a JOIN loc b ON a.movie = b.movie AND a.track_number = b.track_number AND a.row_id <> b.row_id AND abs(a.frame_number - b.frame_number) <= 15 AND b.zMicrons IS NOT NULL),
 six AS (SELECT * FROM nb WHERE k <= 6)
 SELECT p.row_id, {R('median((q.v - p.v) / (q.t - p.t))')} AS slope FROM six p JOIN six q ON p.row_id = q.row_id AND p.t < q.t GROUP BY p.row_id""")
def trend_slopes(spark, sf):
    """Median pairwise slope of depth over the six nearest frames within 15 of each localization."""
    w = Window.partitionBy("movie", "track_number").orderBy("frame_number").rangeBetween(-15, 15)
    pt = F.struct(F.col("frame_number").alias("t"), F.col("zMicrons").alias("v"), F.col("row_id").alias("id"))
    r = V.loc(spark, sf).withColumn("n", F.collect_list(F.when(F.col("zMicrons").isNotNull(), pt)).over(w))
    near = F.array_sort(F.transform(F.filter("n", lambda s: s["id"] != F.col("row_id")), lambda s: F.struct(F.abs(s["t"] - F.col("frame_number")).alias("d"), s["t"].alias("t"), s["v"].alias("v"))))
    r = r.withColumn("six", F.slice(near, 1, 6)).where(F.size("six") >= 2)
    return rounded(r.select("row_id", theil_sen(F.col("six")).alias("slope")), "slope")


JIT = """jst AS (SELECT movie, zMicrons - lag(zMicrons) OVER w AS d, frame_number - lag(frame_number) OVER w AS df FROM loc WINDOW w AS (PARTITION BY movie, track_number ORDER BY frame_number)),
jok AS (SELECT movie, d FROM jst WHERE df = 1 AND d IS NOT NULL), jm AS (SELECT movie, median(d) AS mid, count(*) AS n FROM jok GROUP BY movie),
cuts AS (SELECT movie, greatest(5e0, coalesce(CASE WHEN min(n) >= 20 THEN 4*1.4826e0*median(abs(d - mid))/sqrt(2e0) END, 5e0)) AS cut FROM jok JOIN jm USING (movie) GROUP BY movie)"""


@register("alternating_candidates", f"""WITH {V.LOC}, {JIT},
p AS (SELECT a.movie, a.row_id AS aid, a.zMicrons AS az, a.frame_number AS af, b.frame_number AS bf, b.row_id AS bid, b.zMicrons AS bz FROM loc a JOIN loc b ON a.movie = b.movie AND a.row_id <> b.row_id
  AND abs(a.frame_number - b.frame_number) <= 5 AND (a.xMean-b.xMean)*(a.xMean-b.xMean) + (a.yMean-b.yMean)*(a.yMean-b.yMean) <= 9 WHERE a.zMicrons IS NOT NULL),
okp AS (SELECT aid FROM p GROUP BY aid HAVING count(*) FILTER (af = bf) = 0 AND count(*) FILTER (af <> bf AND bz IS NOT NULL) >= 4),
m AS (SELECT p.*, cut FROM p JOIN okp USING (aid) JOIN cuts USING (movie) WHERE bz IS NOT NULL AND af <> bf),
sup AS (SELECT x.movie, x.aid, x.az, x.cut, x.bid, x.bf, x.bz, count(*) AS support FROM m x JOIN m y ON x.aid = y.aid AND abs(x.bz - y.bz) <= x.cut/2 GROUP BY ALL),
best AS (SELECT aid, max(support) AS best, first(bz ORDER BY support DESC, bf, bid) AS at_z FROM sup GROUP BY aid),
g AS (SELECT sup.movie, sup.aid, az, cut, best, avg(bz) FILTER (abs(bz - at_z) <= cut/2) AS mode_z, count(*) FILTER (abs(bz - az) <= cut/2) AS own FROM sup JOIN best USING (aid) GROUP BY ALL)
SELECT movie, aid AS row_id, {R('mode_z')} AS mode_z, CAST(best AS INTEGER) AS support, CAST(own AS INTEGER) AS own FROM g WHERE abs(az - mode_z) > cut AND best >= 3 AND own < best""")
def alternating_candidates(spark, sf):
    c = C.alternating_candidates(rows_z(spark, sf))
    return rounded(c.select("movie", F.col("aid").alias("row_id"), F.col("mode").alias("mode_z"), F.col("best").alias("support"), "own"), "mode_z")


@register("alternating_rows")
def alternating_rows(spark, sf):
    return C.alternating_rows(rows_z(spark, sf))


ENDS = """er AS (SELECT *, row_number() OVER (PARTITION BY movie, {t} ORDER BY frame_number) AS ra, row_number() OVER (PARTITION BY movie, {t} ORDER BY frame_number DESC) AS rd FROM {src}),
en AS (SELECT movie, {t} AS t, min(frame_number) AS f0, max(frame_number) AS f1, count(*) AS n, median(xMean) FILTER (ra <= 5) AS hx, median(yMean) FILTER (ra <= 5) AS hy, median(zMicrons) FILTER (ra <= 5) AS hz,
  median(xMean) FILTER (rd <= 5) AS tx, median(yMean) FILTER (rd <= 5) AS ty, median(zMicrons) FILTER (rd <= 5) AS tz FROM er GROUP BY ALL)"""


@register("sandwiched_tracks", f"""WITH {V.LOC}, cutrow AS (SELECT * REPLACE (track_number * 10 + CASE WHEN frame_number <= 10 THEN 1 WHEN frame_number <= 19 THEN 2 ELSE 3 END AS track_number,
   CASE WHEN frame_number BETWEEN 11 AND 19 AND track_number % 3 = 0 THEN zMicrons + 12 ELSE zMicrons END AS zMicrons) FROM loc),
 cjs AS (SELECT movie, zMicrons - lag(zMicrons) OVER w AS d, frame_number - lag(frame_number) OVER w AS df FROM cutrow WINDOW w AS (PARTITION BY movie, track_number ORDER BY frame_number)),
 cok AS (SELECT movie, d FROM cjs WHERE df = 1 AND d IS NOT NULL), cm AS (SELECT movie, median(d) AS mid FROM cok GROUP BY movie),
 cuts AS (SELECT movie, greatest(5e0, 4*1.4826e0*median(abs(d - mid))/sqrt(2e0)) AS cut FROM cok JOIN cm USING (movie) GROUP BY movie),
 {ENDS.format(t='track_number', src='cutrow')},
 st AS (SELECT p.movie, p.t AS t0, q.t AS t1, p.n AS n0, q.n AS n1, p.tz AS z0, q.hz AS z1 FROM en p JOIN en q ON p.movie = q.movie AND p.t <> q.t AND q.f0 - p.f1 BETWEEN 1 AND 12 AND (p.tx-q.hx)*(p.tx-q.hx) + (p.ty-q.hy)*(p.ty-q.hy) <= 9)
 SELECT DISTINCT e.movie, CAST(e.t AS INTEGER) AS track_number FROM en e JOIN st b ON b.movie = e.movie AND b.t1 = e.t JOIN st a ON a.movie = e.movie AND a.t0 = e.t JOIN cuts c ON c.movie = e.movie
 WHERE abs(b.z0 - a.z1) <= cut AND abs(e.hz - b.z0) > cut AND abs(e.tz - a.z1) > cut AND e.n < b.n0 + a.n1""")
def sandwiched_tracks(spark, sf):
    """Tracks cut in three pieces, the middle one of every third track 12 µm off."""
    f = F.col("frame_number")
    r = V.loc(spark, sf).withColumn("z", F.when(f.between(11, 19) & (F.col("track_number") % 3 == 0), F.col("zMicrons") + 12).otherwise(F.col("zMicrons")))
    r = r.withColumn("track_number", F.col("track_number") * 10 + F.when(f <= 10, 1).when(f <= 19, 2).otherwise(3))
    return C.sandwiched_tracks(r)


_SATELLITE = """m AS (SELECT movie, track_number, median(least(amplitude1, amplitude2)) AS s, count(*) AS n FROM loc GROUP BY ALL), r AS (SELECT loc.*, s, n FROM loc JOIN m USING (movie, track_number)),
 v AS (SELECT movie, track_number, n, count(*) AS votes FROM r a WHERE EXISTS (SELECT 1 FROM r b WHERE a.movie = b.movie AND a.frame_number = b.frame_number AND a.row_id <> b.row_id AND (a.xMean-b.xMean)*(a.xMean-b.xMean) + (a.yMean-b.yMean)*(a.yMean-b.yMean) <= {d2}
   AND b.s >= {bright} * a.s AND abs({turn}) <= {deg}) GROUP BY ALL)
 SELECT movie, track_number FROM v WHERE votes >= {frac} * n"""
_TURN = ax("a.angleDegrees", "b.angleDegrees")


@register("satellite_tracks", f"WITH {V.LOC}, {_SATELLITE.format(d2=900, bright='1.5e0', deg=40, frac='0.6e0', turn=_TURN)}")
def satellite_tracks(spark, sf):
    cfg = replace(DEFAULTS, satellite_distance_px=30.0, satellite_brightness_ratio=1.5, satellite_max_turn_deg=40.0, satellite_fraction=0.6)
    return C.satellite_tracks(V.loc(spark, sf), cfg)


_GHOST = """lb AS (SELECT movie, frame_number, track_number, row_id, least(amplitude1, amplitude2) AS amp, zMicrons AS z, 0 AS k, x1 AS x, y1 AS y FROM loc
   UNION ALL SELECT movie, frame_number, track_number, row_id, least(amplitude1, amplitude2), zMicrons, 1, x2, y2 FROM loc),
 c AS (SELECT a.movie, a.track_number, a.row_id, a.k, a.amp AS own, b.amp AS bamp, b.z AS bz, row_number() OVER (PARTITION BY a.row_id, a.k ORDER BY abs(a.frame_number - b.frame_number), b.frame_number, b.row_id) AS rn
   FROM lb a JOIN lb b ON a.movie = b.movie AND a.track_number <> b.track_number AND abs(a.frame_number - b.frame_number) <= 8 AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= {d2}),
 l AS (SELECT movie, track_number, row_id, count(*) AS k, min(own) AS own, avg(bamp) AS lend, avg(bz) AS lz FROM c WHERE rn = 1 GROUP BY ALL HAVING count(*) = 2),
 bo AS (SELECT movie, track_number, count(*) AS borrowed, median(own / greatest(lend, 1e-9)) AS dim, median(lz) AS lz FROM l GROUP BY ALL),
 o AS (SELECT movie, track_number, count(*) AS n, median(xMean) AS cx, median(yMean) AS cy, median(zMicrons) AS tz FROM loc GROUP BY ALL),
 cand AS (SELECT * FROM o JOIN bo USING (movie, track_number) WHERE borrowed >= {frac} * n),
 lo AS (SELECT a.movie, a.track_number, a.tz, a.lz, median(b.tz) AS local FROM cand a JOIN o b ON a.movie = b.movie AND a.track_number <> b.track_number AND b.tz IS NOT NULL AND (a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy) <= 22500 WHERE abs(a.tz - a.lz) > {dz} GROUP BY ALL)
 SELECT movie, track_number FROM cand WHERE dim <= 0.5e0 UNION SELECT movie, track_number FROM lo WHERE abs(tz - local) > abs(lz - local)"""


@register("ghost_tracks", f"WITH {V.LOC}, {_GHOST.format(d2=225, frac='0.3e0', dz=6)}")
def ghost_tracks(spark, sf):
    cfg = replace(DEFAULTS, ghost_lobe_px=15.0, ghost_fraction=0.3, ghost_z_um=6.0)
    return C.ghost_tracks(V.loc(spark, sf), cfg, "zMicrons")


@register("deduplicated_rows", f"""WITH RECURSIVE {V.LOC}, a AS (SELECT *, row_number() OVER (PARTITION BY movie, frame_number ORDER BY recovered, -minLobeSNR, row_id) AS i FROM loc),
 rv AS (SELECT x.movie, x.frame_number, x.i, x.row_id, coalesce(list(y.row_id) FILTER (y.row_id IS NOT NULL), []) AS rivals FROM a x LEFT JOIN a y ON x.movie = y.movie AND x.frame_number = y.frame_number AND y.i < x.i
   AND (x.xMean-y.xMean)*(x.xMean-y.xMean) + (x.yMean-y.yMean)*(x.yMean-y.yMean) <= 144 GROUP BY ALL),
 k AS (SELECT movie, frame_number, i, [row_id] AS kept FROM rv WHERE i = 1 UNION ALL
   SELECT k.movie, k.frame_number, r.i, CASE WHEN list_has_any(kept, rivals) THEN kept ELSE list_append(kept, r.row_id) END FROM k JOIN rv r ON k.movie = r.movie AND k.frame_number = r.frame_number AND r.i = k.i + 1)
 SELECT movie, unnest(kept) AS row_id FROM (SELECT movie, frame_number, arg_max(kept, i) AS kept FROM k GROUP BY ALL)""")
def deduplicated_rows(spark, sf):
    return C.deduplicate(V.loc(spark, sf), 12.0).select("movie", "row_id")


@register("ring_shadows", f"""WITH {V.LOC} SELECT movie, row_id FROM loc a WHERE EXISTS (SELECT 1 FROM loc o WHERE a.movie = o.movie AND a.frame_number = o.frame_number AND a.row_id <> o.row_id AND (a.xMean-o.xMean)*(a.xMean-o.xMean) + (a.yMean-o.yMean)*(a.yMean-o.yMean) <= 900
  AND greatest(a.amplitude1, a.amplitude2) <= 0.7e0 * least(o.amplitude1, o.amplitude2)
  AND least(greatest(sqrt(pow(a.x1-o.x1,2)+pow(a.y1-o.y1,2)), sqrt(pow(a.x2-o.x2,2)+pow(a.y2-o.y2,2))), greatest(sqrt(pow(a.x1-o.x2,2)+pow(a.y1-o.y2,2)), sqrt(pow(a.x2-o.x1,2)+pow(a.y2-o.y1,2)))) <= 30)""")
def ring_shadows(spark, sf):
    return C.ring_shadows(V.loc(spark, sf), replace(DEFAULTS, ring_shadow_px=30.0, ring_shadow_ratio=0.7))


@register("reused_lobes")
def reused_lobes(spark, sf):
    return C.reused_lobes(V.loc(spark, sf), F.lit(2.0), distance=8.0).select("movie", "row_id")


_SPLIT = f"""r0 AS (SELECT loc.*, CASE WHEN count(*) OVER (PARTITION BY movie, track_number) < 3 THEN 1 WHEN EXISTS (SELECT 1 FROM lowq w WHERE w.movie = loc.movie AND w.track_number = loc.track_number) THEN 2 END AS r FROM loc),
 gh AS (WITH loc AS (SELECT * FROM r0 WHERE r IS NULL), {_GHOST.format(d2=64, frac='0.6e0', dz=15)}),
 r1 AS (SELECT r0.* REPLACE (CASE WHEN r IS NULL AND EXISTS (SELECT 1 FROM gh WHERE gh.movie = r0.movie AND gh.track_number = r0.track_number) THEN 5 ELSE r END AS r) FROM r0),
 st AS (WITH loc AS (SELECT * FROM r1 WHERE r IS NULL), {_SATELLITE.format(d2=100, bright='3e0', deg=20, frac='0.8e0', turn=_TURN)}),
 fs AS (SELECT r1.* REPLACE (CASE WHEN r IS NULL AND EXISTS (SELECT 1 FROM st WHERE st.movie = r1.movie AND st.track_number = r1.track_number) THEN 3 ELSE r END AS r) FROM r1)"""
_FINAL = f"WITH {V.LOC}, {LOWQ.format(frac='0.25', score='0.6')}, {_SPLIT}"


@register("final_split", f"{_FINAL} SELECT movie, row_id, CAST(coalesce(r, 0) AS INTEGER) AS reject_reason FROM fs")
def final_split(spark, sf):
    """Every localization with the reason it is rejected for (0: kept)."""
    return C.final_split(V.loc(spark, sf)).select("movie", "row_id", F.coalesce("reject_reason", F.lit(0)).alias("reject_reason"))


@register("kept_tracks", f"""{_FINAL}, fi AS (SELECT movie, track_number, min(frame_number) AS f, arg_min(row_id, frame_number) AS i FROM fs WHERE r IS NULL GROUP BY ALL),
 nu AS (SELECT movie, track_number, CAST(row_number() OVER (PARTITION BY movie ORDER BY f, i) AS INTEGER) AS n FROM fi) SELECT fs.movie, row_id, n AS track_number FROM fs JOIN nu USING (movie, track_number) WHERE r IS NULL""")
def kept_tracks(spark, sf):
    kept, _ = C.split_and_renumber(V.loc(spark, sf))
    return kept.select("movie", "row_id", "track_number")


_B = "last_value({c} IGNORE NULLS) OVER (PARTITION BY movie, track_number ORDER BY frame_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b{c}"
_A = "first_value({c} IGNORE NULLS) OVER (PARTITION BY movie, track_number ORDER BY frame_number ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a{c}"
_C = ["of", "x1", "y1", "x2", "y2", "xMean", "yMean"]


def _dist(i: int, j: int) -> str:
    return f"sqrt((bx{i}-ax{j})*(bx{i}-ax{j}) + (by{i}-ay{j})*(by{i}-ay{j}))"


_PREDICTED = f"""t AS (SELECT movie, track_number, count(*) AS n, min(frame_number) AS f0, max(frame_number) AS f1 FROM loc GROUP BY ALL HAVING count(*) >= 3),
 mx AS (SELECT movie, max(frame_number) AS last FROM loc GROUP BY movie),
 grid AS (SELECT movie, track_number, CAST(unnest(range(greatest(1, f0 - 8), least(last, f1 + 8) + 1)) AS INTEGER) AS frame_number FROM t JOIN mx USING (movie)),
 j AS (SELECT grid.*, l.frame_number AS of, x1, y1, x2, y2, xMean, yMean FROM grid LEFT JOIN loc l USING (movie, track_number, frame_number)),
 w AS (SELECT movie, track_number, frame_number, of, {', '.join(_B.format(c=c) for c in _C)}, {', '.join(_A.format(c=c) for c in _C)} FROM j),
 m AS (SELECT * FROM w WHERE of IS NULL AND least(coalesce(frame_number - bof, 1000000), coalesce(aof - frame_number, 1000000)) <= 8),
 inn AS (SELECT movie, track_number, frame_number, (frame_number - bof) / CAST(aof - bof AS DOUBLE) AS w, {_dist(1, 1)} + {_dist(2, 2)} <= {_dist(1, 2)} + {_dist(2, 1)} AS ok, * EXCLUDE (movie, track_number, frame_number) FROM m WHERE bof IS NOT NULL AND aof IS NOT NULL),
 out_ AS (SELECT movie, track_number, frame_number, coalesce(bof, aof) AS g, coalesce(bx1, ax1) AS x1, coalesce(by1, ay1) AS y1, coalesce(bx2, ax2) AS x2, coalesce(by2, ay2) AS y2, coalesce(bxMean, axMean) AS px, coalesce(byMean, ayMean) AS py FROM m WHERE bof IS NULL OR aof IS NULL),
 mo AS (SELECT o.movie, o.track_number, o.frame_number, p.track_number AS t2, q.xMean - p.xMean AS mx, q.yMean - p.yMean AS my, sqrt((px-p.xMean)*(px-p.xMean) + (py-p.yMean)*(py-p.yMean)) AS d FROM out_ o JOIN loc p ON p.movie = o.movie AND p.frame_number = g JOIN loc q ON q.movie = o.movie AND q.track_number = p.track_number AND q.frame_number = o.frame_number),
 ra AS (SELECT *, count(*) FILTER (d <= 200) OVER (PARTITION BY movie, track_number, frame_number) AS k, row_number() OVER (PARTITION BY movie, track_number, frame_number ORDER BY d, t2) AS rn FROM mo),
 sh AS (SELECT movie, track_number, frame_number, median(mx) AS sx, median(my) AS sy FROM ra WHERE CASE WHEN k >= 3 THEN d <= 200 ELSE rn <= 5 END GROUP BY ALL),
 allp AS (SELECT movie, track_number, frame_number, (1-w)*bx1 + w*CASE WHEN ok THEN ax1 ELSE ax2 END AS x1, (1-w)*by1 + w*CASE WHEN ok THEN ay1 ELSE ay2 END AS y1, (1-w)*bx2 + w*CASE WHEN ok THEN ax2 ELSE ax1 END AS x2, (1-w)*by2 + w*CASE WHEN ok THEN ay2 ELSE ay1 END AS y2 FROM inn
  UNION ALL SELECT movie, track_number, frame_number, x1 + coalesce(sx, 0), y1 + coalesce(sy, 0), x2 + coalesce(sx, 0), y2 + coalesce(sy, 0) FROM out_ LEFT JOIN sh USING (movie, track_number, frame_number)),
 ref AS (SELECT movie, track_number, coalesce(median(least(amplitude1, amplitude2)) FILTER (recovered <> 1), median(least(amplitude1, amplitude2))) AS reference FROM loc GROUP BY ALL)"""


@register("missing_predictions", f"""WITH {V.LOC}, {_PREDICTED}
 SELECT movie, track_number, frame_number, {R('x1')} AS x1, {R('y1')} AS y1, {R('x2')} AS x2, {R('y2')} AS y2, {R('reference')} AS reference FROM allp JOIN ref USING (movie, track_number)""")
def missing_predictions(spark, sf):
    return rounded(Y.recovery_requests(V.loc(spark, sf)), "x1", "y1", "x2", "y2", "reference")


def _peaks(spark, sf):
    """Lobes of the localizations, a little off, as the peaks of their frames."""
    return V.lobes(spark, sf).select("movie", F.col("frame_number").alias("frame"), F.lit(262).alias("height"), F.lit(262).alias("width"), F.lit(5.0).alias("noise"), F.lit(200.0).alias("strong"),
                                     (F.col("x") + (F.col("lobe_id") % 11) / F.lit(2.3) - 3).alias("x"), (F.col("y") + (F.col("lobe_id") % 7) / F.lit(1.7) - 3).alias("y"), F.col("amp").alias("value"))


@register("refit_windows", f"""WITH {V.LOC}, {V.LOBES}, {_PREDICTED},
 q AS (SELECT movie, track_number, frame_number, x1 - 1 AS px, y1 - 1 AS py, x2 - 1 AS qx, y2 - 1 AS qy, greatest(floor(least(x1, x2) - 10), 0) AS wx0, greatest(floor(least(y1, y2) - 10), 0) AS wy0,
   least(ceil(greatest(x1, x2) + 8), 261) AS wx1, least(ceil(greatest(y1, y2) + 8), 261) AS wy1 FROM allp WHERE EXISTS (SELECT 1 FROM loc WHERE loc.movie = allp.movie AND loc.frame_number = allp.frame_number)),
 rw AS (SELECT * FROM q WHERE wx1 - wx0 >= 4 AND wy1 - wy0 >= 4),
 sp AS (SELECT movie, frame_number, 0 AS kind, x - 1 AS x, y - 1 AS y FROM lobes UNION ALL SELECT movie, frame_number, 1, x + (lobe_id % 11)/2.3e0 - 3, y + (lobe_id % 7)/1.7e0 - 3 FROM lobes WHERE amp >= 200*0.55e0*1.5),
 i AS (SELECT DISTINCT rw.*, kind, s.x, s.y FROM rw JOIN sp s ON rw.movie = s.movie AND rw.frame_number = s.frame_number AND s.x BETWEEN wx0 AND wx1 AND s.y BETWEEN wy0 AND wy1),
 n AS (SELECT *, (px-x)*(px-x) + (py-y)*(py-y) <= 9 AS np, (qx-x)*(qx-x) + (qy-y)*(qy-y) <= 9 AS nq FROM i),
 l AS (SELECT movie, track_number, frame_number, bool_or(np) AS shared1, bool_or(nq) AS shared2, count(*) FILTER (NOT np AND NOT nq) AS lobes FROM n WHERE kind = 0 GROUP BY ALL),
 k AS (SELECT movie, track_number, frame_number, count(*) AS peaks FROM n WHERE kind = 1 AND NOT np AND NOT nq AND NOT EXISTS (SELECT 1 FROM n o WHERE o.kind = 0 AND NOT o.np AND NOT o.nq AND o.movie = n.movie
   AND o.track_number = n.track_number AND o.frame_number = n.frame_number AND (o.x-n.x)*(o.x-n.x) + (o.y-n.y)*(o.y-n.y) <= 9) GROUP BY ALL)
 SELECT movie, track_number, frame_number, CAST(wx0 AS BIGINT) AS wx0, CAST(wy0 AS BIGINT) AS wy0, CAST(wx1 AS BIGINT) AS wx1, CAST(wy1 AS BIGINT) AS wy1, coalesce(shared1, false) AS shared1, coalesce(shared2, false) AS shared2,
   CAST(2 + coalesce(lobes, 0) + coalesce(peaks, 0) AS INTEGER) AS seeds FROM rw LEFT JOIN l USING (movie, track_number, frame_number) LEFT JOIN k USING (movie, track_number, frame_number)
 WHERE NOT (coalesce(shared1, false) AND coalesce(shared2, false)) AND 2 + coalesce(lobes, 0) + coalesce(peaks, 0) <= 48""")
def refit_windows(spark, sf):
    """Where the frames a track is missing are fitted again, and with how many seeds."""
    r = V.loc(spark, sf)
    w = Y.refit_windows(Y.recovery_requests(r), r, _peaks(spark, sf))
    return w.select("movie", "track_number", "frame_number", "wx0", "wy0", "wx1", "wy1", "shared1", "shared2", F.size("seeds").alias("seeds"))


@register("accepted_refits", f"""WITH {V.LOC}, ref AS (SELECT movie, track_number, coalesce(median(least(amplitude1, amplitude2)) FILTER (recovered <> 1), median(least(amplitude1, amplitude2))) AS reference FROM loc GROUP BY ALL),
 f AS (SELECT loc.*, reference, angleDegrees + (row_id * 7 % 41) - 20 AS p, (row_id % 60) / 2e0 AS cost, 4e0 + row_id % 9 AS noise FROM loc JOIN ref USING (movie, track_number) WHERE row_id % 3 = 0)
 SELECT movie, row_id FROM f WHERE least(amplitude1, amplitude2) >= greatest(noise * 3, reference * 0.35e0, CASE WHEN sharedLobe = 1 THEN noise * 15 ELSE 0 END) AND abs({ax('angleDegrees', 'p')}) <= 15 AND cost <= 25
  AND least(x1, x2, y1, y2) >= 1 AND greatest(x1, x2, y1, y2) <= 262
  AND NOT EXISTS (SELECT 1 FROM loc e WHERE e.row_id % 3 <> 0 AND e.movie = f.movie AND e.frame_number = f.frame_number AND (e.xMean-f.xMean)*(e.xMean-f.xMean) + (e.yMean-f.yMean)*(e.yMean-f.yMean) < 16)""")
def accepted_refits(spark, sf):
    """Which rows of a frame would be accepted as refits beside the others."""
    r, e = V.loc(spark, sf), F.col("row_id")
    fits = r.where("row_id % 3 = 0").join(Y.reference_amplitude(r), ["movie", "track_number"]).withColumns({
        "predicted_angle": F.col("angleDegrees") + e * 7 % 41 - 20, "pairCost": (e % 60) / F.lit(2.0), "noise": F.lit(4.0) + e % 9, "height": F.lit(262), "width": F.lit(262)})
    return Y.accept_recovered(fits, r.where("row_id % 3 <> 0"), F.col("noise")).select("movie", "row_id")


@register("not_removed_before", f"""WITH {V.LOC}, add_ AS (SELECT * FROM loc WHERE row_id % 4 = 0), gone AS (SELECT row_id, movie, frame_number, xMean + (row_id % 9)/10.7e0 AS x, yMean AS y, angleDegrees + (row_id % 5) AS a FROM loc WHERE row_id % 3 = 0),
 n AS (SELECT a.row_id, arg_min(abs({ax('a.angleDegrees', 'g.a')}), (a.xMean-g.x)*(a.xMean-g.x) + (a.yMean-g.y)*(a.yMean-g.y)) AS turn FROM add_ a JOIN gone g ON a.movie = g.movie AND a.frame_number = g.frame_number AND (a.xMean-g.x)*(a.xMean-g.x) + (a.yMean-g.y)*(a.yMean-g.y) < 1 GROUP BY a.row_id)
 SELECT row_id FROM add_ WHERE row_id NOT IN (SELECT row_id FROM n WHERE turn < 3)""")
def not_removed_before(spark, sf):
    r = V.loc(spark, sf)
    gone = r.where("row_id % 3 = 0").withColumns({"xMean": F.col("xMean") + (F.col("row_id") % 9) / F.lit(10.7), "angleDegrees": F.col("angleDegrees") + F.col("row_id") % 5})
    return Y.not_removed_before(r.where("row_id % 4 = 0"), gone).select("row_id")


SPLIT = "CASE WHEN track_number % 5 = 0 THEN 1 WHEN track_number % 5 = 1 AND row_id % 3 = 0 THEN 4 END"


def _split(spark, sf):
    """(kept, rejected, removed) by track and row numbers."""
    r = V.loc(spark, sf).withColumn("reject_reason", F.expr(SPLIT))
    return r.where("reject_reason IS NULL").drop("reject_reason"), r.where("reject_reason = 1"), r.where("reject_reason = 4").drop("reject_reason")


@register("rejected_table", f"WITH {V.LOC} SELECT movie, row_id, track_number, {SPLIT} AS reject_reason FROM loc WHERE {SPLIT} IS NOT NULL")
def rejected_table(spark, sf):
    """Rows of rejected tracks and rows removed while recovering, with their reasons."""
    _, rejected, removed = _split(spark, sf)
    return C.all_rejected(rejected, removed).select("movie", "row_id", "track_number", "reject_reason")


@register("retracking_rows", f"WITH {V.LOC} SELECT movie, row_id, frame_number, {R('xMean')} AS xMean FROM loc WHERE coalesce({SPLIT}, 0) <> 4")
def retracking_rows(spark, sf):
    """What a second tracker starts from: kept and rejected rows, none of the removed ones."""
    kept, rejected, removed = _split(spark, sf)
    return rounded(C.for_retracking(kept, C.all_rejected(rejected, removed)).select("movie", "row_id", "frame_number", "xMean"), "xMean")
