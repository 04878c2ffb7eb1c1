"""Motion queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from moteflow.catalog import views as V
from moteflow.catalog.registry import R, register, rounded
from moteflow.operators import motion as M
from moteflow.schema import MOTION_CODES

PX = 0.325

SERIES = f"""elig AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY movie, track_number) AS n, min(frame_number) OVER (PARTITION BY movie, track_number) AS f0 FROM loc WHERE zMicrons IS NOT NULL) WHERE n >= 10),
ser AS (SELECT movie, track_number, frame_number - f0 AS t, xMean*{PX}e0 AS x, yMean*{PX}e0 AS y, zMicrons AS z,
  pow(coalesce(CASE WHEN xPrecisionPx > 0 THEN xPrecisionPx*{PX}e0 END, median(xPrecisionPx*{PX}e0) OVER (PARTITION BY movie, track_number), 0.1e0), 2) AS vx, pow(yPrecisionPx*{PX}e0, 2) AS vy, pow(zPrecisionUm, 2) AS vz FROM elig),
obs AS (SELECT g.movie, g.track_number, CAST(g.t AS BIGINT) AS t, x, y, z, vx, vy, vz, ser.t IS NOT NULL AS present FROM (SELECT movie, track_number, unnest(range(0, tmax + 1)) AS t FROM (SELECT movie, track_number, max(t) AS tmax FROM ser GROUP BY ALL)) g LEFT JOIN ser ON g.movie = ser.movie AND g.track_number = ser.track_number AND g.t = ser.t)"""


def _recursion(a: float, b: float, q00: float, q11: float, conf: float, p11: float) -> str:
    """The filter of all three axes, one frame per recursion step."""
    ax = "xyz"
    a, b, q00, q11, conf, p11 = (f"CAST({v!r} AS DOUBLE)" for v in (a, b, q00, q11, conf, p11))
    init = ", ".join(f"{c} AS m0{c}, {c} * {conf} AS m1{c}, v{c} AS p00{c}, 0e0 AS p01{c}, {p11} AS p11{c}" for c in ax)
    pred = ", ".join(f"{a}*m0{c} + {b}*m1{c} AS n0{c}, m1{c} AS n1{c}, {a}*{a}*p00{c} + 2*{a}*{b}*p01{c} + {b}*{b}*p11{c} + {q00} AS n00{c}, {a}*p01{c} + {b}*p11{c} AS n01{c}, p11{c} + {q11} AS n11{c}" for c in ax)
    upd = ", ".join(f"CASE WHEN present THEN n0{c} + n00{c}/(n00{c}+v{c})*({c}-n0{c}) ELSE n0{c} END, CASE WHEN present THEN n1{c} + n01{c}/(n00{c}+v{c})*({c}-n0{c}) ELSE n1{c} END, "
                    f"CASE WHEN present THEN n00{c}*(1 - n00{c}/(n00{c}+v{c})) ELSE n00{c} END, CASE WHEN present THEN n01{c}*(1 - n00{c}/(n00{c}+v{c})) ELSE n01{c} END, "
                    f"CASE WHEN present THEN n11{c} - n01{c}/(n00{c}+v{c})*n01{c} ELSE n11{c} END" for c in ax)
    gain = " + ".join(f"ln(n00{c}+v{c}) + ({c}-n0{c})*({c}-n0{c})/(n00{c}+v{c}) + ln(2*pi())" for c in ax)
    return f"""kf AS (SELECT movie, track_number, t, {init}, 0e0 AS ll FROM obs WHERE t = 0 UNION ALL
  SELECT movie, track_number, t, {upd}, ll + CASE WHEN present THEN {gain} ELSE 0e0 END FROM (SELECT o.*, kf.ll, {pred} FROM kf JOIN obs o ON o.movie = kf.movie AND o.track_number = kf.track_number AND o.t = kf.t + 1))
SELECT movie, track_number, {R('-0.5e0 * max_by(ll, t)', 4)} AS ll FROM kf GROUP BY movie, track_number"""


for _m, _p in (("brownian", dict(d=0.2)), ("directed", dict(d=0.1, q=0.02, v=0.05)), ("confined", dict(d=0.15, l=0.3, q=0.01))):
    from moteflow.plans.filters_np import linear as _linear
    @register(f"filter_loglik_{_m}", f"WITH RECURSIVE {V.LOC}, {SERIES}, {_recursion(*[float(v[0]) for v in _linear(_m, **_p)])}")
    def filter_loglik(spark, sf, m=_m, p=_p):
        return M.track_loglik(M.track_series(V.loc(spark, sf), PX), m, **p).withColumn("ll", F.round("ll", 4))


@register("track_series", f"WITH {V.LOC}, {SERIES} SELECT movie, track_number, count(*) AS n, {R('avg(x)')} AS x, {R('avg(vx)')} AS vx, CAST(max(t) AS INTEGER) AS last_t FROM ser GROUP BY ALL")
def track_series(spark, sf):
    s = M.track_series(V.loc(spark, sf), PX).select("movie", "track_number", F.inline("obs"))
    return rounded(s.groupBy("movie", "track_number").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("vx").alias("vx"), F.max("t").alias("last_t")), "x", "vx")


@register("motion_class")
def motion_class(spark, sf):
    """Fits of the three motion models and the class of every track."""
    c = M.classify(M.fit_single_models(M.track_series(V.loc(spark, sf), PX)))
    return c.select("movie", "track_number", "motion_class", *[F.round(n, 3).alias(n) for n in ("ll_brownian", "ll_confined", "ll_directed")])


@register("motion_analysis")
def motion_analysis(spark, sf):
    """The whole motion analysis: one row per track."""
    tracks, _, _ = M.analyse(V.loc(spark, sf), PX)
    return tracks


@register("motion_states")
def motion_states(spark, sf):
    """P(moving), velocity and refined position per localization."""
    _, states, _ = M.analyse(V.loc(spark, sf), PX)
    return states


LL = """ll0 AS (SELECT movie, track_number, -avg(abs(zMicrons - 3)) AS b, avg(lobeSeparationPixels)/100 AS l, avg(minLobeSNR)/100 AS dc FROM loc GROUP BY movie, track_number),
ll AS (SELECT *, b + (track_number % 11) - 3e0 AS c, b + (track_number % 7) - 2e0 AS d FROM ll0)"""


@register("likelihood_classes", f"""WITH {V.LOC}, {LL} SELECT movie, track_number, CASE WHEN b - d < ln(0.05e0) AND d >= c THEN 'directed' WHEN b - c < ln(0.05e0) THEN 'confined' WHEN b - d < ln(0.05e0) THEN 'directed' ELSE 'brownian' END AS motion_class,
 {R('exp(b - c)')} AS rho_confined, {R('dc*(1-l)/sqrt(1-(1-l)*(1-l))')} AS confinement_sd, {R('dc*dc/2/0.005e0')} AS D FROM ll""")
def likelihood_classes(spark, sf):
    """The class rule, cage size and diffusion coefficient on given likelihoods."""
    b = -F.avg(F.abs(F.col("zMicrons") - 3))
    f = V.loc(spark, sf).groupBy("movie", "track_number").agg(b.alias("ll_brownian"), (F.avg("lobeSeparationPixels") / 100).alias("l"), (F.avg("minLobeSNR") / 100).alias("dc"))
    f = f.withColumns({"ll_confined": F.col("ll_brownian") + F.col("track_number") % 11 - 3.0, "ll_directed": F.col("ll_brownian") + F.col("track_number") % 7 - 2.0})
    l, d = F.col("l"), F.col("dc")
    out = M.classify(f).select("movie", "track_number", "motion_class", "rho_confined", M.confinement_sd(d, l).alias("confinement_sd"), M.diffusion(d, F.lit(0.005)).alias("D"))
    return rounded(out, "rho_confined", "confinement_sd", "D")


@register("moving_episodes", f"""WITH {V.LOC}, p AS (SELECT movie, track_number, frame_number, (row_id * 37 % 101)/100e0 AS pm FROM loc),
 t AS (SELECT movie, track_number, count(*) FILTER (pm > 0.5) AS frames_moving, coalesce(min(frame_number) FILTER (pm > 0.5), -1) AS moving_from, coalesce(max(frame_number) FILTER (pm > 0.5), -1) AS moving_to FROM p GROUP BY ALL)
 SELECT movie, track_number, frames_moving, moving_from, moving_to FROM t""")
def moving_episodes(spark, sf):
    p = V.loc(spark, sf).withColumn("p_moving", (F.col("row_id") * 37 % 101) / F.lit(100.0))
    return p.groupBy("movie", "track_number").agg(*M.moving_columns())


@register("moving_share_per_frame", f"""WITH {V.LOC} SELECT movie, frame_number, {R('avg(CASE WHEN (row_id * 37 % 101)/100e0 > 0.5 THEN 1e0 ELSE 0e0 END)')} AS share FROM loc GROUP BY ALL""")
def moving_share_per_frame(spark, sf):
    p = V.loc(spark, sf).withColumn("p_moving", (F.col("row_id") * 37 % 101) / F.lit(100.0))
    return rounded(M.share_moving(p, ["movie", "frame_number"]).withColumnRenamed("share_moving", "share"), "share")


@register("quantile_caps", f"""WITH {V.LOC}, t AS (SELECT movie, track_number, median(xPrecisionPx) AS d, CASE WHEN track_number % 9 = 0 THEN 'brownian' ELSE 'directed' END AS cls FROM loc GROUP BY ALL)
 SELECT movie, {R('CASE WHEN count(*) FILTER (cls = $$brownian$$) >= 5 THEN median(d) FILTER (cls = $$brownian$$) ELSE median(d) END')} AS d_max, {R('CASE WHEN count(*) FILTER (cls = $$directed$$) >= 5 THEN quantile_cont(d, 0.9) FILTER (cls = $$directed$$) ELSE quantile_cont(d, 0.9) END')} AS q_max FROM t GROUP BY movie""")
def quantile_caps(spark, sf):
    """Bounds on step size and velocity change from the tracks of one class (all tracks when fewer than 5)."""
    t = V.loc(spark, sf).groupBy("movie", "track_number").agg(F.median("xPrecisionPx").alias("d"))
    t = t.withColumn("cls", F.when(F.col("track_number") % 9 == 0, "brownian").otherwise("directed"))
    b, r = F.col("cls") == "brownian", F.col("cls") == "directed"
    pick = lambda c, p: F.when(F.count_if(c) >= 5, F.percentile(F.when(c, F.col("d")), F.lit(p))).otherwise(F.percentile("d", F.lit(p)))
    return rounded(t.groupBy("movie").agg(pick(b, 0.5).alias("d_max"), pick(r, 0.9).alias("q_max")), "d_max", "q_max")


@register("attached_motion", f"""WITH {V.LOC}, tr AS (SELECT movie, track_number, CASE track_number % 4 WHEN 0 THEN 'brownian' WHEN 1 THEN 'confined' WHEN 2 THEN 'directed' ELSE 'unknown' END AS cls, count(*) AS n FROM loc GROUP BY ALL),
 st AS (SELECT movie, track_number, frame_number, (row_id * 37 % 101)/100e0 AS p_moving FROM loc WHERE row_id % 6 <> 0)
 SELECT row_id, p_moving, CAST(CASE cls WHEN 'brownian' THEN 0 WHEN 'confined' THEN 1 WHEN 'directed' THEN 2 END AS DOUBLE) AS motionClass, n AS framesMoving FROM loc LEFT JOIN st USING (movie, track_number, frame_number) LEFT JOIN tr USING (movie, track_number)""")
def attached_motion(spark, sf):
    r = V.loc(spark, sf)
    k = F.col("track_number") % 4
    tracks = r.groupBy("movie", "track_number").agg(F.count("*").alias("frames_moving")).withColumns(
        {"motion_class": F.when(k == 0, "brownian").when(k == 1, "confined").when(k == 2, "directed").otherwise("unknown"), "speed_while_moving": F.lit(0.0), "D": F.lit(0.0)})
    states = r.where("row_id % 6 <> 0").select("movie", "track_number", "frame_number", ((F.col("row_id") * 37 % 101) / F.lit(100.0)).alias("p_moving"))
    return M.attach_motion(r, tracks, states, MOTION_CODES).select("row_id", "p_moving", F.col("motionClass").cast("double").alias("motionClass"), "framesMoving")
