"""Queries of exports and of what recordings suggest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from moteflow.catalog import views as V
from moteflow.catalog.registry import R, register, rounded
from moteflow.session import checkpoint_dir
from moteflow.settings import DIM_OVERRIDES, DIM_SNR
from moteflow.sources import exports as E


@register("suggested_planes", """WITH p AS (SELECT p_partkey, CAST(p_size * 7 AS INTEGER) AS n, CASE p_partkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 40 END AS o, 0.5e0 + (p_partkey % 5) * 0.25e0 AS s FROM part),
 h AS (SELECT *, CASE WHEN o = 10 THEN ceil(80e0 / s) END AS h, (n + 1) / 2e0 AS m FROM p)
 SELECT p_partkey, CAST(CASE WHEN h IS NULL THEN 1 ELSE greatest(1, floor(m - h)) END AS INTEGER) AS first, CAST(CASE WHEN h IS NULL THEN n ELSE least(n, ceil(m + h)) END AS INTEGER) AS last FROM h""")
def suggested_planes(spark, sf):
    k = F.col("p_partkey")
    p = V.table(spark, sf, "part").select(k, (F.col("p_size") * 7).cast("int").alias("n"), F.when(k % 4 == 0, 10).when(k % 4 == 1, 20).when(k % 4 == 2, 40).alias("o"), (F.lit(0.5) + (k % 5) * F.lit(0.25)).alias("s"))
    return p.select("p_partkey", E.suggested_planes(F.col("n"), F.col("o"), F.col("s")).alias("r")).select("p_partkey", "r.first", "r.last")


@register("sidecar_fields", r"""WITH t AS (SELECT page_id, '{ "Interval_ms": 0, "x": 1 } { "Interval_ms" : ' || CAST(page_id % 9 AS VARCHAR) || '.5, "ROI": "' || CAST(page_id % 300 AS VARCHAR) || '-' || CAST(page_id % 7 AS VARCHAR) || '-64-' || CASE WHEN page_id % 5 = 0 THEN 'x' ELSE '32' END || '" } ' || url AS s FROM pages)
 SELECT page_id, TRY_CAST(page_id % 9 || '.5' AS DOUBLE) AS interval_ms, CASE WHEN page_id % 5 <> 0 THEN CAST(page_id % 300 AS VARCHAR) || ',' || CAST(page_id % 7 AS VARCHAR) || ',64,32' END AS roi FROM t""")
def sidecar_fields(spark, sf):
    """Frame interval and camera region out of metadata texts built on page addresses."""
    k = F.col("page_id")
    text = F.concat(F.lit('{ "Interval_ms": 0, "x": 1 } { "Interval_ms" : '), (k % 9).cast("string"), F.lit('.5, "ROI": "'), (k % 300).cast("string"), F.lit("-"), (k % 7).cast("string"), F.lit("-64-"),
                    F.when(k % 5 == 0, "x").otherwise("32"), F.lit('" } '), F.col("url"))
    out = V.table(spark, sf, "pages").select("page_id", E.sidecar_fields(text).alias("f"))
    return out.select("page_id", "f.interval_ms", F.when(F.col("f.roi").isNotNull(), F.array_join("f.roi", ",")).alias("roi"))


_DIM = " UNION ALL ".join(f"SELECT movie, '{k}' AS key, '{v}' AS value, 1 AS priority FROM c WHERE s < {DIM_SNR * 4}e0" for k, v in DIM_OVERRIDES.items())


@register("dim_overrides", f"WITH {V.LOC}, c AS (SELECT movie, median(minLobeSNR) AS s FROM loc WHERE frame_number IN (1, 8, 15) GROUP BY movie) {_DIM}")
def dim_overrides(spark, sf):
    """Settings for movies whose median signal over three frames, a quarter of it here, is low."""
    c = V.loc(spark, sf).where("frame_number IN (1, 8, 15)").groupBy("movie").agg((F.median("minLobeSNR") / 4).alias("median_snr"))
    return E.dim_overrides(c, 1)


@register("refined_maxima", f"""WITH {V.PIXELS}, q AS (SELECT c.movie, c.frame, c.x, c.y, c.v AS c, l.v AS l, r.v AS r, u.v AS u, d.v AS d FROM pixels c LEFT JOIN pixels l ON l.movie = c.movie AND l.frame = c.frame AND l.y = c.y AND l.x = c.x - 1
   LEFT JOIN pixels r ON r.movie = c.movie AND r.frame = c.frame AND r.y = c.y AND r.x = c.x + 1 LEFT JOIN pixels u ON u.movie = c.movie AND u.frame = c.frame AND u.x = c.x AND u.y = c.y - 1
   LEFT JOIN pixels d ON d.movie = c.movie AND d.frame = c.frame AND d.x = c.x AND d.y = c.y + 1 WHERE c.v > 106)
 SELECT movie, frame, x, y, {R('x + CASE WHEN l IS NOT NULL AND r IS NOT NULL AND u IS NOT NULL AND d IS NOT NULL AND l - 2*c + r < 0 THEN greatest(-0.5, least(0.5, (l - r)/(2*(l - 2*c + r)))) ELSE 0 END')} AS fx,
  {R('y + CASE WHEN l IS NOT NULL AND r IS NOT NULL AND u IS NOT NULL AND d IS NOT NULL AND u - 2*c + d < 0 THEN greatest(-0.5, least(0.5, (u - d)/(2*(u - 2*c + d)))) ELSE 0 END')} AS fy FROM q""")
def refined_maxima(spark, sf):
    """Bright pixels of the frames moved to the vertex of the parabola through their neighbours."""
    px = V.pixels(spark, sf)
    return rounded(E.refined_maxima(px.where("v > 106").select("movie", "frame", "x", "y"), px), "fx", "fy")


@register("movie_summaries", f"""WITH {V.LOC} SELECT movie, count(*) AS localizations, count(DISTINCT track_number) AS tracks, max(frame_number) AS frames, count(*) FILTER (zStatus = 0) AS z_ok, count(*) FILTER (zStatus = 3) AS z_told_apart,
  count(*) FILTER (recovered = 1) AS recovered, count(*) FILTER (track_number % 5 = 0) AS short, count(*) FILTER (track_number % 5 = 1 AND row_id % 3 = 0) AS removed, {R('avg(least(amplitude1, amplitude2))')} AS mean_amplitude FROM loc GROUP BY movie""")
def movie_summaries(spark, sf):
    """Summaries as they are read back from the written records."""
    r = V.loc(spark, sf)
    bad = r.withColumn("reject_reason", F.expr("CASE WHEN track_number % 5 = 0 THEN 1 WHEN track_number % 5 = 1 AND row_id % 3 = 0 THEN 4 END")).where("reject_reason IS NOT NULL")
    motion = r.groupBy("movie").agg(F.avg(F.least("amplitude1", "amplitude2")).alias("mean_amplitude"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/summaries/{uuid.uuid4().hex}"
    E.write_summaries(r, bad, path, motion)
    s = spark.read.json(path)
    count = lambda c, name: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(name)
    return rounded(s.select("movie", "localizations", "tracks", F.col("frames").cast("int").alias("frames"), F.col("z_status.0").alias("z_ok"), F.col("z_status.3").alias("z_told_apart"), "recovered",
                            count("rejected.1", "short"), count("rejected.4", "removed"), F.col("motion.mean_amplitude").alias("mean_amplitude")), "mean_amplitude")


@register("field_grid_faults", """WITH f AS (SELECT 'f' || CAST(l_suppkey % 7 AS VARCHAR) AS movie, CAST(l_linenumber AS INTEGER) AS frame_number, CAST(l_quantity AS DOUBLE) AS x, CAST(l_partkey % 97 AS DOUBLE) AS y FROM lineitem GROUP BY ALL),
 g AS (SELECT movie, count(DISTINCT x) * count(DISTINCT y) AS expected FROM f GROUP BY movie), p AS (SELECT movie, frame_number, count(*) AS nodes FROM f GROUP BY ALL)
 SELECT movie, frame_number, nodes, expected, CAST(0 AS BIGINT) AS repeated FROM p JOIN g USING (movie) WHERE nodes <> expected""")
def field_grid_faults(spark, sf):
    """Frames of line items, seen as grid nodes, that lack a node of their movie's grid."""
    f = V.table(spark, sf, "lineitem").select(F.concat(F.lit("f"), (F.col("l_suppkey") % 7).cast("string")).alias("movie"), F.col("l_linenumber").cast("int").alias("frame_number"),
                                                                          F.col("l_quantity").cast("double").alias("x_um"), (F.col("l_partkey") % 97).cast("double").alias("y_um")).distinct()
    return E.grid_faults(f)
