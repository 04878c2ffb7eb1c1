"""Source, catalogue and export queries on the star schema, pages and events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from moteflow.catalog import views as V
from moteflow.catalog.drift import DRIFT
from moteflow.catalog.pairs import LATERAL_COEF
from moteflow.catalog.registry import R, register, rounded
from moteflow.operators import drift as D
from moteflow.plans.number import next_in_order
from moteflow.session import checkpoint_dir, cut
from moteflow.sources import parts, tables as S


@register("lenient_cast", """WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' ' || CAST(value AS VARCHAR) || ' ' WHEN 1 THEN 'Yes' WHEN 2 THEN 'FALSE' WHEN 3 THEN '' WHEN 4 THEN event_type ELSE 'nan' END AS s FROM events)
 SELECT event_id, CASE WHEN lower(trim(s)) IN ('true', 'yes') THEN 1e0 WHEN lower(trim(s)) IN ('false', 'no') THEN 0e0 WHEN lower(trim(s)) = 'nan' THEN NULL ELSE TRY_CAST(trim(s) AS DOUBLE) END AS v FROM t""")
def lenient_cast(spark, sf):
    k, e = F.col("event_id") % 6, V.table(spark, sf, "events")
    s = F.when(k == 0, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))).when(k == 1, "Yes").when(k == 2, "FALSE").when(k == 3, "").when(k == 4, F.col("event_type")).otherwise("nan")
    return e.select("event_id", S.lenient_double(s).alias("v"))


RUNS = """runs AS (SELECT l_orderkey AS run, max(l_shipdate) AS mtime, count(DISTINCT 'movie' || l_linenumber) AS movies, bool_and(l_returnflag <> 'R') AS outputs FROM lineitem GROUP BY 1),
cat AS (SELECT run, mtime, movies, coalesce(CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'running' WHEN 'P' THEN 'failed' END, 'unknown') AS state, outputs FROM runs LEFT JOIN orders ON o_orderkey = run)"""


def catalogue(spark, sf):
    """Orders as runs: line items are their movies, a returned item lacks its output."""
    li = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_shipdate").alias("mtime"), F.concat(F.lit("movie"), F.col("l_linenumber")).alias("movie"),
                                               (F.col("l_returnflag") != "R").alias("has_output"))
    s = F.col("o_orderstatus")
    st = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.when(s == "F", "finished").when(s == "O", "running").when(s == "P", "failed").alias("state"))
    return S.run_catalogue(li, st)


@register("run_catalogue", f"WITH {RUNS} SELECT run, mtime, movies AS n_movies, state, outputs AND state <> 'failed' AND state <> 'running' AS complete FROM cat")
def run_catalogue(spark, sf):
    return catalogue(spark, sf).select("run", "mtime", F.size("movies").cast("long").alias("n_movies"), "state", "complete")


@register("newest_complete_run", f"WITH {RUNS} SELECT run, mtime, state FROM cat WHERE outputs AND state <> 'failed' AND state <> 'running' ORDER BY mtime DESC, run LIMIT 1")
def newest_complete_run(spark, sf):
    return S.newest_complete(catalogue(spark, sf)).select("run", "mtime", "state")


@register("recent_inputs", """WITH u AS (SELECT 'cal' || (o_custkey % 40) AS path, o_orderdate AS t FROM orders UNION ALL SELECT 'cal' || (l_suppkey % 40), l_shipdate FROM lineitem UNION ALL SELECT 'cal' || (user_id % 40), CAST(ts AS TIMESTAMP) FROM events),
 top AS (SELECT path, max(t) AS last_used FROM u GROUP BY path ORDER BY 2 DESC, 1 LIMIT 8), c AS (SELECT 'cal' || (p_partkey % 60) AS path, count(*) AS cached_parts FROM part WHERE p_size > 20 GROUP BY 1)
 SELECT path, last_used, coalesce(cached_parts, 0) AS cached_parts FROM top LEFT JOIN c USING (path)""")
def recent_inputs(spark, sf):
    p = lambda c, n=40: F.concat(F.lit("cal"), (F.col(c) % n).cast("string")).alias("path")
    scans = [V.table(spark, sf, "orders").select(p("o_custkey"), F.col("o_orderdate").alias("mtime")), V.table(spark, sf, "lineitem").select(p("l_suppkey"), F.col("l_shipdate").alias("mtime")),
             V.table(spark, sf, "events").select(p("user_id"), F.col("ts").alias("mtime"))]
    cached = V.table(spark, sf, "part").where("p_size > 20").groupBy(p("p_partkey", 60)).agg(F.count("*").alias("cached_parts"))
    return S.recent_inputs(scans, cached)


@register("sidecar_matches", """WITH m AS (SELECT p_partkey, p_name || '_' || p_size AS base FROM part), s AS (SELECT ps_key, base AS sbase FROM (SELECT p_partkey AS ps_key, p_name || '_' || substr(CAST(p_size AS VARCHAR), 1, 1) || CASE WHEN p_partkey % 3 = 0 THEN '1' ELSE '' END AS base FROM part))
 SELECT DISTINCT p_partkey, ps_key FROM m JOIN s ON starts_with(base, sbase) OR starts_with(sbase, base)""")
def sidecar_matches(spark, sf):
    """Part names as movie names, and as names of metadata files by a shorter number: every movie with each file that matches."""
    p = V.table(spark, sf, "part")
    m = p.select("p_partkey", F.concat("p_name", F.lit("_"), F.col("p_size").cast("string")).alias("base"))
    s = p.select(F.col("p_partkey").alias("ps_key"), F.concat(F.col("p_name"), F.lit("_"), F.substring(F.col("p_size").cast("string"), 1, 1), F.when(F.col("p_partkey") % 3 == 0, "1").otherwise("")).alias("base"))
    return S.sidecar_pairs(m, s, "p_partkey", "ps_key")


@register("merged_settings", """WITH s AS (SELECT 'c' || c_custkey AS movie, 'min_snr' AS key, '4.0' AS value, 0 AS priority FROM customer UNION ALL SELECT 'c' || c_custkey, 'min_snr', CAST(c_nationkey AS VARCHAR), 1 FROM customer WHERE c_mktsegment = 'BUILDING'
   UNION ALL SELECT 'c' || o_custkey, 'min_snr', 'o' || max(o_orderkey), 2 FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY o_custkey)
 SELECT movie, key, arg_max(value, priority) AS value FROM s GROUP BY ALL""")
def merged_settings(spark, sf):
    """Defaults, file overrides and per-movie overrides merged by priority."""
    c, o = V.table(spark, sf, "customer"), V.table(spark, sf, "orders")
    row = lambda df, mv, val, pr: df.select(F.concat(F.lit("c"), F.col(mv).cast("string")).alias("movie"), F.lit("min_snr").alias("key"), val.alias("value"), F.lit(pr).alias("priority"))
    last = o.where("o_orderpriority = '5-LOW'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"))
    s = row(c, "c_custkey", F.lit("4.0"), 0).unionByName(row(c.where("c_mktsegment = 'BUILDING'"), "c_custkey", F.col("c_nationkey").cast("string"), 1)) \
        .unionByName(row(last, "o_custkey", F.concat(F.lit("o"), F.col("k").cast("string")), 2))
    return S.merge_settings(s)


@register("frames_to_refit", """WITH w AS (SELECT l_orderkey AS movie, l_linenumber AS frame, sha256(CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR) || '|v2') AS stamp FROM lineitem),
 d AS (SELECT l_orderkey AS movie, l_linenumber AS frame, sha256(CAST(l_partkey AS VARCHAR) || '|' || CAST(CASE WHEN l_orderkey % 7 = 0 THEN l_suppkey + 1 ELSE l_suppkey END AS VARCHAR) || '|v2') AS stamp FROM lineitem WHERE l_linenumber <> 3)
 SELECT movie, frame, stamp FROM w WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.movie = w.movie AND d.frame = w.frame AND d.stamp = w.stamp)""")
def frames_to_refit(spark, sf):
    li = V.table(spark, sf, "lineitem")
    mk = lambda sup: [F.col("l_orderkey").alias("movie"), F.col("l_linenumber").alias("frame"), S.stamp(F.col("l_partkey"), sup, F.lit("v2")).alias("stamp")]
    done = li.where("l_linenumber <> 3").select(*mk(F.when(F.col("l_orderkey") % 7 == 0, F.col("l_suppkey") + 1).otherwise(F.col("l_suppkey"))))
    return S.still_to_do(li.select(*mk(F.col("l_suppkey"))), done)


@register("stamped_parts", f"""WITH {V.LOC}, a AS (SELECT movie, max(row_id) AS s FROM loc WHERE frame_number <= 20 GROUP BY movie), b AS (SELECT movie, max(row_id) AS s, count(*) AS n FROM loc GROUP BY movie)
 SELECT b.movie, CAST(b.s AS VARCHAR) AS stamp, CASE WHEN a.s IS DISTINCT FROM b.s THEN b.n ELSE (SELECT count(*) FROM loc l WHERE l.movie = b.movie AND l.frame_number <= 20) END AS n, a.s IS DISTINCT FROM b.s AS rewritten FROM b LEFT JOIN a USING (movie)""")
def stamped_parts(spark, sf):
    """A store of movies written when only 20 frames were there and brought up to date: which parts were replaced, and what they hold."""
    store = f"{checkpoint_dir(spark).rstrip('/')}/parts/{uuid.uuid4().hex}"
    rows = V.loc(spark, sf).select(F.col("movie").alias("part"), "row_id", "frame_number")
    for now in (rows.where("frame_number <= 20"), rows):
        wanted = now.groupBy("part").agg(F.max("row_id").cast("string").alias("stamp"))
        stale = cut(parts.stale_parts(wanted, store))
        parts.replace_parts(now.join(stale.select("part"), "part", "left_semi"), stale, store)
    held = parts.read_parts(spark, store, "row_id long, frame_number int").groupBy("part").agg(F.count("*").alias("n"))
    last = stale.select("part", F.lit(True).alias("r"))
    return parts.read_manifest(spark, store).join(held, "part").join(last, "part", "left").select(F.col("part").alias("movie"), "stamp", "n", F.coalesce("r", F.lit(False)).alias("rewritten"))


@register("name_inference", r"""WITH n AS (SELECT page_id, regexp_replace(url, '^https?://', '') || '_' || CASE page_id % 5 WHEN 0 THEN '10x_25ums_0.04s' WHEN 1 THEN '20X 5um/s' WHEN 2 THEN '63x.ome.tif' ELSE 'plain.TIFF' END AS name, CASE WHEN page_id % 2 = 0 THEN 40e0 END AS ms FROM pages),
 k AS (SELECT *, regexp_replace(regexp_replace(string_split_regex(name, '[/\\]')[-1], '(?i)(\.ome)?\.tiff?$', ''), '_MMStack_Pos0', '') AS stem FROM n),
 c AS (SELECT *, regexp_replace(regexp_replace(stem, '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS cl FROM k)
 SELECT page_id, CASE WHEN length(cl) > 0 THEN cl ELSE 'movie' END AS clean, CAST(CASE page_id % 5 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 63 END AS DOUBLE) AS objective,
  CASE page_id % 5 WHEN 0 THEN 1e0 WHEN 1 THEN CASE WHEN page_id % 2 = 0 THEN 0.2e0 END END AS z_step FROM c""")
def name_inference(spark, sf):
    """Clean names, objective and z step from names built on page addresses; nothing is guessed."""
    k = F.col("page_id") % 5
    tail = F.when(k == 0, "10x_25ums_0.04s").when(k == 1, "20X 5um/s").when(k == 2, "63x.ome.tif").otherwise("plain.TIFF")
    n = V.table(spark, sf, "pages").select("page_id", F.concat(F.regexp_replace("url", "^https?://", ""), F.lit("_"), tail).alias("name"), F.when(F.col("page_id") % 2 == 0, F.lit(40.0)).alias("ms"), tail.alias("tail"))
    return n.select("page_id", S.clean_name(F.col("name")).alias("clean"), S.magnification(F.col("tail")).cast("double").alias("objective"), S.z_step_um(F.col("tail"), F.col("ms")).alias("z_step"))


@register("event_durations", """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, max(epoch_us(ts)) OVER () AS total FROM events)
 SELECT event_id, coalesce(lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id), total) - us AS duration_us FROM e""")
def event_durations(spark, sf):
    """Time to the next event of the same user; the last one lasts to the end of the table."""
    e = V.table(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    total = e.agg(F.max("us")).first()[0]
    nxt = next_in_order(e, "user_id", ["us", "event_id"], "us", "next_us")
    return nxt.select("event_id", (F.coalesce("next_us", F.lit(total)) - F.col("us")).alias("duration_us"))


_LAT = [" + ".join(f"({c!r}::DOUBLE)*{t}" for c, t in zip(row, ("z", "z*u", "z*v", "z*z", "z*z*u", "z*z*v"))) for row in LATERAL_COEF]


@register("localization_outputs", f"""WITH {V.LOC}, {DRIFT}, p AS (SELECT l.*, coalesce(zMicrons, 0) AS z, (xMean + 896 - 1024.5e0)/1024 AS u, (yMean + 896 - 1024.5e0)/1024 AS v, dx, dy, dz, count(*) OVER (PARTITION BY movie, track_number) AS len FROM loc l LEFT JOIN drift USING (movie, frame_number))
 SELECT row_id, CAST(len AS INTEGER) AS trackLength, {R(f'xMean - ({_LAT[0]})')} AS xCorrected, {R(f'yMean - ({_LAT[1]}) - dy')} AS yStabilized, {R('1.33e0*(zMicrons - dz)')} AS zStabilized, {R('1.33e0*zPrecisionUm')} AS zPrecisionUm FROM p""")
def localization_outputs(spark, sf):
    rows = V.loc(spark, sf)
    out = S.output_columns(rows, D.estimate_drift(rows), LATERAL_COEF, (896.0, 896.0), 1.33)
    return rounded(out.select("row_id", "trackLength", "xCorrected", "yStabilized", "zStabilized", "zPrecisionUm"), "xCorrected", "yStabilized", "zStabilized", "zPrecisionUm")


@register("exported_rows", f"""WITH {V.LOC} SELECT movie, row_id, CASE WHEN row_id % 3 = 0 THEN track_number + 1000 ELSE track_number END AS track_number, frame_number FROM loc WHERE amplitude1 > 200 OR minLobeSNR > 30""")
def exported_rows(spark, sf):
    rows = V.loc(spark, sf)
    ids = rows.where("amplitude1 > 200").select("row_id").unionByName(rows.where("minLobeSNR > 30").select("row_id"))
    new = rows.where("row_id % 3 = 0").select("row_id", (F.col("track_number") + 1000).alias("track_number"))
    return S.export_subset(rows, ids, new).select("movie", "row_id", "track_number", "frame_number")


@register("column_json", f"""WITH {V.LOC} SELECT movie, frame_number, count(*) AS n, CAST(to_json({{'track_number': list(track_number ORDER BY row_id), 'xMean': list(round(xMean, 4) ORDER BY row_id), 'yMean': list(round(yMean, 4) ORDER BY row_id),
  'zMicrons': list(round(zMicrons, 4) ORDER BY row_id)}}) AS VARCHAR) AS data FROM loc GROUP BY ALL""")
def column_json(spark, sf):
    return S.column_json(V.loc(spark, sf), ["track_number", "xMean", "yMean", "zMicrons"])


@register("endpoint_risk", f"""WITH {V.LOC}, r AS (SELECT movie, min(zMicrons) AS lo, max(zMicrons) AS hi FROM loc GROUP BY movie) SELECT row_id, zMicrons IS NOT NULL AND zStatus = 0 AS z_valid, coalesce(zMicrons < lo + 4 OR zMicrons > hi - 4, false) AS endpoint_risk FROM loc JOIN r USING (movie)""")
def endpoint_risk(spark, sf):
    """Valid depths, and those within 4 µm of the ends of the movie's depth range."""
    r = V.loc(spark, sf)
    lim = r.groupBy("movie").agg(F.min("zMicrons").alias("lo"), F.max("zMicrons").alias("hi"))
    z = F.col("zMicrons")
    return r.join(lim, "movie").select("row_id", (z.isNotNull() & (F.col("zStatus") == 0)).alias("z_valid"), F.coalesce((z < F.col("lo") + 4) | (z > F.col("hi") - 4), F.lit(False)).alias("endpoint_risk"))


@register("flipped_depths", f"WITH {V.LOC} SELECT row_id, {R('-zMicrons')} AS zMicrons FROM loc")
def flipped_depths(spark, sf):
    from moteflow.operators.calibration import flip_z
    once = flip_z(V.loc(spark, sf), ["zMicrons", "zStabilized"], None)
    return rounded(flip_z(once, ["zMicrons"], "up").select("row_id", "zMicrons"), "zMicrons")
