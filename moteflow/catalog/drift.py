"""Drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from moteflow.catalog import views as V
from moteflow.catalog.registry import R, register, rounded
from moteflow.operators import drift as D, tracks as T
from moteflow.plans.series import gauss_weights

PX = 0.325


def _sweeps(n: int = 6) -> str:
    """The alternating medians, one pair of CTEs per sweep."""
    out, prev = [], "(SELECT movie, track_number, frame_number, xMean AS vx, yMean AS vy, zMicrons AS vz, 0e0 AS dx, 0e0 AS dy, 0e0 AS dz FROM loc)"
    for k in range(n):
        cs = ", ".join(f"median(v{a} - d{a}) OVER (PARTITION BY movie, track_number) AS c{a}" for a in "xyz")
        ds = ", ".join(f"median(v{a} - c{a}) OVER (PARTITION BY movie, frame_number) AS d{a}" for a in "xyz")
        keep = "movie, track_number, frame_number, vx, vy, vz"
        out.append(f"c{k} AS (SELECT {keep}, {cs} FROM {prev})")
        out.append(f"d{k} AS (SELECT {keep}, {ds} FROM c{k})")
        prev = f"d{k}"
    return ",\n".join(out)


def _fill(a: str) -> str:
    back = "OVER (PARTITION BY movie ORDER BY frame_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = "OVER (PARTITION BY movie ORDER BY frame_number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    at = f"CASE WHEN {a} IS NOT NULL THEN frame_number END"
    p, pf = f"last_value({a} IGNORE NULLS) {back}", f"last_value({at} IGNORE NULLS) {back}"
    n, nf = f"first_value({a} IGNORE NULLS) {ahead}", f"first_value({at} IGNORE NULLS) {ahead}"
    return f"coalesce({a}, {p} + ({n} - {p}) * ((frame_number - {pf}) / ({nf} - {pf})), {p}, {n}) AS {a}"


def smooth_sql(col: str, sigma: float, radius: int) -> str:
    w = "PARTITION BY movie ORDER BY frame_number"
    whole = f"OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    terms = []
    for k, g in zip(range(-radius, radius + 1), gauss_weights(sigma, radius)):
        v = col if k == 0 else (f"coalesce(lag({col}, {-k}) OVER ({w}), first_value({col}) {whole})" if k < 0
                                else f"coalesce(lead({col}, {k}) OVER ({w}), last_value({col}) {whole})")
        terms.append(f"{v} * CAST({g!r} AS DOUBLE)")
    return " + ".join(terms)


DRIFT = f"""{_sweeps()},
drift_at AS (SELECT movie, frame_number, min(dx) AS dx, min(dy) AS dy, min(dz) AS dz FROM d5 GROUP BY ALL),
drift_grid AS (SELECT movie, CAST(unnest(range(1, last + 1)) AS INTEGER) AS frame_number
  FROM (SELECT movie, max(frame_number) AS last FROM loc GROUP BY movie)),
drift_full AS (SELECT movie, frame_number, {_fill('dx')}, {_fill('dy')}, {_fill('dz')}
  FROM drift_grid LEFT JOIN drift_at USING (movie, frame_number)),
drift_mid AS (SELECT movie, frame_number, dx - median(dx) OVER (PARTITION BY movie) AS dx,
  dy - median(dy) OVER (PARTITION BY movie) AS dy, dz - median(dz) OVER (PARTITION BY movie) AS dz_raw FROM drift_full),
drift_s AS (SELECT *, {smooth_sql('dz_raw', 3.0, 12)} AS s FROM drift_mid),
drift AS (SELECT movie, frame_number, dx, dy, dz_raw, s - median(s) OVER (PARTITION BY movie) AS dz FROM drift_s)"""


@register("drift_table", f"WITH {V.LOC}, {DRIFT} SELECT movie, frame_number, {R('dx')} AS dx, {R('dy')} AS dy, "
          f"{R('dz')} AS dz, {R('dz_raw')} AS dz_raw FROM drift")
def drift_table(spark, sf):
    return rounded(D.estimate_drift(V.loc(spark, sf)), "dx", "dy", "dz", "dz_raw")


STAB = """stab AS (SELECT l.*, xMean - coalesce(dx, 0) AS xStabilized, yMean - coalesce(dy, 0) AS yStabilized,
  zMicrons - coalesce(dz, 0) AS zStabilized FROM loc l LEFT JOIN drift USING (movie, frame_number))"""


def dist_sql(dx: str, dy: str, dz: str) -> str:
    return (f"sqrt(({dx}) * {PX}e0 * (({dx}) * {PX}e0) + ({dy}) * {PX}e0 * (({dy}) * {PX}e0) "
            f"+ coalesce({dz}, 0) * coalesce({dz}, 0))")


def stats_sql(src: str, x: str, y: str, z: str) -> str:
    w = "OVER (PARTITION BY movie, track_number ORDER BY frame_number, row_id)"
    step = dist_sql(f"{x} - lag({x}) {w}", f"{y} - lag({y}) {w}", f"{z} - lag({z}) {w}")
    at = lambda c, f: f"{f}({c}, frame_number)"
    net = dist_sql(f"xb - xa", "yb - ya", "zb - za")
    return f"""stats AS (SELECT movie, track_number, n_rows, first_frame, last_frame, mean_z, z_range, coalesce(max_step, 0e0) AS max_step,
  pct_recovered, {net} AS net_move FROM (
    SELECT movie, track_number, count(*) AS n_rows, min(frame_number) AS first_frame, max(frame_number) AS last_frame,
    avg({z}) AS mean_z, max({z}) - min({z}) AS z_range, max(step) AS max_step, avg(CAST(recovered AS DOUBLE)) * 100 AS pct_recovered,
    arg_min({x}, frame_number) AS xa, arg_max({x}, frame_number) AS xb, arg_min({y}, frame_number) AS ya, arg_max({y}, frame_number) AS yb,
    first({z} ORDER BY frame_number) AS za, last({z} ORDER BY frame_number) AS zb
    FROM (SELECT *, CASE WHEN lag(row_id) {w} IS NOT NULL THEN {step} END AS step FROM {src}) GROUP BY movie, track_number))"""


STATS_COLS = ["mean_z", "z_range", "max_step", "pct_recovered", "net_move"]
STATS_SELECT = "SELECT movie, track_number, n_rows, first_frame, last_frame, " + ", ".join(f"{R(c)} AS {c}" for c in STATS_COLS)


@register("drift_track_stats", f"WITH {V.LOC}, {DRIFT}, {STAB}, {stats_sql('stab', 'xStabilized', 'yStabilized', 'zStabilized')} "
          f"{STATS_SELECT} FROM stats")
def drift_track_stats(spark, sf):
    """Flagship: estimate the drift, stabilize, and describe every track."""
    rows = V.loc(spark, sf)
    stab = D.add_stabilized(rows, D.estimate_drift(rows))
    return rounded(T.track_stats(stab, "xStabilized", "yStabilized", "zStabilized", PX), *STATS_COLS)


@register("stabilized_rows", f"WITH {V.LOC}, {DRIFT}, {STAB} SELECT row_id, movie, {R('xStabilized')} AS xStabilized, "
          f"{R('yStabilized')} AS yStabilized, {R('zStabilized')} AS zStabilized FROM stab")
def stabilized_rows(spark, sf):
    rows = V.loc(spark, sf)
    out = D.add_stabilized(rows, D.estimate_drift(rows))
    return rounded(out.select("row_id", "movie", "xStabilized", "yStabilized", "zStabilized"),
                   "xStabilized", "yStabilized", "zStabilized")


@register("legacy_drift_smoothing", f"""WITH {V.LOC},
d0 AS (SELECT movie, frame_number, avg(zMicrons) AS dz_raw FROM loc GROUP BY ALL),
d1 AS (SELECT *, {smooth_sql('dz_raw', 3.0, 9)} AS s FROM d0)
SELECT movie, frame_number, {R('dz_raw')} AS dz_raw, {R('s - median(s) OVER (PARTITION BY movie)')} AS dz FROM d1""")
def legacy_drift_smoothing(spark, sf):
    d = V.loc(spark, sf).groupBy("movie", "frame_number").agg(F.avg("zMicrons").alias("dz"))
    return rounded(D.smooth_legacy_dz(d), "dz", "dz_raw")


@register("rereferenced_drift", f"""WITH {V.LOC},
d0 AS (SELECT movie, frame_number, avg(xMean) AS dx, avg(yMean) AS dy, avg(zMicrons) AS dz FROM loc GROUP BY ALL),
m AS (SELECT movie, median(dx) AS mx, median(dy) AS my, median(dz) AS mz FROM d0 GROUP BY movie)
SELECT row_id, {R('dx - mx')} AS dx, {R('xMean - dx + mx')} AS xStabilized, {R('zMicrons - dz + mz')} AS zStabilized
FROM loc JOIN d0 USING (movie, frame_number) JOIN m USING (movie)""")
def rereferenced_drift(spark, sf):
    rows = V.loc(spark, sf)
    d = rows.groupBy("movie", "frame_number").agg(
        F.avg("xMean").alias("dx"), F.avg("yMean").alias("dy"), F.avg("zMicrons").alias("dz"))
    moved, out = D.rereference(d, D.add_stabilized(rows, d))
    return rounded(out.join(moved, ["movie", "frame_number"]).select("row_id", "dx", "xStabilized", "zStabilized"),
                   "dx", "xStabilized", "zStabilized")
