"""Deformation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from moteflow.catalog import views as V
from moteflow.catalog.registry import R, register, rounded
from moteflow.catalog.stats import BEADS, PLANE, bead_positions
from moteflow.operators import deformation as D, stats as S

GRID = f"""ext AS (SELECT movie, min(X) AS x0, max(X) AS x1, min(Y) AS y0, max(Y) AS y1 FROM beads WHERE frame_number = 2 AND Z IS NOT NULL GROUP BY movie),
ext2 AS (SELECT movie, x0 - 0.03e0*greatest(x1-x0, 1) AS xlo, x1 + 0.03e0*greatest(x1-x0, 1) AS xhi, y0 - 0.03e0*greatest(y1-y0, 1) AS ylo, y1 + 0.03e0*greatest(y1-y0, 1) AS yhi FROM ext),
ext3 AS (SELECT *, CAST(greatest(8, least(60, floor(44*(yhi-ylo)/(xhi-xlo) + 0.5e0))) AS INTEGER) AS ny FROM ext2),
nodes AS (SELECT movie, gx, gy, xlo + (xhi-xlo)*gx/43e0 AS x, ylo + (yhi-ylo)*gy/(ny-1) AS y, c0 + c1*(xlo + (xhi-xlo)*gx/43e0) + c2*(ylo + (yhi-ylo)*gy/(ny-1)) AS z0
  FROM (SELECT movie, xlo, xhi, ylo, yhi, ny, unnest(range(0, ny)) AS gy FROM ext3) r JOIN pc2 USING (movie), range(0, 44) g(gx))"""


@register("kernel_field", f"""WITH {V.LOC}, {BEADS}, {PLANE}, {GRID},
 src AS (SELECT movie, frame_number, X, Y, Z, ux*0.01e0 AS wx, uy*0.02e0 AS wy, uz*0.03e0 AS wz FROM disp WHERE uz IS NOT NULL AND Z IS NOT NULL),
 k AS (SELECT n.movie, frame_number, gx, gy, n.x - s.X AS dx, n.y - s.Y AS dy, wx, wy, wz, exp(-((n.x-s.X)*(n.x-s.X) + (n.y-s.Y)*(n.y-s.Y) + (z0-s.Z)*(z0-s.Z))/(2*15e0*15e0)) AS e FROM nodes n JOIN src s USING (movie)),
 f AS (SELECT movie, frame_number, gx, gy, sum(e) AS density, 0.1e0 + sum(e*wx) AS ux, -0.2e0 + sum(e*wy) AS uy, 0.3e0 + sum(e*wz) AS uz, -sum(e*wx*dx)/225 AS g00, -sum(e*wx*dy)/225 AS g01, -sum(e*wy*dx)/225 AS g10, -sum(e*wy*dy)/225 AS g11,
  -sum(e*wz*dx)/225 AS g20, -sum(e*wz*dy)/225 AS g21 FROM k GROUP BY ALL)
 SELECT movie, CAST(frame_number AS INTEGER) AS frame_number, CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, {R('ux')} AS ux, {R('uz')} AS uz, {R('density')} AS density, {R('100*(g00+g11)', 4)} AS areal_strain_pct,
 {R('100*sqrt(pow((g00-g11)/2,2)+pow((g01+g10)/2,2))', 4)} AS shear_strain_pct, {R('degrees(atan(sqrt(g20*g20+g21*g21)))', 4)} AS tilt_deg, {R('sqrt(ux*ux+uy*uy+uz*uz)')} AS magnitude FROM f""")
def kernel_field(spark, sf):
    """Field and strain from given bead weights at every frame."""
    p = bead_positions(spark, sf)
    d = S.displacement(p, F.col("frame_number") == 2).where("uz IS NOT NULL AND Z IS NOT NULL")
    w = d.select("movie", "frame_number", "X", "Y", "Z", (F.col("ux") * 0.01).alias("wx"), (F.col("uy") * 0.02).alias("wy"), (F.col("uz") * 0.03).alias("wz"),
                 F.lit(0.1).alias("mux"), F.lit(-0.2).alias("muy"), F.lit(0.3).alias("muz"))
    grid = D.movie_grid(p.where("frame_number = 2 AND Z IS NOT NULL")).withColumn("ell", F.lit(15.0))
    f = D.strain(D.predict_field(w, grid, weighted=True))
    out = rounded(f.select("movie", "frame_number", "gx", "gy", "ux", "uz", "density", "areal_strain_pct", "shear_strain_pct", "tilt_deg", "magnitude"), "ux", "uz", "density", "magnitude")
    return out.withColumns({c: F.round(c, 4) for c in ("areal_strain_pct", "shear_strain_pct", "tilt_deg")})


@register("interpolation_lengths")
def interpolation_lengths(spark, sf):
    """Smoothing length and amplitudes by marginal likelihood, on the busiest frame of each movie relative to frame 2."""
    p = bead_positions(spark, sf)
    d = S.displacement(p, F.col("frame_number") == 2).where("uz IS NOT NULL AND Z IS NOT NULL")
    busy = S.busiest_frame(d, 2, F.lit(1)).select("movie", F.col("frame").alias("frame_number"))
    d = d.join(busy, ["movie", "frame_number"], "left_semi")
    return rounded(D.fit_lengths(d, D.nearest_spacing(d.select("movie", "track_number", "X", "Y", "Z"))), "ell", "s2x", "s2y", "s2z", "lml")


@register("deformation_series")
def deformation_series(spark, sf):
    """The whole deformation and strain series relative to frame 2."""
    return D.deformation_series(bead_positions(spark, sf), 2)
