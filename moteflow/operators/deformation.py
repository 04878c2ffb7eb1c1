"""Displacement fields: plane, grid, interpolation weights, prediction, strain."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from moteflow.functions.field import combine
from moteflow.operators.filters import upper_median
from moteflow.plans.fit import fit_terms
from moteflow.plans.quantile import exact_quantiles
from moteflow.plans.spatial import nearest_k
from moteflow.session import cut

MIN_BEADS = 8
DENSITY_MIN = 0.35
# Candidate length scales (x bead spacing) and amplitudes (x displacement variance).
LENGTHS = [0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.6, 8.0]
AMPLITUDES = [0.1, 0.3, 1.0, 3.0, 10.0]


def nearest_spacing(beads: DataFrame, radius: float = 10.0) -> DataFrame:
    """Upper median of the 3-D nearest-neighbour distance of one frame's beads per movie."""
    left = beads.select("movie", "track_number", F.col("X").alias("ax"), F.col("Y").alias("ay"), F.col("Z").alias("az"))
    right = beads.select("movie", F.col("track_number").alias("t2"), F.col("X").alias("bx"), F.col("Y").alias("by"), F.col("Z").alias("bz"))
    d = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
               + (F.col("az") - F.col("bz")) * (F.col("az") - F.col("bz")))
    nn = nearest_k(left, right, 1, ["movie"], ("ax", "ay"), ("bx", "by"), "track_number", d, radius, "t2",
                   F.col("track_number") != F.col("t2"))
    return nn.groupBy("movie").agg(upper_median(F.col("distance")).alias("spacing"))


def median_plane(beads: DataFrame, passes: int = 3) -> DataFrame:
    """z = c0 + c1 x + c2 y per movie; beads beyond 3 robust SDs of all residuals leave for good."""
    rows = cut(beads.withColumn("_use", F.lit(True)))
    terms = [F.lit(1.0), F.col("X"), F.col("Y")]
    coef = None
    for k in range(passes):
        coef = fit_terms(rows.where("_use"), ["movie"], terms, F.col("Z"))
        if k == passes - 1:
            break
        res = cut(rows.join(coef.select("movie", "coef"), "movie")
                  .withColumn("_r", F.abs(F.col("Z") - combine(terms, F.col("coef")))).drop("coef"))
        mad = exact_quantiles(res, ["movie"], "_r", {"_mad": 0.5})
        rows = res.join(mad, "movie").withColumn("_use", F.col("_use") & (F.col("_r") < F.col("_mad") * 1.4826 * 3)).drop("_r", "_mad")
    return coef


def grid_extent(beads: DataFrame, nx: int = 44) -> DataFrame:
    """Extent of the beads padded by 3 % and the number of grid nodes along y and z."""
    e = beads.groupBy("movie").agg(*[f(c).alias(f"{c.lower()}{n}") for c in "XYZ" for f, n in ((F.min, "0"), (F.max, "1"))])
    cols = {}
    for c in "xyz":
        pad = F.lit(0.03) * F.greatest(F.col(c + "1") - F.col(c + "0"), F.lit(1.0))
        cols |= {c + "lo": F.col(c + "0") - pad, c + "hi": F.col(c + "1") + pad}
    e = e.withColumns(cols)
    half_up = lambda v: F.floor(v + 0.5)
    ratio = lambda c: (F.col(c + "hi") - F.col(c + "lo")) / (F.col("xhi") - F.col("xlo")) * nx
    return e.withColumns({"nx": F.lit(nx), "ny": F.greatest(F.lit(8), F.least(F.lit(60), half_up(ratio("y")))).cast("int"),
                          "nz": F.greatest(F.lit(4), F.least(F.lit(14), half_up(ratio("z")) + 4)).cast("int")})


# ------------------------------------------------------------------ interpolation

def _kriging(dist2: np.ndarray, y: np.ndarray, noise: np.ndarray, ell: float, s2: float):
    """Ordinary-kriging mean, weights and log marginal likelihood of one component (None when singular)."""
    A = s2 * np.exp(-dist2 / (2 * ell * ell))
    A[np.diag_indices_from(A)] = s2 + noise
    try:
        L = np.linalg.cholesky(A)
    except np.linalg.LinAlgError:
        return None
    both = np.linalg.solve(L.T, np.linalg.solve(L, np.column_stack((np.ones(len(y)), y))))
    mu = both[:, 1].sum() / both[:, 0].sum()
    alpha = both[:, 1] - mu * both[:, 0]
    lml = -0.5 * float((y - mu) @ alpha) - np.log(np.diag(L)).sum() - 0.5 * len(y) * math.log(2 * math.pi)
    return mu, alpha, lml


def _sq_dist(P: np.ndarray) -> np.ndarray:
    d = P[:, None, :] - P[None, :, :]
    return (d * d).sum(-1)


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Groups over an explicit number of tasks: their rows are few bytes but much work, and adaptive execution would merge them into a task or two."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def fit_lengths(disp: DataFrame, spacing: DataFrame) -> DataFrame:
    """Length scale (shared by the components) and amplitudes per movie by marginal likelihood. ``disp`` holds one frame's
    displacements per movie. Each movie and length is a group of its own, which tries the components and amplitudes; the amplitude is chosen
    per length and component, then the length by the sum over the components."""
    lengths = F.explode(F.array(*[F.lit(v) for v in LENGTHS]))
    cand = disp.where("uz IS NOT NULL AND Z IS NOT NULL").join(spacing, "movie") \
        .select("movie", "track_number", "X", "Y", "Z", *[k + c for c in "xyz" for k in "uv"], "spacing", lengths.alias("_f")).withColumn("ell", F.col("_f") * F.col("spacing")).drop("_f", "spacing")
    fields = ["movie", "ell", "axis", "amplitude", "s2", "lml"]

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf) >= MIN_BEADS:
            pdf = pdf.sort_values("track_number")
            movie, ell, dist2 = pdf["movie"].iat[0], float(pdf["ell"].iat[0]), _sq_dist(pdf[["X", "Y", "Z"]].to_numpy(float))
            for c in "xyz":
                u, v = pdf["u" + c].to_numpy(float), pdf["v" + c].to_numpy(float)
                mid = np.sort(v)[len(v) // 2]
                for amplitude in AMPLITUDES:
                    s2 = amplitude * max(u.var(ddof=1) - mid, 1e-6 * (1 + mid))
                    fit = _kriging(dist2, u, v, ell, s2)
                    if fit:
                        out.append((movie, ell, c, amplitude, s2, fit[2]))
        return pd.DataFrame(out, columns=fields)

    fits = _spread(cand, "movie", "ell").groupBy("movie", "ell").applyInPandas(score, "movie string, ell double, axis string, amplitude double, s2 double, lml double")
    per = fits.groupBy("movie", "ell", "axis").agg(F.max_by("s2", F.struct("lml", -F.col("amplitude"))).alias("s2"), F.max("lml").alias("lml"))
    per = per.groupBy("movie", "ell").agg(F.count("*").alias("axes"), F.sum("lml").alias("lml"), *[F.max(F.when(F.col("axis") == c, F.col("s2"))).alias("s2" + c) for c in "xyz"])
    return per.where("axes = 3").groupBy("movie").agg(
        F.max_by(F.struct("ell", "s2x", "s2y", "s2z", "lml"), F.struct("lml", -F.col("ell"))).alias("b")).select("movie", "b.*")


NODE_SCHEMA = ("movie string, frame_number int, gx int, gy int, x double, y double, z0 double, ux double, uy double, uz double, density double, "
               + ", ".join(f"g{i}{j} double" for i in range(3) for j in range(3)))


def _nodes(g: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nx, ny = int(g["nx"]), int(g["ny"])
    gy, gx = np.divmod(np.arange(nx * ny), nx)
    x, y = g["xlo"] + (g["xhi"] - g["xlo"]) * gx / (nx - 1), g["ylo"] + (g["yhi"] - g["ylo"]) * gy / (ny - 1)
    c = g["coef"]
    return gx, gy, np.column_stack((x, y, c[0] + c[1] * x + c[2] * y + g["shift"]))


def _field(Q: np.ndarray, P: np.ndarray, weights: np.ndarray, mu: np.ndarray, ell: float) -> dict[str, np.ndarray]:
    d = Q[:, None, :] - P[None, :, :]
    e = np.exp(-(d * d).sum(-1) / (2 * ell * ell))
    out = {"density": e.sum(1)}
    for i, c in enumerate("xyz"):
        w = e * weights[:, i]
        out["u" + c] = mu[i] + w.sum(1)
        for j in range(3):
            out[f"g{i}{j}"] = -(w * d[:, :, j]).sum(1) / ell ** 2
    return out


def predict_field(beads: DataFrame, grid: DataFrame, weighted: bool) -> DataFrame:
    """Interpolated displacement and its gradient on the grid of every (movie, frame).

    ``grid`` is one row per movie (extent, plane coefficients, shift, ell, s2x..s2z). One frame's beads are
    one group (a frame is bounded by the sensor); bead-node pairs live only inside the task. With
    ``weighted`` the beads carry wx, wy, wz and mux, muy, muz; otherwise weights are solved here.
    """
    j = beads.join(grid, "movie")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.iloc[0]
        if not weighted and len(pdf) < MIN_BEADS:
            return pd.DataFrame(columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])
        P = pdf[["X", "Y", "Z"]].to_numpy(float)
        if weighted:
            w, mu = pdf[["wx", "wy", "wz"]].to_numpy(float), g[["mux", "muy", "muz"]].to_numpy(float)
        else:
            dist2 = _sq_dist(P)
            k = [_kriging(dist2, pdf["u" + c].to_numpy(float), pdf["v" + c].to_numpy(float), g["ell"], g["s2" + c]) for c in "xyz"]
            if any(v is None for v in k):
                return pd.DataFrame(columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])
            w, mu = np.column_stack([v[1] * g["s2" + c] for v, c in zip(k, "xyz")]), np.array([v[0] for v in k])
        gx, gy, Q = _nodes(g)
        out = pd.DataFrame({"movie": g["movie"], "frame_number": g["frame_number"], "gx": gx, "gy": gy, "x": Q[:, 0], "y": Q[:, 1], "z0": Q[:, 2]})
        parts = [_field(Q[i:i + 512], P, w, mu, g["ell"]) for i in range(0, len(Q), 512)]
        for c in parts[0]:
            out[c] = np.concatenate([p[c] for p in parts])
        return out[[c.split()[0] for c in NODE_SCHEMA.split(", ")]]

    return _spread(j, "movie", "frame_number").groupBy("movie", "frame_number").applyInPandas(kernel, NODE_SCHEMA)


def strain(field: DataFrame) -> DataFrame:
    """In-plane strain measures and tilt from the displacement gradient g[i][j] = d u_i / d x_j."""
    a, b, c, d = F.col("g00"), F.col("g01"), F.col("g10"), F.col("g11")
    hyp = lambda p, q: F.sqrt(p * p + q * q)
    u = [F.col("ux"), F.col("uy"), F.col("uz")]
    return field.withColumns({
        "lateral": hyp(u[0], u[1]), "magnitude": F.sqrt(u[0] * u[0] + u[1] * u[1] + u[2] * u[2]), "areal_strain_pct": (a + d) * 100,
        "shear_strain_pct": hyp((a - d) / 2, (b + c) / 2) * 100, "tilt_deg": F.degrees(F.atan(hyp(F.col("g20"), F.col("g21"))))})


def movie_grid(beads: DataFrame, depth_shift: float = 0.0) -> DataFrame:
    """Extent, node counts and median plane of one frame's beads per movie."""
    b = cut(beads)
    e = grid_extent(b).join(median_plane(b).select("movie", "coef"), "movie")
    return e.select("movie", "xlo", "xhi", "ylo", "yhi", "nx", "ny", "coef", (F.lit(depth_shift) * (F.col("zhi") - F.col("zlo"))).alias("shift"))


def deformation_series(beads: DataFrame, reference: int, depth_shift: float = 0.0) -> DataFrame:
    """Displacement and strain field on the median plane of the reference frame for every frame."""
    from moteflow.operators.stats import busiest_frame, displacement
    beads = cut(beads)
    disp = cut(displacement(beads, F.col("frame_number") == reference).where("uz IS NOT NULL AND Z IS NOT NULL"))
    ref = beads.where((F.col("frame_number") == reference) & F.col("Z").isNotNull())
    busy = busiest_frame(disp, reference, F.lit(1))
    one = disp.join(busy.select("movie", F.col("frame").alias("frame_number")), ["movie", "frame_number"], "left_semi")
    fit = fit_lengths(one, nearest_spacing(one.select("movie", "track_number", "X", "Y", "Z")))
    grid = cut(movie_grid(ref, depth_shift).join(fit, "movie"))
    out = strain(predict_field(disp, grid, weighted=False))
    return out.select("movie", "frame_number", "gx", "gy", "x", "y", "z0", "ux", "uy", "uz", "density", "areal_strain_pct", "shear_strain_pct", "tilt_deg",
                      (F.col("density") >= DENSITY_MIN).alias("near_beads"))


def colour_range(field: DataFrame, quantity: str) -> DataFrame:
    """Largest absolute value near beads per movie, at least 0.001."""
    return field.where("near_beads").groupBy("movie").agg(F.greatest(F.max(F.abs(quantity)), F.lit(1e-3)).alias("cmax"))
