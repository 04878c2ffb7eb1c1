"""Interpolation of displacement fields."""

import numpy as np
import pandas as pd

from moteflow.operators import deformation as D


def beads(seed=3, movies=3, n=12):
    r = np.random.default_rng(seed)
    rows = [(f"m{m}", 5, k, *r.uniform(0, 60, 2), *r.uniform(0, 5, 1), *r.normal(0, 1, 3), *r.uniform(0.01, 0.05, 3)) for m in range(movies) for k in range(n)]
    return pd.DataFrame(rows, columns=["movie", "frame_number", "track_number", "X", "Y", "Z", "ux", "uy", "uz", "vx", "vy", "vz"])


def test_lengths_are_the_best_of_all_candidates(spark):
    b = beads()
    got = D.fit_lengths(spark.createDataFrame(b), spark.createDataFrame([(m, 9.0) for m in b["movie"].unique()], "movie string, spacing double")).toPandas().set_index("movie")
    assert len(got) == 3
    for m, p in b.groupby("movie"):
        best = (-np.inf,)
        for f in D.LENGTHS:
            tried = []
            for c in "xyz":
                u, v = p["u" + c].to_numpy(), p["v" + c].to_numpy()
                mid = np.sort(v)[len(v) // 2]
                scale = [a * max(u.var(ddof=1) - mid, 1e-6 * (1 + mid)) for a in D.AMPLITUDES]
                tried.append(max((D._kriging(D._sq_dist(p[["X", "Y", "Z"]].to_numpy()), u, v, f * 9.0, s)[2], s) for s in scale))
            best = max(best, (sum(t[0] for t in tried), f * 9.0, *[t[1] for t in tried]))
        assert np.allclose(got.loc[m, ["lml", "ell", "s2x", "s2y", "s2z"]].to_numpy(float), best)


def test_groups_that_are_small_but_slow_are_many_tasks(spark):
    """Their bytes would fit into one task; the work would wait in it."""
    b = spark.createDataFrame(beads())
    grid = spark.createDataFrame([(f"m{m}", 0.0, 60.0, 0.0, 60.0, 44, 44, [1.0, 0.0, 0.0], 0.0, 20.0, 1.0, 1.0, 1.0) for m in range(3)],
                                 "movie string, xlo double, xhi double, ylo double, yhi double, nx int, ny int, coef array<double>, shift double, ell double, s2x double, s2y double, s2z double")
    field = D.predict_field(b, grid, weighted=False)
    assert field.count() == 3 * 44 * 44
    assert field.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
