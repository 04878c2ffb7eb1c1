"""Frames that a track misses are fitted again on their pixels."""

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from helpers import rows
from moteflow.operators import imaging as I, recovery as Y
from moteflow.operators.analyze import analyze
from moteflow.schema import FRAMES, OUTPUT
from moteflow.settings import DEFAULTS
from test_imaging import render

N = 96


def curve(spark):
    return spark.range(0, 361).select(F.col("id").cast("int").alias("i"), (F.col("id") / 6.0 - 30).alias("z"), (F.col("id") / 2.0).alias("angle"), (F.lit(16.5) + F.col("id") / 90.0).alias("sep"))


def lobes(cx, cy, a):
    """One-based lobes of a drawn bead, in canonical order."""
    half, t = (16.5 + a / 45) / 2, np.radians(a)
    return {"x1": float(cx + 1 - half * np.cos(t)), "y1": float(cy + 1 - half * np.sin(t)), "x2": float(cx + 1 + half * np.cos(t)), "y2": float(cy + 1 + half * np.sin(t)), "a": a, "sep": 2 * half}


def frames(spark, beads_by_frame):
    return spark.createDataFrame([("m", f, N, N, [float(v) for v in render(b, n=N, seed=f).ravel()]) for f, b in beads_by_frame.items()], FRAMES).cache()


def test_a_gap_is_closed_from_its_edge_inwards(spark):
    """The bead leaves its place by 2.2 px a frame: frame 5 can be predicted only when frame 4 is back."""
    at = {1: 40.0, 2: 40.0, 3: 40.0, 4: 42.2, 5: 44.4}
    fr = frames(spark, {f: [(x, 48.0, 30.0, 180.0), (80.0, 20.0, 90.0, 150.0)] for f, x in at.items()})
    seen = rows(spark, [{"f": f, "t": 1, **lobes(at[f], 48.0, 30.0), "amp": 180} for f in (1, 2, 3)] + [{"f": f, "t": 2, **lobes(80.0, 20.0, 90.0), "amp": 150} for f in at])
    refit = Y.pixel_refit(fr, I.detect_peaks(fr), DEFAULTS, curve(spark))
    out, removed, history = Y.recover(seen, refit, DEFAULTS, depth=False)
    assert [h["recovered"] for h in history] == [1, 1, 0] and removed.count() == 0
    got = {r.frame_number: r for r in out.where("xMean < 60").collect()}
    assert out.count() == 10 and set(got) == {1, 2, 3, 4, 5} and len({r.track_number for r in got.values()}) == 1
    for f in (4, 5):
        assert abs(got[f].xMean - 1 - at[f]) < 0.3 and abs(got[f].yMean - 49) < 0.3 and got[f].recovered == 1 and abs(got[f].angleDegrees - 30) < 2


def test_what_has_been_tried_is_not_fitted_again(spark, monkeypatch):
    fr = frames(spark, {f: [(40.0, 48.0, 30.0, 180.0)] if f != 3 else [] for f in range(1, 6)})
    seen = rows(spark, [{"f": f, "t": 1, **lobes(40.0, 48.0, 30.0), "amp": 180} for f in (1, 2, 5)])
    fitted, real = [], I.fit_lobes  # frames 3 and 4 are asked for; the bead of frame 3 is not there
    monkeypatch.setattr(Y.I, "fit_lobes", lambda crops, cfg: fitted.append(crops.count()) or real(crops, cfg))
    out, _, history = Y.recover(seen, Y.pixel_refit(fr, I.detect_peaks(fr), DEFAULTS, curve(spark)), DEFAULTS, depth=False)
    assert sorted(r.frame_number for r in out.collect()) == [1, 2, 4, 5] and [h["recovered"] for h in history] == [1, 0]
    assert history[1]["requests"] == 1 and fitted[0] == 2 and sum(fitted) <= 3


def test_windows_tell_shared_lobes_and_nuisance(spark):
    fr = frames(spark, {1: [(40.0, 48.0, 30.0, 180.0)]})
    own = lobes(40.0, 48.0, 0.0)
    req = spark.createDataFrame([("m", 1, 1, own["x1"], own["y1"], own["x2"], own["y2"], 100.0), ("m", 1, 2, 49.0, 79.0, 65.0, 79.0, 100.0), ("m", 1, 3, 1.0, 1.0, 2.0, 1.0, 100.0)],
                                "movie string, frame_number int, track_number int, x1 double, y1 double, x2 double, y2 double, reference double")
    near = rows(spark, [{"f": 1, "t": 5, "x1": own["x1"] + 1, "y1": own["y1"], "x2": own["x1"] - 14, "y2": own["y1"] + 6}, {"f": 1, "t": 6, "x1": 49, "y1": 80, "x2": 65, "y2": 80}])
    peaks = spark.createDataFrame([("m", 1, N, N, 2.0, 20.0, x, y, v) for x, y, v in ((44.0, 52.0, 30.0), (45.0, 44.0, 10.0), (own["x2"] - 1, own["y2"] - 1, 90.0), (47.0, 49.5, 90.0))],
                                  "movie string, frame int, height int, width int, noise double, strong double, x double, y double, value double")
    got = {w.track_number: w for w in Y.refit_windows(req, near, peaks).collect()}
    assert set(got) == {1, 3} and got[1].shared1 and not got[1].shared2  # both lobes of 2 belong to others
    seeds = [(s.x, s.y) for s in got[1].seeds]
    assert seeds[:2] == [(own["x1"] - 1, own["y1"] - 1), (own["x2"] - 1, own["y2"] - 1)] and (44.0, 52.0) in seeds and (45.0, 44.0) not in seeds
    assert got[1].bounds == [4.0, 4.0] + [3.0] * (len(seeds) - 2) and got[3].wx0 == 0 and got[3].wy0 == 0


def test_a_shared_lobe_takes_the_own_amplitude_and_needs_more_light(spark):
    """Two beads whose lobes coincide: the second is recovered with the first one's lobe when it is bright enough."""
    sep = 16.5
    for amp, found in ((180.0, 1), (24.0, 0)):
        img = 104 + np.random.default_rng(4).normal(0, 2, (N, N))
        y, x = np.mgrid[:N, :N]
        for cx, a in ((30.0, 180.0), (30.0 + sep, 180.0 + amp), (30.0 + 2 * sep, amp)):
            img += a * np.exp(-((x - cx) ** 2 + (y - 48.0) ** 2) / (2 * 2.2 ** 2))
        fr = spark.createDataFrame([("m", 1, N, N, [float(v) for v in img.ravel()])], FRAMES)
        first = rows(spark, [{"f": 1, "t": 1, "x1": 31.0, "y1": 49.0, "x2": 31.0 + sep, "y2": 49.0, "amp": 180}])
        req = spark.createDataFrame([("m", 1, 2, 31.0 + sep, 49.0, 31.0 + 2 * sep, 49.0, amp)], "movie string, frame_number int, track_number int, x1 double, y1 double, x2 double, y2 double, reference double")
        peaks = I.detect_peaks(fr)
        got = Y.refit_rows(Y.refit_windows(req, first, peaks), first, fr, DEFAULTS, curve(spark)).collect()
        assert len(got) == found
        for r in got:
            assert r.sharedLobe == 1 and r.track_number == 2 and r.amplitude1 == r.amplitude2 and abs(r.amplitude1 / amp - 1) < 0.1
            assert (r.lobeSignal1 is None) != (r.lobeSignal2 is None)


def test_recovered_rows_stay_off_existing_beads(spark):
    fr = frames(spark, {1: [(40.0, 48.0, 30.0, 180.0)]})
    p = lobes(40.0, 48.0, 30.0)
    req = spark.createDataFrame([("m", 1, 1, p["x1"], p["y1"], p["x2"], p["y2"], 180.0)], "movie string, frame_number int, track_number int, x1 double, y1 double, x2 double, y2 double, reference double")
    peaks = I.detect_peaks(fr)
    for beads, found in (([], 1), ([{"f": 1, "t": 9, "x": 43.0, "y": 50.0}], 0), ([{"f": 1, "t": 9, "x": 80.0, "y": 80.0}], 1)):
        near = rows(spark, beads) if beads else rows(spark, [{"f": 1, "t": 1}]).limit(0)
        assert len(Y.refit_rows(Y.refit_windows(req, near, peaks), near, fr, DEFAULTS, curve(spark)).collect()) == found
    assert Y.refit_rows(Y.refit_windows(req.withColumn("x1", F.col("x1") + 8).withColumn("x2", F.col("x2") - 8), near, peaks), near, fr, DEFAULTS, curve(spark)).count() == 0


def test_from_frames_to_the_output_table(spark):
    """Two beads over six frames, one of them too dim to be found in frame 4: one call gives tracks with depths, the recovered row and stabilized places."""
    turn = {f: 40.0 + 4.0 * f for f in range(1, 7)}
    beads = lambda f: [(30.0 + 0.4 * f, 30.0, turn[f], 160.0 if f != 4 else 11.0), (66.0 + 0.4 * f, 60.0, 120.0, 150.0)]
    fr = frames(spark, {f: beads(f) for f in turn})
    out = analyze(fr, curve(spark), replace(DEFAULTS, min_snr=8.0, seed_sigma_frames=0.0, recover_amplitude_fraction=0.0, recover_min_snr=2.0, split_max_tries=0))
    got = out.localizations.collect()
    assert len(got) == 12 and {r.track_number for r in got} == {1, 2} and {r.trackLength for r in got} == {6} and out.rejected.count() == 0
    assert [(r.frame_number, r.recovered) for r in got if r.recovered] == [(4, 1)] and sum(h["recovered"] for h in out.history) == 1
    for r in got:
        first = r.xMean < 50
        want = beads(r.frame_number)[0 if first else 1]
        assert abs(r.xMean - 1 - want[0]) < 0.6 and abs(r.zMicrons - (want[2] / 3 - 30)) < 1.5 and r.zStatus == 0 and r.fieldSeparationOffset == 0
        assert set(OUTPUT) <= set(r.asDict()) and r.zPrecisionUm > 0
    steady = [r.xStabilized for r in got if r.xMean > 50]
    assert np.ptp(steady) < 0.4 and out.drift.count() == 6
