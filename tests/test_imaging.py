from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from moteflow.operators import calibration as K, imaging as I
from moteflow.plans import image_np as N
from moteflow.schema import FRAMES
from moteflow.settings import DEFAULTS


def render(beads, n=96, seed=0):
    y, x = np.mgrid[:n, :n]
    img = 104 + np.random.default_rng(seed).normal(0, 2, (n, n))
    for cx, cy, a, amp in beads:
        sep = 16.5 + a / 45
        for s in (-.5, .5):
            img += amp * np.exp(-((x - cx - s * sep * np.cos(np.radians(a))) ** 2 + (y - cy - s * sep * np.sin(np.radians(a))) ** 2) / (2 * 2.2 ** 2))
    return img


def test_jacobian_is_the_derivative():
    rng = np.random.default_rng(10)
    x, y = rng.uniform(-10, 10, (2, 50))
    p = np.array([100, -2, 1, 2.2, 90, 5, -3, 3., 110, .1, -.2])
    _, J = N.model(p, x, y)
    for k in range(len(p)):
        d = np.zeros(len(p)); d[k] = 1e-5
        assert np.allclose(J[:, k], (N.model(p + d, x, y)[0] - N.model(p - d, x, y)[0]) / 2e-5, atol=1e-5, rtol=1e-5)


def test_noise_of_a_frame_and_its_row_form(spark):
    img = render([])
    f = spark.createDataFrame([("m", 1, 96, 96, [float(v) for v in img.ravel()])], FRAMES)
    noise = I.frame_noise(f.withColumn("pixels", F.transform("pixels", lambda v: v.cast("double")))).first().noise
    assert abs(noise - N.pixel_noise(np.float32(img).astype(float))) < 1e-6 and abs(noise - 2) < 0.2


def test_beads_are_found_where_they_are(spark):
    beads = {"iso": [(30.3, 30.7, 30., 200.), (42.1, 41.4, 120., 150.), (70.2, 70.6, 80., 60.)], "noise": [], "edge": [(8.5, 50.2, 90., 150.)]}
    fr = spark.createDataFrame([(m, 1, 96, 96, [float(v) for v in render(b, seed=i).ravel()]) for i, (m, b) in enumerate(beads.items())], FRAMES)
    curve = spark.range(0, 361).select(F.col("id").cast("int").alias("i"), (F.col("id") / 6.0 - 30).alias("z"), (F.col("id") / 2.0).alias("angle"), (F.lit(16.5) + F.col("id") / 90.0).alias("sep"))
    got = I.localize(fr, DEFAULTS, curve).toPandas()
    assert len(got) == 4 and not (got["movie"] == "noise").any()
    for m, b in beads.items():
        for cx, cy, a, amp in b:
            r = got[(got["movie"] == m) & (np.hypot(got["xMean"] - 1 - cx, got["yMean"] - 1 - cy) < 0.25)]
            assert len(r) == 1, (m, cx, cy)
            r = r.iloc[0]
            assert abs((r.angleDegrees - a + 90) % 180 - 90) < 1.5 and 0 < r.xPrecisionPx < 0.3
    lone = got[got["movie"] == "edge"].iloc[0]
    assert abs(lone.lobeSignal1 / (2 * np.pi * 150 * 2.2 ** 2) - 1) < 0.06 and abs(lone.backgroundLevel - 104) < 1
    cam = spark.range(0, 96 * 96).select(F.expr("cast(id div 96 as int)").alias("y"), (F.col("id") % 96).cast("int").alias("x"), F.lit(100.0).alias("offset"), F.lit(1.5).alias("variance"), F.lit(0.8).alias("gain"))
    lik = I.localize(fr.where("movie = 'edge'"), DEFAULTS, curve, signals=False, camera=cam).toPandas()
    assert len(lik) == 1 and abs(lik.iloc[0].yMean - 51.2) < 0.25


def test_camera_maps_are_placed_and_fall_back(spark):
    """The sensor is larger than the frame, which begins at (7, 11); the maps vary from pixel to pixel."""
    rng = np.random.default_rng(8)
    tall, wide = 130, 120
    maps = {"offset": 100 + rng.normal(0, 1.5, (tall, wide)), "variance": 1.4 * np.exp(rng.normal(0, .4, (tall, wide))), "gain": 0.8 * np.exp(rng.normal(0, .05, (tall, wide)))}
    cam = spark.createDataFrame([(y, x, *(float(maps[k][y, x]) for k in maps)) for y in range(tall) for x in range(wide)], "y int, x int, offset double, variance double, gain double")
    win = spark.createDataFrame([("in", 3, 4, 60, 70), ("one", 5, 5, 5, 5), ("out", 100, 4, 115, 20)], "window string, x0 int, y0 int, x1 int, y1 int")
    got = {r.window: r.camera for r in I.window_camera(win, cam, (7, 11)).collect()}
    assert got["out"] is None and len(got["in"]) == 4
    for (o, v, g), (x0, y0, x1, y1) in ((I._assembled(got["in"], (3, 4), (67, 58)), (3, 4, 60, 70)), (I._assembled(got["one"], (5, 5), (1, 1)), (5, 5, 5, 5))):
        for m, k in ((o, "offset"), (v, "variance"), (g, "gain")):
            assert np.array_equal(m, maps[k][y0 + 11:y1 + 12, x0 + 7:x1 + 8].ravel())
    gap = {r.window: r.camera for r in I.window_camera(win, cam.where("NOT (y = 40 AND x = 30)"), (7, 11)).collect()}
    assert gap["in"] is None and gap["one"] is None  # their tile lacks a pixel
    y, x = np.indices((96, 96))
    photons = 3 + sum(30 * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * 2.1 ** 2)) for cx, cy in ((39.7, 44.1), (55.9, 50.3)))
    part = {k: m[11:107, 7:103] for k, m in maps.items()}
    img = part["offset"] + part["gain"] * rng.poisson(photons) + rng.normal(0, 1, (96, 96)) * np.sqrt(part["variance"])
    fr = spark.createDataFrame([("m", 1, 96, 96, [float(v) for v in img.ravel()])], FRAMES)
    lik, = I.localize(fr, DEFAULTS, signals=False, camera=cam, place=(7, 11)).collect()
    assert np.hypot(lik.xMean - 48.8, lik.yMean - 48.2) < 0.3 and 0 < lik.anglePrecisionDeg < 3
    off, = I.localize(fr, DEFAULTS, signals=False, camera=cam, place=(100, 100)).collect()
    plain, = I.localize(fr, DEFAULTS, signals=False).collect()
    assert (off.xMean, off.yMean) == (plain.xMean, plain.yMean) != (lik.xMean, lik.yMean)


def test_camera_windows_are_cut_once_and_shared_out(spark):
    """Many windows lie on few places of one small sensor: each place is cut once, and the places of a tile are dealt to several shares."""
    tall, wide = 70, 90
    maps = np.random.default_rng(3).normal(0, 1, (3, tall, wide))
    pix = [(y, x, *(float(v) for v in maps[:, y, x])) for y in range(tall) for x in range(wide)]
    schema = "y int, x int, offset double, variance double, gain double"
    cam = spark.createDataFrame(pix, schema)
    one = spark.range(3000).selectExpr("id % 50 AS _x0", "id div 50 AS _y0", "id % 50 + 3 AS _x1", "id div 50 + 2 AS _y1")
    cover, shares = I.tile_cover(one, (2, 1))
    dealt = cover.toPandas()
    n = dealt.groupby(["_ty", "_tx", "_s"]).size()
    assert len(dealt) == 3000 and n.max() < 2 * I.SHARE and len(n) == shares.collect()[0]._shares == -(-3000 // I.SHARE)
    # 600 windows on 40 places, some across tiles or off the sensor
    win = spark.range(600).selectExpr("'w' || id AS window", "cast(id % 40 * 3 - 6 AS int) AS x0", "cast(id % 40 * 2 - 4 AS int) AS y0").selectExpr("*", "x0 + 7 AS x1", "y0 + 5 AS y1") \
        .union(spark.sql("SELECT 'none', NULL, NULL, NULL, NULL"))
    got = I.window_camera(win, cam, (2, 1)).collect()
    assert len(got) == 601 and len({r.window for r in got}) == 601
    on = 0
    for r in got:
        if r.x0 is None or r.x0 + 2 < 0 or r.y0 + 1 < 0 or r.x1 + 2 >= wide or r.y1 + 1 >= tall:
            assert r.camera is None
            continue
        on += 1
        assert np.array_equal(I._assembled(r.camera, (r.x0, r.y0), (6, 8)), maps[:, r.y0 + 1:r.y1 + 2, r.x0 + 2:r.x1 + 3].reshape(3, -1))
    places = I.camera_places(win, cam, (2, 1)).collect()
    assert on == 15 * len(places) and len(places) == len({(r.x0, r.y0) for r in places}) > 15
    # a pixel repeated in the place of another leaves out its tile alone
    twice = spark.createDataFrame([(*((10, 11) if p[:2] == (10, 10) else p[:2]), *p[2:]) for p in pix], schema)
    assert {(r._ty, r._tx) for r in I.camera_tiles(twice).collect()} == {(0, 1), (1, 0), (1, 1)}


def test_merged_lobes_of_two_beads_are_split(spark):
    """The inner lobes of two beads lie 5 px apart and are fitted as one wide lobe; only the split gives both beads."""
    curve = spark.range(0, 361).select(F.col("id").cast("int").alias("i"), (F.col("id") / 6.0 - 30).alias("z"), (F.col("id") / 2.0).alias("angle"), (F.lit(16.5) + F.col("id") / 90.0).alias("sep"))
    a, b = 16.5, 16.5 + 60 / 45
    inner = np.array([70 + a / 2, 85.0])
    second = inner + np.array([np.cos(np.radians(60)), np.sin(np.radians(60))]) * b / 2
    beads = [(70.0, 80.0, 0.0, 150.0), (*second, 60.0, 150.0)]
    fr = spark.createDataFrame([("m", 1, 160, 160, [float(v) for v in render(beads, n=160, seed=0).ravel()])], FRAMES)
    near = lambda rows, cx, cy: any(np.hypot(r.xMean - 1 - cx, r.yMean - 1 - cy) < 0.6 for r in rows)
    rows = I.localize(fr, DEFAULTS, curve, signals=False).collect()
    assert len(rows) == 2 and all(near(rows, cx, cy) for cx, cy, *_ in beads)
    merged = I.localize(fr, replace(DEFAULTS, split_sigma_ratio=100.0), curve, signals=False).collect()
    assert not all(near(merged, cx, cy) for cx, cy, *_ in beads)
    assert I.localize(fr, replace(DEFAULTS, split_max_tries=0), curve, signals=False).count() == len(merged)


def test_long_axis_of_two_points():
    y, x = (g.ravel() for g in np.indices((40, 40), dtype=float))
    light = sum(100 * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * 2.2 ** 2)) for cx, cy in ((18.0, 18.5), (21.0, 22.5)))
    halves = N.long_axis_halves(light, x, y, np.array([150, 19.5, 20.5, 3.4]))
    assert np.allclose(sorted(map(tuple, halves)), [(18.0, 18.5), (21.0, 22.5)], atol=0.35)
    assert N.long_axis_halves(100 * np.exp(-((x - 20) ** 2 + (y - 20) ** 2) / 10), x, y, np.array([100, 20, 20, 2.2])) is None
    assert N.long_axis_halves(-light, x, y, np.array([150, 19.5, 20.5, 3.4])) is None


def test_field_map_shifts_the_expected_separation(spark):
    """A saddle of 3 px: lobes stand 3 px closer in the corner (u = -1, v = 1), where a compact bead is paired only with the map."""
    n = 256
    curve = spark.range(0, 361).select(F.col("id").cast("int").alias("i"), (F.col("id") / 6.0 - 30).alias("z"), (F.col("id") / 2.0).alias("angle"), (F.lit(16.5) + F.col("id") / 90.0).alias("sep"))
    maps = spark.createDataFrame([("m", [0.0, 0.0, 0.0, 0.0, 3.0, 0.0])], "movie string, coef array<double>")
    mapped = K.FieldCurve(curve, maps, (0.0, 0.0), float(n))
    at = spark.createDataFrame([("m", 90.0, 18.5 - 3, 1.0, float(n)), ("m", 90.0, 18.5, (n + 1) / 2, (n + 1) / 2), ("other", 90.0, 18.5, 1.0, float(n))], "movie string, a double, s double, x double, y double")
    for c, want in ((mapped, [0.0, 0.0, 0.0]), (curve, [-3.0, 0.0, 0.0])):
        got = K.separation_residual(at, c, F.col("a"), F.col("s"), at=(F.col("x"), F.col("y"))).collect()
        assert np.allclose(sorted(r.residual for r in got), sorted(want), atol=0.05)
    y, x = np.mgrid[:n, :n]
    img = 104 + np.random.default_rng(2).normal(0, 2, (n, n))
    for s in (-.5, .5):
        img += 150 * np.exp(-((x - 14.3) ** 2 + (y - (n - 21.8) - s * (18.5 - 2.2)) ** 2) / (2 * 2.2 ** 2))
    fr = spark.createDataFrame([("m", 1, n, n, [float(v) for v in img.ravel()])], FRAMES)
    cfg = replace(DEFAULTS, sep_gate_px=1.5, prune_slack_px=0.0, split_max_tries=0)
    assert I.localize(fr, cfg, curve, signals=False).count() == 0
    found = I.localize(fr, cfg, mapped, signals=False)
    row, = found.collect()
    assert abs(row.xMean - 15.3) < 0.2 and abs(row.yMean - (n - 20.8)) < 0.2 and abs(row.separationResidual) < 0.4
    deep = K.depths(found.drop("zMicrons", "zStatus"), mapped).first()
    assert deep.zStatus == 0 and abs(deep.zMicrons) < 1 and -3 < deep.fieldSeparationOffset < -1.5


def test_drawn_frames_leave_in_small_batches(spark, sf, monkeypatch):
    from pyspark.sql import functions as F
    from moteflow.catalog import views as V
    df = V.bead_frames(spark, sf)
    digest = lambda d: {(r.movie, r.frame): r.h for r in d.select("movie", "frame", F.xxhash64("pixels").alias("h")).collect()}
    whole = digest(df)
    monkeypatch.setattr(V, "DRAWN", 1)
    assert digest(V.bead_frames(spark, sf)) == whole
    lowest = {m: min(f for n, f in whole if n == m) for m, _ in whole}
    assert digest(V.bead_frames(spark, sf, first=True)) == {k: h for k, h in whole.items() if lowest[k[0]] == k[1]}


def test_window_fit_needs_only_sums_along_the_axes():
    """Heights, pull and curvature of the separable sums are those of all pixels."""
    rng = np.random.default_rng(5)
    h, w, theta = 26, 31, np.array([[-4.0, 2.0, 2.1], [5.5, -3.0, 2.6], [0.5, 6.0, 1.7]])
    y, x = (g.ravel() - (n - 1) / 2 for g, n in zip(np.indices((h, w), dtype=float), (h, w)))
    bells, slopes = N._bells(theta, x, y)
    columns = np.column_stack([bells, np.ones(h * w), x, y])
    values = columns @ [120.0, 80.0, 60.0, 100.0, 0.1, -0.2] + rng.normal(0, 2, h * w)
    pixels = N._LeastSquares(values.reshape(h, w), x[:w], y[::w])
    fit = pixels.solved(theta + 0.2)
    bells, slopes = N._bells(theta + 0.2, x, y)
    columns[:, :3] = bells
    factor = np.linalg.lstsq(columns, values)[0]
    off = values - columns @ factor
    turn = (slopes * factor[:3, None]).reshape(h * w, -1)
    turn -= columns @ np.linalg.lstsq(columns, turn)[0]
    pull, curve = pixels.turned(fit)
    assert np.allclose(fit.factor, factor, rtol=1e-6) and abs(fit.cost / (off @ off) - 1) < 1e-9
    assert np.allclose(pull, turn.T @ off, rtol=1e-6, atol=1e-5) and np.allclose(curve, turn.T @ turn, rtol=1e-6, atol=1e-5)


def test_peaks_of_averaged_frames_need_no_averages_as_rows(spark):
    """Averages across block ends and gaps, and the same peaks whether they travel or not."""
    shots = [f for f in range(60, 70) if f != 66]
    img = {(m, f): render([(30.3 + (f - 60) / 5, 30.7, 30., 200.)], n=64, seed=f + s).astype(np.float32) for s, m in enumerate("ab") for f in shots}
    fr = spark.createDataFrame([(m, f, 64, 64, [float(v) for v in p.ravel()]) for (m, f), p in img.items()], FRAMES)
    seeds = I.seed_average(fr, 1.0)
    got = {(r.movie, r.frame): np.array(r.seed).reshape(64, 64) for r in seeds.collect()}
    assert len(got) == len(img)
    for (m, f), s in got.items():
        gain = {k: np.exp(-k * k / 2) for k in range(-2, 3) if (m, f + k) in img}
        assert np.allclose(s, sum(g * img[m, f + k].astype(float) for k, g in gain.items()) / sum(gain.values()))
    order = ["movie", "frame", "x", "y"]
    travelled = I.detect_peaks(seeds).toPandas().sort_values(order).reset_index(drop=True)
    made = I.detect_peaks(fr, DEFAULTS, 1.0).toPandas().sort_values(order).reset_index(drop=True)
    assert len(made) and made.equals(travelled)


def test_drawn_frames_do_not_travel(spark, sf, monkeypatch, tmp_path):
    """Frames drawn in the tasks that use them give the beads of stored frames, and neither pixels nor the steps between stay in the checkpoint folder."""
    import pyarrow.parquet as pq
    from moteflow import session
    from moteflow.catalog import imaging as Q, views as V
    monkeypatch.setattr(session, "checkpoint_dir", lambda _: str(tmp_path))
    found = Q.localized_beads(spark, sf).toPandas()
    tables = [t for t in (tmp_path / "moteflow").iterdir()]
    assert len(tables) == 2 and not any("pixels" in pq.read_schema(f).names for t in tables for f in t.glob("*.parquet"))
    stored = I.localize(session.cut(V.bead_frames(spark, sf)), DEFAULTS, V.bead_curve(spark)).drop("background").toPandas()
    assert len(found) and found.sort_values("row_id").reset_index(drop=True).equals(stored.sort_values("row_id").reset_index(drop=True))


def test_scratch_tables_are_deleted_unless_kept(spark, monkeypatch, tmp_path):
    from moteflow import session
    monkeypatch.setattr(session, "checkpoint_dir", lambda _: str(tmp_path))
    left = lambda: len(list((tmp_path / "moteflow").iterdir()))
    out = session.cut(spark.range(3))
    with session.scratch() as keep:
        session.cut(spark.range(4))
        with session.scratch() as inner:
            a, b = session.cut(spark.range(5)), inner(session.cut(spark.range(6)))
        assert left() == 3 and b.count() == 6
        c = keep(session.cut(spark.range(7)))
    assert left() == 2 and c.count() == 7 and out.count() == 3
