"""Predicting and recovering localizations that tracks are missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from moteflow.functions.axial import axial_difference
from moteflow.functions.pairs import pair_angle
from moteflow.operators import cleaning as C, imaging as I, linking as L
from moteflow.operators.tracks import TRACK
from moteflow.plans.spatial import near_join, nearest_k
from moteflow.session import cut
from moteflow.settings import DEFAULTS, Settings

LOBES = ["x1", "y1", "x2", "y2"]


def missing_frames(rows: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Frames a track of enough rows misses within reach of an observation, with the rows before and
    after. One window pass over each track's own frames."""
    last = rows.groupBy("movie").agg(F.max("frame_number").alias("_last"))
    t = rows.groupBy(*TRACK).agg(F.count("*").alias("_n"), F.min("frame_number").alias("_f0"), F.max("frame_number").alias("_f1")) \
        .where(F.col("_n") >= cfg.recover_min_track).join(last, "movie")
    reach = cfg.recover_reach_frames
    grid = t.select(*TRACK, F.explode(F.sequence(F.greatest(F.lit(1), F.col("_f0") - reach), F.least("_last", F.col("_f1") + reach))).alias("frame_number"))
    obs = rows.select(*TRACK, "frame_number", F.struct("frame_number", *LOBES, "xMean", "yMean").alias("_o"))
    w = Window.partitionBy(*TRACK).orderBy("frame_number")
    g = grid.join(obs, [*TRACK, "frame_number"], "left").withColumns({
        "before": F.last("_o", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "after": F.first("_o", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))}).where("_o IS NULL").drop("_o")
    f = F.col("frame_number")
    near = F.least(F.coalesce(f - F.col("before.frame_number"), F.lit(10 ** 6)), F.coalesce(F.col("after.frame_number") - f, F.lit(10 ** 6)))
    return g.where(near <= reach)


def reference_amplitude(rows: DataFrame) -> DataFrame:
    """Median weaker-lobe amplitude of a track over its detected rows (all rows when none is detected)."""
    low = F.least("amplitude1", "amplitude2")
    return rows.groupBy(*TRACK).agg(F.coalesce(F.median(F.when(F.col("recovered") != 1, low)), F.median(low)).alias("reference"))


def recovery_requests(rows: DataFrame, cfg: Settings = DEFAULTS, radius: float = 200.0) -> DataFrame:
    """Predicted lobes (x1, y1, x2, y2) per missing (track, frame): linear inside a gap, beyond the ends
    the nearest row moved with the median motion of the beads around it."""
    miss = cut(missing_frames(rows, cfg))
    b, a, f = F.col("before"), F.col("after"), F.col("frame_number")
    d = lambda p, q: F.sqrt(sum(((b[f"{c}{i}"] - a[f"{c}{j}"]) * (b[f"{c}{i}"] - a[f"{c}{j}"]) for c, i, j in (("x", p[0], p[1]), ("y", p[0], p[1]))), F.lit(0.0)))
    straight = d((1, 1), 0) + d((2, 2), 0) <= d((1, 2), 0) + d((2, 1), 0)
    w = (f - b["frame_number"]) / (a["frame_number"] - b["frame_number"])
    inner = miss.where("before IS NOT NULL AND after IS NOT NULL")
    lin = {f"{c}{i}": (F.lit(1.0) - w) * b[f"{c}{i}"] + w * F.when(straight, a[f"{c}{i}"]).otherwise(a[f"{c}{3 - i}"]) for c in "xy" for i in (1, 2)}
    inner = inner.select(*TRACK, "frame_number", *[e.alias(n) for n, e in lin.items()])

    outer = cut(miss.where("before IS NULL OR after IS NULL").select(*TRACK, "frame_number", F.coalesce("before", "after").alias("o"))
                .withColumns({"g": F.col("o.frame_number"), "px": F.col("o.xMean"), "py": F.col("o.yMean"), "req": F.xxhash64(*TRACK, "frame_number")}))
    need = outer.select("movie", "g", "frame_number").distinct()
    at = rows.select("movie", F.col("track_number").alias("t2"), F.col("frame_number").alias("fr"), "xMean", "yMean")
    motion = need.join(at.withColumnsRenamed({"fr": "g", "xMean": "gx", "yMean": "gy"}), ["movie", "g"]) \
        .join(at.withColumnsRenamed({"fr": "frame_number", "xMean": "fx", "yMean": "fy"}), ["movie", "t2", "frame_number"]) \
        .select("movie", "g", "frame_number", "t2", "gx", "gy", (F.col("fx") - F.col("gx")).alias("mx"), (F.col("fy") - F.col("gy")).alias("my"))
    motion = cut(motion)
    on = ["movie", "g", "frame_number"]
    reqs = outer.select(*on, "req", "px", "py")
    near = near_join(motion, reqs, radius, on, ("gx", "gy"), ("px", "py"))
    shift = cut(near.groupBy(*on, "req").agg(F.count("*").alias("k"), F.median("mx").alias("sx"), F.median("my").alias("sy")).where("k >= 3").drop("k"))
    rest = reqs.join(shift.select("req"), "req", "left_anti")
    if not rest.isEmpty():  # too few beads around: the five nearest ones
        dist = F.sqrt((F.col("px") - F.col("gx")) * (F.col("px") - F.col("gx")) + (F.col("py") - F.col("gy")) * (F.col("py") - F.col("gy")))
        five = nearest_k(rest, motion, 5, on, ("px", "py"), ("gx", "gy"), "req", dist, radius, "t2")
        if five is not None:
            shift = shift.unionByName(five.groupBy(*on, "req").agg(F.median("row.mx").alias("sx"), F.median("row.my").alias("sy")))
    moved = outer.join(shift.select("req", "sx", "sy"), "req", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("sx", "sy")})
    outer = moved.select(*TRACK, "frame_number", *[(F.col(f"o.{c}") + F.col("s" + c[0])).alias(c) for c in LOBES])
    cols = [*TRACK, "frame_number", *LOBES]
    return inner.select(cols).unionByName(outer.select(cols)).join(reference_amplitude(rows), TRACK)


def not_removed_before(added: DataFrame, gone: DataFrame) -> DataFrame:
    """Recovered rows except those at the place (< 1 px) and angle (< 3 deg) of a removed row: the nearest
    removed row of the frame decides."""
    g = gone.select("movie", "frame_number", F.col("row_id").alias("gid"), F.col("xMean").alias("gx"), F.col("yMean").alias("gy"), F.col("angleDegrees").alias("ga"))
    d2 = (F.col("xMean") - F.col("gx")) * (F.col("xMean") - F.col("gx")) + (F.col("yMean") - F.col("gy")) * (F.col("yMean") - F.col("gy"))
    near = near_join(added.select("movie", "frame_number", "row_id", "xMean", "yMean", "angleDegrees"), g, 1.0, ["movie", "frame_number"], ("xMean", "yMean"), ("gx", "gy"), d2 < 1)
    best = near.groupBy("movie", "frame_number", "row_id").agg(F.min_by(F.abs(axial_difference(F.col("angleDegrees"), F.col("ga"))), F.struct(d2, "gid")).alias("turn"))
    return added.join(best.where("turn < 3").select("row_id"), "row_id", "left_anti")


def accept_recovered(fits: DataFrame, existing: DataFrame, noise: Column, cfg: Settings = DEFAULTS, near_px: float = 4.0) -> DataFrame:
    """Refitted rows that are bright enough, turned little, cheap as a pair, inside the image and not on an
    existing bead. A bead that shares a lobe must reach the floor of shared lobes. Expects predicted_angle, reference, pairCost, width, height, sharedLobe;
    a null pairCost breaks a hard limit and is refused."""
    floor = F.greatest(noise * cfg.recover_min_snr, F.col("reference") * cfg.recover_amplitude_fraction,
                       F.when(F.col("sharedLobe") == 1, noise * cfg.shared_min_snr))
    ok = (F.least("amplitude1", "amplitude2") >= floor) & (F.abs(axial_difference(F.col("angleDegrees"), F.col("predicted_angle"))) <= cfg.recover_max_turn_deg) \
        & (F.col("pairCost") <= cfg.pair_gate_cost)
    for c, lim in (("x1", "width"), ("x2", "width"), ("y1", "height"), ("y2", "height")):
        ok = ok & F.col(c).between(1, F.col(lim))
    e = existing.select("movie", "frame_number", F.col("xMean").alias("ex"), F.col("yMean").alias("ey"))
    d2 = (F.col("xMean") - F.col("ex")) * (F.col("xMean") - F.col("ex")) + (F.col("yMean") - F.col("ey")) * (F.col("yMean") - F.col("ey"))
    return near_join(fits.where(ok), e, near_px, ["movie", "frame_number"], ("xMean", "yMean"), ("ex", "ey"), d2 < near_px ** 2, "left_anti")


def refit_windows(requests: DataFrame, existing: DataFrame, peaks: DataFrame, cfg: Settings = DEFAULTS, reach: float = 3.0, cell: float = 32.0) -> DataFrame:
    """The window of each request(movie, frame_number, track_number, x1, y1, x2, y2, reference): its box around the predicted lobes and its seeds, which are the two
    predictions, then the lobes of existing rows and then nuisance peaks inside the box. A prediction within ``reach`` of an existing lobe is that lobe: the lobe is
    no seed and the prediction is ``shared``. Requests with both lobes shared, with a box too small to fit or with too many seeds give no window.
    ``peaks`` has movie, frame, x, y, value, strong, height, width (zero-based); every frame with peaks has a size."""
    pad, near2 = cfg.fit_padding, reach * reach
    size = peaks.groupBy("movie", F.col("frame").alias("frame_number")).agg(F.first("height").alias("height"), F.first("width").alias("width"), F.max("strong").alias("strong"), F.max("noise").alias("noise"))
    win = requests.join(size, ["movie", "frame_number"]).withColumns({
        "wx0": F.greatest(F.floor(F.least("x1", "x2") - 1 - pad), F.lit(0)), "wy0": F.greatest(F.floor(F.least("y1", "y2") - 1 - pad), F.lit(0)),
        "wx1": F.least(F.ceil(F.greatest("x1", "x2") - 1 + pad), F.col("width") - 1), "wy1": F.least(F.ceil(F.greatest("y1", "y2") - 1 + pad), F.col("height") - 1)})
    win = win.where("wx1 - wx0 >= 4 AND wy1 - wy0 >= 4")
    lobe = F.explode(F.array(*[F.struct((F.col(f"x{i}") - 1).alias("x"), (F.col(f"y{i}") - 1).alias("y")) for i in (1, 2)]))
    known = existing.select("movie", "frame_number", lobe.alias("l"), F.lit(0).alias("kind")).select("movie", "frame_number", "kind", "l.x", "l.y")
    bright = peaks.where(F.col("value") >= F.col("strong") * cfg.weak_fraction * 1.5).select("movie", F.col("frame").alias("frame_number"), F.lit(1).alias("kind"), "x", "y")
    spots = known.unionByName(bright).withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    on = ["movie", "frame_number"]
    cover = win.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("wx0") / cell), F.floor(F.col("wx1") / cell)))) \
        .withColumn("_cy", F.explode(F.sequence(F.floor(F.col("wy0") / cell), F.floor(F.col("wy1") / cell))))
    key = [*on, "track_number"]
    inside = cover.select(*key, "_cx", "_cy", "wx0", "wy0", "wx1", "wy1").join(spots, [*on, "_cx", "_cy"]) \
        .where(F.col("x").between(F.col("wx0"), F.col("wx1")) & F.col("y").between(F.col("wy0"), F.col("wy1")))
    # at most the spots of one window
    near = inside.groupBy(*key).agg(F.array_sort(F.collect_set(F.when(F.col("kind") == 0, F.struct("x", "y")))).alias("lobes"),
                                    F.array_sort(F.collect_set(F.when(F.col("kind") == 1, F.struct("x", "y")))).alias("peaks"))
    none = F.array().cast("array<struct<x:double,y:double>>")
    win = win.join(near, key, "left").withColumns({"lobes": F.coalesce("lobes", none), "peaks": F.coalesce("peaks", none)})
    d2 = lambda s, x, y: (s["x"] - x) * (s["x"] - x) + (s["y"] - y) * (s["y"] - y)
    own = [(F.col(f"x{i}") - 1, F.col(f"y{i}") - 1) for i in (1, 2)]
    win = win.withColumns({"shared1": F.exists("lobes", lambda s: d2(s, *own[0]) <= near2), "shared2": F.exists("lobes", lambda s: d2(s, *own[1]) <= near2)})
    win = win.withColumn("lobes", F.filter("lobes", lambda s: (d2(s, *own[0]) > near2) & (d2(s, *own[1]) > near2)))
    apart = lambda s: (d2(s, *own[0]) > near2) & (d2(s, *own[1]) > near2) & ~F.exists("lobes", lambda o: d2(s, o["x"], o["y"]) <= near2)
    seeds = F.concat(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in own]), F.col("lobes"), F.filter("peaks", apart))
    win = win.withColumn("seeds", seeds).where((F.size("seeds") <= 2 * cfg.max_group_gaussians) & ~(F.col("shared1") & F.col("shared2")))
    bounds = F.concat(F.array_repeat(F.lit(float(cfg.recover_center_bound)), 2), F.array_repeat(F.lit(float(cfg.center_bound)), F.size("seeds") - 2))
    return win.withColumn("bounds", bounds).drop("lobes", "peaks", "strong")


def refit_rows(windows: DataFrame, existing: DataFrame, frames: DataFrame, cfg: Settings = DEFAULTS, curve: DataFrame | I.K.FieldCurve | None = None) -> DataFrame:
    """Accepted localizations of the windows of ``refit_windows``, with the track they were predicted from. All windows of a frame travel with one read of it; a window's
    fit is bound to its predictions, and what passes is decided by columns."""
    name = F.concat_ws("/", "movie", "frame_number", "track_number")
    asked = windows.select("movie", F.col("frame_number").alias("frame"), name.alias("window"), "track_number", "reference", "noise", "shared1", "shared2", "height", "width",
                           pair_angle(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("predicted_angle"),
                           *[F.col("w" + c).alias(c) for c in ("x0", "y0", "x1", "y1")], "seeds", "bounds")
    asked = cut(asked)
    lobes = cut(I.fit_lobes(I.window_crops(asked.select("movie", "frame", "window", "x0", "y0", "x1", "y1", "seeds", "bounds"), frames), cfg).where("lobe < 2"))
    on = ["movie", "frame", "window"]
    keep = ["lobe", "x", "y", "amp", "sigma", "rms", "background", "cov_rows", "at_bound"]
    side = lambda k, p: lobes.where(F.col("lobe") == k).select(*on, *[F.col(c).alias(f"{p}_{c}") for c in keep])
    both = side(0, "p").join(side(1, "q"), on).join(asked.drop("seeds", "bounds", "x0", "y0", "x1", "y1"), on).where("NOT p_at_bound AND NOT q_at_bound")
    # the own lobe comes first; the amplitude of a hidden one is unobservable and taken from it
    hidden = F.col("shared1")
    pick = lambda first, c: F.when(hidden == first, F.col("q_" + c)).otherwise(F.col("p_" + c))
    shared = F.col("shared1") | F.col("shared2")
    ab = both.select(*on, "track_number", "reference", "noise", "height", "width", "predicted_angle", shared.cast("int").alias("sharedLobe"),
                     *[pick(F.lit(True), c).alias("a_" + c) for c in keep], *[pick(F.lit(False), c).alias("b_" + c) for c in keep])
    ab = ab.withColumns({"b_amp": F.when(F.col("sharedLobe") == 1, F.col("a_amp")).otherwise(F.col("b_amp")), "a_noise": F.col("noise"), "jointEmitterCount": F.lit(1),
                         "a_id": F.concat_ws("/", "window", "a_lobe"), "b_id": F.concat_ws("/", "window", "b_lobe")})
    ab = I.scored_pairs(ab, cfg, curve, F.col("a_amp")).where("pairCost IS NOT NULL")
    rows = I.to_localizations(ab, recovered=1)
    more = ab.select(F.xxhash64("movie", "frame", "a_id", "b_id").alias("row_id"), "movie", "track_number", "reference", "predicted_angle", "height", "width")
    fits = rows.join(more, ["movie", "row_id"])
    return accept_recovered(fits, existing, F.col("noise"), cfg).drop("reference", "predicted_angle", "height", "width")


def suspicious_rows(rows: DataFrame, cfg: Settings, z: str) -> DataFrame:
    """(row_id) flagged by any of the four tests: jumps, minority depths, sandwiched and ghost tracks."""
    by_row = C.jump_outliers(rows, cfg, z).select("row_id").unionByName(C.alternating_rows(rows, cfg, z).select("row_id"))
    tracks = C.sandwiched_tracks(rows, cfg, z).unionByName(C.ghost_tracks(rows, cfg, z)).distinct()
    return cut(by_row.unionByName(rows.join(tracks, TRACK, "left_semi").select("row_id")).distinct())


def pixel_refit(frames: DataFrame, peaks: DataFrame, cfg: Settings = DEFAULTS, curve: DataFrame | I.K.FieldCurve | None = None,
                with_depth: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The refit of ``recover`` on the pixels of ``frames``, whose ``peaks`` are those of ``detect_peaks``; ``with_depth`` fills the depth columns of refitted rows.
    Only new requests are fitted: one whose prediction, brightness and seeds have all been tried in an earlier round would end the same way."""
    cause, tried = ["movie", "frame_number", *LOBES, "reference", "seeds", "shared1", "shared2"], []

    def run(requests: DataFrame, now: DataFrame) -> DataFrame:
        fresh = refit_windows(requests, now, peaks, cfg)
        for before in tried:
            fresh = fresh.join(before, cause, "left_anti")
        fresh = cut(fresh)
        tried.append(fresh.select(cause))
        added = refit_rows(fresh, now, frames, cfg, curve)
        added = added if with_depth is None else with_depth(added)
        return added.select([c for c in added.columns if c in now.columns])
    return run


def recover(rows: DataFrame, refit: Callable[[DataFrame, DataFrame], DataFrame], cfg: Settings = DEFAULTS,
            z: str = "z", depth: bool = True) -> tuple[DataFrame, DataFrame, list[dict]]:
    """Clean, predict, refit and track again until a round neither removes nor adds, at most
    ``recover_rounds`` times. ``refit(requests, rows)`` returns new rows with the columns of ``rows``.
    Returns (rows with track_number, removed rows, history of counts)."""
    def tracked(r: DataFrame) -> DataFrame:
        lab = L.track_lap(r, cfg, depth=depth).select("row_id", "track_number")
        return cut(r.drop("track_number").join(lab, "row_id"))

    now, removed, history = tracked(rows), None, []
    for k in range(cfg.recover_rounds):
        bad = suspicious_rows(now, cfg, z)
        n_bad = bad.count()
        if n_bad:
            out = cut(now.join(bad, "row_id", "left_semi"))
            removed = out if removed is None else removed.unionByName(out)
            now = cut(now.join(bad, "row_id", "left_anti"))
        requests = cut(recovery_requests(now, cfg))
        added = refit(requests, now)
        if removed is not None:
            added = not_removed_before(added, removed)
        added = cut(added)
        n_add = added.count()
        history.append({"round": k + 1, "requests": requests.count(), "recovered": n_add, "removed": n_bad})
        if not n_add and not n_bad:
            break
        now = tracked(C.deduplicate(now.unionByName(added, allowMissingColumns=True)))
    return now, removed if removed is not None else now.limit(0), history
