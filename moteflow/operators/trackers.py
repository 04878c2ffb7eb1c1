"""Trackers that follow predictions frame by frame, run on independent islands of the field.

Frame order is sequential, but tracks only meet detections within a gate. The field is divided into
islands of neighbouring occupied cells; each island is streamed in frame order through a small kernel that
holds only the active tracks, so neither a large movie nor a large island is ever held in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from moteflow.operators.linking import number_tracks, track_lap
from moteflow.plans.graph import connected_components
from moteflow.plans.kernels import assign_edges, gated_pairs
from moteflow.plans.number import shares
from moteflow.plans.spatial import near_join
from moteflow.session import cut
from moteflow.settings import DEFAULTS, Settings

OUT = T.StructType([T.StructField("movie", T.StringType()), T.StructField("island", T.LongType()),
                    T.StructField("frame_number", T.IntegerType()), T.StructField("row_id", T.LongType()),
                    T.StructField("first_row", T.LongType()), T.StructField("px", T.DoubleType()),
                    T.StructField("py", T.DoubleType()), T.StructField("gate", T.DoubleType())])


def islands(rows: DataFrame, size: float) -> DataFrame:
    """Rows with ``island``: occupied cells of ``size`` px joined with their occupied neighbours, over all
    frames. Rows of different islands are more than ``size`` apart at all times."""
    cells = rows.select("movie", F.floor(F.col("xMean") / size).alias("cx"), F.floor(F.col("yMean") / size).alias("cy"))
    ids = cut(cells.distinct().withColumn("cell", F.xxhash64("movie", "cx", "cy")))
    half = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, -1), (1, 0), (1, 1), (0, 1))])
    nb = ids.withColumn("o", F.explode(half)).select("movie", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), F.col("cell").alias("a"))
    comp = connected_components(nb.join(ids.withColumnRenamed("cell", "b"), ["movie", "cx", "cy"]).select("a", "b"))
    named = ids.join(comp.withColumnRenamed("node", "cell"), "cell", "left") \
        .select("movie", "cx", "cy", F.coalesce("component", "cell").alias("island"))
    return rows.withColumns({"cx": F.floor(F.col("xMean") / size), "cy": F.floor(F.col("yMean") / size)}) \
        .join(named, ["movie", "cx", "cy"]).drop("cx", "cy")


class KalmanLinker:
    """Active constant-velocity tracks of one island. Both axes share one covariance."""

    def __init__(self, cfg: Settings):
        self.c = cfg
        self.pos = np.zeros((0, 4))
        self.cov = np.zeros((0, 3))
        self.miss = np.zeros(0, int)
        self.angle = np.zeros(0)
        self.first = np.zeros(0, np.int64)

    def advance(self) -> None:
        q = self.c.kalman_process_noise ** 2
        self.pos[:, :2] += self.pos[:, 2:]
        p, c, v = self.cov.T
        self.cov = np.column_stack((p + 2 * c + v + q / 4, c + v + q / 2, v + q))

    def gates(self) -> np.ndarray:
        return np.where(self.miss == 0, self.c.link_distance_px, self.c.gap_distance_px)

    def step(self, x, y, angle, ids) -> np.ndarray:
        """Match one frame's detections; returns the first row of each detection's track."""
        gate = self.gates()
        t, d, cost = gated_pairs(self.pos[:, 0], self.pos[:, 1], gate, x, y)
        turn = (self.angle[t] - angle[d] + 90) % 180 - 90
        cost = cost + (turn / self.c.angle_cost_deg) ** 2
        w = self.c.gap_distance_px ** 2 - cost
        t, d, w = t[w > 0], d[w > 0], w[w > 0]
        ok = assign_edges(t, d, w)
        t, d = t[ok], d[ok]
        r = self.c.kalman_measurement_noise ** 2
        gain = self.cov[t][:, :2] / (self.cov[t][:, :1] + r)
        for k, z in enumerate((x, y)):
            e = z[d] - self.pos[t, k]
            self.pos[t, k] += gain[:, 0] * e
            self.pos[t, k + 2] += gain[:, 1] * e
        p, c, v = self.cov[t].T
        self.cov[t] = np.column_stack((p * (1 - gain[:, 0]), c * (1 - gain[:, 0]), v - gain[:, 1] * c))
        self.angle[t] = angle[d]
        self.finish(t)
        label = ids.copy()
        label[d] = self._first_before[t]
        new = np.setdiff1d(np.arange(len(ids)), d)
        v0 = self.c.kalman_initial_velocity ** 2
        self.pos = np.vstack((self.pos, np.column_stack((x[new], y[new], np.zeros((len(new), 2))))))
        self.cov = np.vstack((self.cov, np.tile([r, 0.0, v0], (len(new), 1))))
        self.miss = np.r_[self.miss, np.zeros(len(new), int)]
        self.angle = np.r_[self.angle, angle[new]]
        self.first = np.r_[self.first, ids[new]]
        return label

    def finish(self, matched: np.ndarray) -> None:
        """Count misses, drop tracks missed too often."""
        self._first_before = self.first
        hit = np.zeros(len(self.first), bool)
        hit[matched] = True
        self.miss = np.where(hit, 0, self.miss + 1)
        live = self.miss < self.c.max_frame_gap
        self.pos, self.cov, self.miss, self.angle, self.first = (v[live] for v in (self.pos, self.cov, self.miss, self.angle, self.first))


class NearestLinker(KalmanLinker):
    """Greedy links to each track's last position, closest pair first."""

    def advance(self) -> None:
        pass

    def step(self, x, y, angle, ids) -> np.ndarray:
        t, d, d2 = gated_pairs(self.pos[:, 0], self.pos[:, 1], self.gates(), x, y)
        used_t, used_d, tt, dd = set(), set(), [], []
        for k in np.lexsort((d, t, d2)):
            if t[k] not in used_t and d[k] not in used_d:
                used_t.add(t[k]); used_d.add(d[k])
                tt.append(t[k]); dd.append(d[k])
        t, d = np.array(tt, int), np.array(dd, int)
        self.pos[t, 0], self.pos[t, 1] = x[d], y[d]
        self.finish(t)
        label = ids.copy()
        label[d] = self._first_before[t]
        new = np.setdiff1d(np.arange(len(ids)), d)
        self.pos = np.vstack((self.pos, np.column_stack((x[new], y[new], np.zeros((len(new), 2))))))
        self.cov = np.vstack((self.cov, np.zeros((len(new), 3))))
        self.miss = np.r_[self.miss, np.zeros(len(new), int)]
        self.angle = np.r_[self.angle, angle[new]]
        self.first = np.r_[self.first, ids[new]]
        return label


def stream_islands(cfg: Settings, make: Callable, emit_predictions: bool):
    """Iterator function for mapInPandas over rows sorted by (movie, island, frame): keeps one linker, one batch
    of rows and what they gave, as arrays; a frame of an island is a slice of them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, linker, last = None, None, 0
        out: list[tuple] = []  # movie, island, frame, rows or None, first rows, then places and gates of predictions

        def predictions(frame: int) -> None:
            if emit_predictions and len(linker.pos):
                out.append((*key, frame, None, linker.first, linker.pos[:, 0].copy(), linker.pos[:, 1].copy(), linker.gates()))

        def empty_frames(n: int) -> None:
            for i in range(min(n, cfg.max_frame_gap)):
                if not len(linker.pos):
                    break
                linker.advance()
                predictions(last + 1 + i)
                linker.finish(np.zeros(0, int))

        def step(of: tuple, frame: int, ids: np.ndarray, x: np.ndarray, y: np.ndarray, turn: np.ndarray) -> None:
            nonlocal key, linker, last
            if of != key:
                if linker is not None:
                    empty_frames(cfg.max_frame_gap)
                key, linker = of, make(cfg)
            else:
                empty_frames(frame - last - 1)
                linker.advance()
                predictions(frame)
            out.append((*of, frame, ids, linker.step(x, y, turn, ids), None, None, None))
            last = frame

        def table() -> pd.DataFrame:
            n = [len(r[4]) for r in out]
            ids = np.concatenate([np.zeros(len(r[4]), np.int64) if r[3] is None else r[3] for r in out])
            found = np.repeat([r[3] is not None for r in out], n)
            none = [np.full(k, np.nan) for k in n]
            made = {f: np.repeat(np.array([r[k] for r in out], t), n) for k, (f, t) in enumerate((("movie", object), ("island", np.int64), ("frame_number", np.int32)))}
            made |= {"row_id": pd.arrays.IntegerArray(ids, ~found), "first_row": np.concatenate([r[4] for r in out])}
            made |= {f: np.concatenate([none[i] if r[k] is None else r[k] for i, r in enumerate(out)]) for k, f in ((5, "px"), (6, "py"), (7, "gate"))}
            out.clear()
            return pd.DataFrame(made)

        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            now = [pdf["movie"].to_numpy()] + [pdf[c].to_numpy(np.int64) for c in ("island", "frame_number", "row_id")] + [pdf[c].to_numpy(float) for c in ("xMean", "yMean", "angleDegrees")]
            if held is not None:
                now = [np.concatenate(c) for c in zip(held, now)]
            m, isl, fr, ids, x, y, turn = now
            at = np.flatnonzero(np.r_[True, (isl[1:] != isl[:-1]) | (fr[1:] != fr[:-1]) | (m[1:] != m[:-1])])
            held = [c[at[-1]:] for c in now]  # the last frame may go on in the next batch
            for lo, hi in zip(at[:-1], at[1:]):
                step((m[lo], isl[lo]), int(fr[lo]), ids[lo:hi], x[lo:hi], y[lo:hi], turn[lo:hi])
            if out:
                yield table()
        if held is not None:
            step((held[0][0], held[1][0]), int(held[2][0]), *held[3:])
            empty_frames(cfg.max_frame_gap)
            yield table()
    return run


ROWS_PER_TASK = 20_000


def _run(rows: DataFrame, cfg: Settings, make: Callable, emit: bool) -> DataFrame:
    ordered = rows.select("movie", "island", "frame_number", "row_id", "xMean", "yMean", F.coalesce("angleDegrees", F.lit(0.0)).alias("angleDegrees")) \
        .repartition(shares(rows, ROWS_PER_TASK), "movie", "island").sortWithinPartitions("movie", "island", "frame_number", "row_id")
    return cut(ordered.mapInPandas(stream_islands(cfg, make, emit), OUT))


def _labelled(rows: DataFrame, out: DataFrame) -> DataFrame:
    lab = out.where("row_id IS NOT NULL").select("movie", "row_id", "frame_number", "first_row")
    return number_tracks(lab, "first_row").drop("first_row")


def track_nearest(rows: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Islands of the gap gate never interact, so the result is that of the whole movie."""
    return _labelled(rows, _run(cut(islands(rows, cfg.gap_distance_px)), cfg, NearestLinker, False))


def track_kalman(rows: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Constant-velocity tracks. A prediction can leave its island, so each run also returns all
    predictions; islands whose predictions came within the gate of another island's detections are merged
    and the run repeated until none do. Then every assignment was complete, hence exact."""
    part = cut(islands(rows, 2 * cfg.gap_distance_px))
    det = lambda p: p.select("movie", "frame_number", F.col("island").alias("other"), F.col("xMean").alias("dx_"), F.col("yMean").alias("dy_"))
    while True:
        out = _run(part, cfg, KalmanLinker, True)
        pred = out.where("row_id IS NULL").select("movie", "frame_number", "island", "px", "py", "gate")
        dist2 = (F.col("px") - F.col("dx_")) * (F.col("px") - F.col("dx_")) + (F.col("py") - F.col("dy_")) * (F.col("py") - F.col("dy_"))
        clash = near_join(det(part), pred, cfg.gap_distance_px, ["movie", "frame_number"], ("dx_", "dy_"), ("px", "py"),
                          (F.col("island") != F.col("other")) & (dist2 <= F.col("gate") * F.col("gate")))
        pairs = cut(clash.select(F.least("island", "other").alias("a"), F.greatest("island", "other").alias("b")).distinct())
        if pairs.isEmpty():
            return _labelled(rows, out)
        comp = connected_components(pairs).withColumnsRenamed({"node": "island"})
        part = cut(part.join(comp, "island", "left").withColumn("island", F.coalesce("component", "island")).drop("component"))


def retrack(rows: DataFrame, method: str = "lap", cfg: Settings = DEFAULTS) -> DataFrame:
    """Track again with a chosen method; short tracks are flagged, not removed. A missing angle counts as
    zero, a missing position or frame is an error."""
    if method not in ("lap", "kalman", "nearest"):
        raise ValueError(f"unknown tracking method {method!r}")
    if not rows.where("xMean IS NULL OR yMean IS NULL OR frame_number IS NULL").isEmpty():
        raise ValueError("xMean, yMean and frame_number must be complete")
    out = {"lap": track_lap, "kalman": track_kalman, "nearest": track_nearest}[method](rows, cfg)
    n = out.groupBy("movie", "track_number").agg(F.count("*").alias("_n"))
    return out.join(n, ["movie", "track_number"]).withColumn("short", F.col("_n") < cfg.min_track_length).drop("_n")
