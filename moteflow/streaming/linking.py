"""Linking localizations as they arrive, and running pixel statistics."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from moteflow.operators.trackers import KalmanLinker, NearestLinker
from moteflow.settings import DEFAULTS, Settings

OUT = "movie string, frame_number int, row_id long, first_row long, late boolean"
STATE = "memory string"


def _save(k: KalmanLinker, frame: int, pending: list) -> tuple[str]:
    return (json.dumps({"pos": k.pos.tolist(), "cov": k.cov.tolist(), "miss": k.miss.tolist(), "angle": k.angle.tolist(), "first": k.first.tolist(),
                        "frame": frame, "pending": pending}),)


def _load(make, cfg: Settings, state: GroupState):
    k = make(cfg)
    if not state.exists:
        return k, None, []
    s = json.loads(state.get[0])
    n = len(s["miss"])
    k.pos, k.cov = np.array(s["pos"], float).reshape(n, 4), np.array(s["cov"], float).reshape(n, 3)
    k.miss, k.angle, k.first = np.array(s["miss"], int), np.array(s["angle"], float), np.array(s["first"], np.int64)
    return k, s["frame"], s["pending"]


def link_stream(rows: DataFrame, method: str = "kalman", cfg: Settings = DEFAULTS, lateness: int = 2, idle_ms: int | None = None) -> DataFrame:
    """Online tracker keyed by movie: each localization comes out with the first row of its track.

    A frame is linked once a frame more than ``lateness`` later has been seen, so rows may arrive out of
    order by that much; rows of frames already linked are returned as late and not linked. State is the
    active tracks (dropped after ``max_frame_gap`` misses) and the rows of frames still open, so it stays
    bounded however long the movie. ``idle_ms`` closes open frames of a movie that has gone quiet; a movie that
    stays quiet as long again is over, and its state is removed (rows after that start it anew).
    """
    make = {"kalman": KalmanLinker, "nearest": NearestLinker}[method]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        k, frame, pending = _load(make, cfg, state)
        if state.hasTimedOut and not pending:
            state.remove()
            return
        new = [r for b in batches for r in zip(b["frame_number"].astype(int).tolist(), b["row_id"].astype(int).tolist(), b["xMean"].tolist(), b["yMean"].tolist(),
                                               b["angleDegrees"].fillna(0.0).tolist())]
        late = [r for r in new if frame is not None and r[0] <= frame]
        pending = [tuple(r) for r in pending] + [r for r in new if frame is None or r[0] > frame]
        out = [(key[0], r[0], r[1], None, True) for r in late]
        newest = max((r[0] for r in pending), default=-1)
        ready = newest if state.hasTimedOut else newest - lateness - 1
        for f in sorted({r[0] for r in pending if r[0] <= ready}):
            if frame is not None:
                for _ in range(min(f - frame - 1, cfg.max_frame_gap)):
                    k.advance()
                    k.finish(np.zeros(0, int))
                k.advance()
            g = sorted((r for r in pending if r[0] == f), key=lambda r: r[1])
            ids = np.array([r[1] for r in g], np.int64)
            lab = k.step(*(np.array([r[i] for r in g], float) for i in (2, 3, 4)), ids)
            out += [(key[0], f, int(i), int(t), False) for i, t in zip(ids, lab)]
            frame = f
        pending = [r for r in pending if frame is None or r[0] > frame]
        state.update(_save(k, frame, pending))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        df = pd.DataFrame(out, columns=["movie", "frame_number", "row_id", "first_row", "late"])
        df["first_row"] = df["first_row"].astype("Int64")
        yield df

    mode = GroupStateTimeout.ProcessingTimeTimeout if idle_ms is not None else GroupStateTimeout.NoTimeout
    return rows.select("movie", "frame_number", "row_id", "xMean", "yMean", "angleDegrees").groupBy("movie") \
        .applyInPandasWithState(step, OUT, STATE, "append", mode)


def running_pixel_stats(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and variance of every pixel so far (write in complete or update mode)."""
    return pixels.groupBy(*keys, "y", "x").agg(F.avg("v").alias("mean"), F.var_samp("v").alias("variance"), F.count("*").alias("n"))
