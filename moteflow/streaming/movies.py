"""Online linking driven by event time: a state machine for each movie.

A frame is linked when the watermark has passed its time, so the result does not depend on how rows were cut into batches. What a movie holds is its
active tracks, the rows of frames that are still open, and timers; a movie whose last frame lies ``quiet`` behind the watermark is over and leaves the state. One movie is one key,
since each of its frames needs the one before; movies run apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from moteflow.operators.trackers import KalmanLinker, NearestLinker
from moteflow.settings import DEFAULTS, Settings

OUT = "movie string, frame_number int, row_id long, first_row long, late boolean"
TRACKS = "frame int, ended long, pos array<double>, cov array<double>, miss array<long>, angle array<double>, first array<long>"
FRAME = "at long, id array<long>, x array<double>, y array<double>, angle array<double>"
#: What the session needs before the query starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class MovieLinker(StatefulProcessor):
    """Rows wait in their frame until its timer fires; then all frames up to that time are linked in order."""

    def __init__(self, method: str, cfg: Settings, quiet_ms: int):
        self.make, self.cfg, self.quiet = {"kalman": KalmanLinker, "nearest": NearestLinker}[method], cfg, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks = handle.getValueState("tracks", TRACKS)
        self.open = handle.getMapState("open", "frame int", FRAME)

    def close(self) -> None:
        pass

    def _load(self) -> tuple[KalmanLinker, int | None, int]:
        k = self.make(self.cfg)
        if not self.tracks.exists():
            return k, None, 0
        frame, ended, pos, cov, miss, angle, first = self.tracks.get()
        n = len(miss)
        k.pos, k.cov = np.array(pos, float).reshape(n, 4), np.array(cov, float).reshape(n, 3)
        k.miss, k.angle, k.first = np.array(miss, int), np.array(angle, float), np.array(first, np.int64)
        return k, frame, ended

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        done = self.tracks.get()[0] if self.tracks.exists() else None
        for pdf in rows:
            late = pdf["frame_number"] <= done if done is not None else np.zeros(len(pdf), bool)
            if np.any(late):
                yield self._result(key[0], [(int(f), int(i), None, True) for f, i in zip(pdf["frame_number"][late], pdf["row_id"][late], strict=True)])
            for frame, g in pdf[~late].groupby("frame_number"):
                new = [g["row_id"].astype(int).tolist(), g["xMean"].astype(float).tolist(), g["yMean"].astype(float).tolist(), g["angleDegrees"].fillna(0.0).astype(float).tolist()]
                at = int(g["at_ms"].max())
                if self.open.containsKey((int(frame),)):
                    before = self.open.getValue((int(frame),))
                    at, new = max(at, before[0]), [list(b) + a for b, a in zip(before[1:], new, strict=True)]
                self.open.updateValue((int(frame),), (at, *new))
                self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        ready = sorted((k[0], v) for k, v in self.open.iterator() if v[0] <= now)
        k, done, ended = self._load()
        out = []
        for frame, (at, ids, x, y, angle) in ready:
            if done is not None:
                for _ in range(min(frame - done - 1, self.cfg.max_frame_gap)):
                    k.advance()
                    k.finish(np.zeros(0, int))
                k.advance()
            order = np.argsort(ids)
            ids = np.array(ids, np.int64)[order]
            label = k.step(*(np.array(v, float)[order] for v in (x, y, angle)), ids)
            out += [(frame, int(i), int(t), False) for i, t in zip(ids, label, strict=True)]
            self.open.removeKey((frame,))
            done, ended = frame, max(ended, at)
        over = done is not None and max(now, timerValues.getCurrentWatermarkInMs()) >= ended + self.quiet and next(iter(self.open.keys()), None) is None
        if over:
            self.tracks.clear()
        elif ready:
            self.tracks.update((done, ended, k.pos.ravel().tolist(), k.cov.ravel().tolist(), k.miss.tolist(), k.angle.tolist(), k.first.tolist()))
            self.handle.registerTimer(ended + self.quiet)
        if ready:
            yield self._result(key[0], out)

    @staticmethod
    def _result(movie: str, rows: list[tuple]) -> pd.DataFrame:
        df = pd.DataFrame([(movie, *r) for r in rows], columns=["movie", "frame_number", "row_id", "first_row", "late"])
        return df.astype({"frame_number": "int32", "first_row": "Int64"})


def link_movies(rows: DataFrame, time: str, method: str = "kalman", cfg: Settings = DEFAULTS, lateness: str = "10 seconds", quiet: str = "60 seconds") -> DataFrame:
    """Each localization of a stream with the first row of its track, once the watermark is past its frame.

    ``time`` names the event time, one instant for all rows of a frame and rising with frames. Rows may come out of order by up to ``lateness``. A row of a frame that has been linked
    comes out as ``late`` with no track; rows behind the watermark that Spark drops before are counted in the query's progress (``numRowsDroppedByWatermark``).
    After ``quiet`` without a new frame, in event time, a movie is over: its state is removed, and later rows begin a new one. The session needs ``STATE_STORE``.
    """
    ms = rows.sparkSession.sql(f"SELECT unix_millis(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {quiet})").first()[0]
    named = rows.select("movie", "frame_number", "row_id", "xMean", "yMean", "angleDegrees", F.unix_millis(time).alias("at_ms"), time).withWatermark(time, lateness)
    return named.groupBy("movie").transformWithStateInPandas(MovieLinker(method, cfg, ms), OUT, "Append", "EventTime")
