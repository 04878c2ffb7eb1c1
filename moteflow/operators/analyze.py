"""From frames to the localization table: detection, depth, recovery, tracks, final split, drift and output columns as one chain of stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from moteflow.operators import calibration as K, cleaning as C, drift as D, imaging as I, recovery as Y
from moteflow.session import cut
from moteflow.settings import DEFAULTS, Settings
from moteflow.sources.tables import output_columns

NO_SHIFT = [[0.0] * 6, [0.0] * 6]


@dataclass(frozen=True)
class Analysis:
    """``localizations`` and ``rejected`` rows with their output columns, ``drift`` per movie and frame, and what each recovery round did."""
    localizations: DataFrame
    rejected: DataFrame
    drift: DataFrame
    history: list[dict]


def with_depths(rows: DataFrame, curve: DataFrame | K.FieldCurve, limits: tuple[float, float] | None = None) -> DataFrame:
    """Rows with zMicrons, zStatus, fieldSeparationOffset and zPrecisionUm, and z and z_sd as the trackers read them."""
    plain = curve.curve if isinstance(curve, K.FieldCurve) else curve
    out = K.depths(rows.drop("zMicrons", "zStatus", "zPrecisionUm", "fieldSeparationOffset"), curve, limits)
    out = K.depth_precision(out, plain)
    return out.withColumns({"z": F.col("zMicrons"), "z_sd": F.col("zPrecisionUm")})


def analyze(frames: DataFrame, curve: DataFrame | K.FieldCurve, cfg: Settings = DEFAULTS, lateral: list[list[float]] = NO_SHIFT,
            limits: tuple[float, float] | None = None, place: tuple[int, int] = (0, 0), camera: DataFrame | None = None) -> Analysis:
    """All movies of ``frames(movie, frame, height, width, pixels)`` at once.

    Beads are found and given depths, tracked, cleaned and recovered until nothing changes; tracks that are too short, dim, ghosts or satellites are split off, the rest
    is numbered, and the movies' drift is taken from it. Rejected rows and those removed while recovering are in ``rejected``. A movie without a bead has no rows."""
    peaks = cut(I.detect_peaks(frames, cfg, cfg.seed_sigma_frames))
    found = I.localize(frames, cfg, curve, camera=camera, place=place, peaks=peaks)
    depth = lambda rows: with_depths(rows, curve, limits)
    rows = cut(depth(found.withColumn("templateScore", F.lit(None).cast("double"))))
    tracked, removed, history = Y.recover(rows, Y.pixel_refit(frames, peaks, cfg, curve, depth), cfg)
    kept, rejected = C.split_and_renumber(tracked, cfg)
    kept = cut(kept)
    drift = cut(D.estimate_drift(kept))
    sensor = curve.sensor if isinstance(curve, K.FieldCurve) else float(cfg.sensor_size_px)
    finished = lambda df: output_columns(df.drop("z", "z_sd", "noise", "background"), drift, lateral, place, cfg.axial_scale, sensor)
    return Analysis(finished(kept), finished(C.all_rejected(rejected, removed)), drift, history)
