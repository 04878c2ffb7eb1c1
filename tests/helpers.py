"""Small hand-made localization tables."""

import numpy as np
import pandas as pd

COLS = ["row_id", "movie", "frame_number", "track_number", "x1", "x2", "xMean", "y1", "y2", "yMean", "angleDegrees", "z", "z_sd", "amplitude1", "amplitude2",
        "minLobeSNR", "templateScore", "recovered", "sharedLobe", "lobeSeparationPixels"]


def rows(spark, recs):
    """Records with any of the columns; the rest get neutral values."""
    out = []
    for i, r in enumerate(recs):
        x, y = float(r.get("x", 0.0)), float(r.get("y", 0.0))
        d = {"row_id": r.get("id", i), "movie": r.get("movie", "m"), "frame_number": int(r["f"]), "track_number": int(r.get("t", 0)),
             "x1": float(r.get("x1", x - 8)), "x2": float(r.get("x2", x + 8)), "y1": float(r.get("y1", y)), "y2": float(r.get("y2", y)),
             "angleDegrees": float(r.get("a", 0.0)), "z": r.get("z"), "z_sd": r.get("sd", 1.0), "amplitude1": float(r.get("amp", 100)), "amplitude2": float(r.get("amp", 100)),
             "minLobeSNR": float(r.get("snr", 20)), "templateScore": r.get("score"), "recovered": int(r.get("rec", 0)), "sharedLobe": int(r.get("shared", 0)),
             "lobeSeparationPixels": float(r.get("sep", 16.0))}
        d["xMean"] = x if "x" in r else (d["x1"] + d["x2"]) / 2
        d["yMean"] = y if "y" in r else (d["y1"] + d["y2"]) / 2
        out.append(tuple(None if d[c] is None or (isinstance(d[c], float) and np.isnan(d[c])) else (float(d[c]) if isinstance(d[c], np.floating) else d[c]) for c in COLS))
    schema = ("row_id long, movie string, frame_number int, track_number int, " + ", ".join(f"{c} double" for c in COLS[4:17]) + ", recovered int, sharedLobe int, lobeSeparationPixels double")
    return spark.createDataFrame(out, schema)
