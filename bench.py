"""Headline queries on the given tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from moteflow.catalog import QUERIES
from moteflow.session import local_session

HEADLINE = ["drift_track_stats", "angle_to_z", "pair_cost", "link_candidates", "gap_candidates", "jump_scores", "track_brightness", "filtered_tracks",
            "missing_predictions", "error_scale", "filter_loglik_directed", "motion_class", "frame_window_average", "median_template", "axial_consensus",
            "movie_audit", "run_catalogue", "tracks_lap", "tracks_kalman", "tracks_nearest"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cpus, "bench")
    spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").count().collect()  # start the engine
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
