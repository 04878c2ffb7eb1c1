import json
import pathlib

import pytest
from pyspark.sql import functions as F

from helpers import rows
from moteflow.sources import exports as E


def field(spark, drop=None, twice=None):
    nodes = [("m", f, float(x), float(y), 1.5, 0.1 * f, None if (x, y) == (1, 1) else 0.2, -1e-7, 3.25, 0.0, 12.0) for f in (1, 2) for y in range(3) for x in range(4) if (f, x, y) != drop]
    nodes += [n for n in nodes if twice == (n[1], n[2], n[3])]
    return spark.createDataFrame(nodes, ", ".join(f"{c} {'string' if c == 'movie' else 'int' if c == 'frame_number' else 'double'}" for c in E.FIELD_KEYS + E.FIELD_VALUES))


def test_field_round_trip_and_shape(spark, tmp_path):
    f, path = field(spark), str(tmp_path / "field")
    E.write_field(f, path)
    assert sorted(map(tuple, E.read_field(spark, path).collect()), key=str) == sorted(map(tuple, f.collect()), key=str)
    for bad in (field(spark, drop=(2, 3, 2)), field(spark, twice=(1, 0.0, 0.0))):
        with pytest.raises(ValueError, match="expected"):
            E.write_field(bad, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_rois_round_trip(spark, tmp_path):
    rois = spark.createDataFrame([("m", "box", 1.0, 2.0, 30.0, 40.5, None, None), ("n/1", "ring \"é\"", None, None, None, None, True, [(1.0, 2.0), (3.5, 4.0), (0.0, -1.0)])], E.ROI)
    path = str(tmp_path / "rois")
    E.write_rois(rois, path)
    back = E.read_rois(spark, path).select(rois.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, rois.collect()))


def test_drift_motion_and_summary_sinks(spark, tmp_path):
    drift = spark.createDataFrame([("m", f, 0.125 * f, -0.2, 1e-9, None if f == 2 else 3.0) for f in (3, 1, 2)], "movie string, frame_number int, dx double, dy double, dz double, dz_raw double")
    E.write_drift(drift, str(tmp_path / "drift"))
    back = spark.read.option("header", True).schema(drift.schema.simpleString()[7:-1].replace(":", " ")).csv(str(tmp_path / "drift"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, drift.collect()), key=str)
    tracks = spark.createDataFrame([("m", 2, "directed"), ("m", 1, "brownian")], "movie string, track_number int, motion_class string")
    states = spark.createDataFrame([("m", 1, 2, 0.5), ("m", 1, 1, None)], "movie string, track_number int, frame_number int, p_moving double")
    E.write_motion(tracks, states, str(tmp_path / "motion"))
    for name, df in (("track_motion", tracks), ("motion_states", states)):
        got = spark.read.parquet(str(tmp_path / "motion" / name)).select(df.columns)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    loc = rows(spark, [{"f": f, "t": 1} for f in (1, 2, 3)]).withColumn("zStatus", F.lit(0))
    E.write_summaries(loc, loc.limit(0).withColumn("reject_reason", F.lit(1)), str(tmp_path / "summary"), tracks.groupBy("movie").agg(F.count("*").alias("tracks_fitted")))
    record, = [json.loads(x) for p in pathlib.Path(tmp_path / "summary").glob("part*") for x in p.read_text().splitlines()]
    assert record["localizations"] == 3 and record["motion"] == {"tracks_fitted": 2} and record["z_status"]["0"] == 3 and record["rejected"] is None


def test_what_recordings_suggest(spark):
    p = spark.createDataFrame([(250, 10, 1.0), (50, 10, 1.0), (250, 99, 1.0), (250, None, 1.0)], "n int, o int, s double")
    got = [tuple(r.r) for r in p.select(E.suggested_planes(F.col("n"), F.col("o"), F.col("s")).alias("r")).collect()]
    assert got == [(45, 206), (1, 50), (1, 250), (1, 250)]
    t = spark.createDataFrame([('"Interval_ms": 0,\n"Interval_ms": 5.25, "ROI": "1-2-30-40"',), ("nothing",), (None,)], "t string")
    assert [tuple(r.f) for r in t.select(E.sidecar_fields(F.col("t")).alias("f")).collect()] == [(5.25, [1, 2, 30, 40]), (None, None), (None, None)]
    dim = E.dim_overrides(spark.createDataFrame([("a", 5.9), ("b", 6.0), ("c", None)], "movie string, median_snr double"), 3).collect()
    assert {r.movie for r in dim} == {"a"} and {r.key for r in dim} == {"min_snr", "recover_min_snr", "min_pair_snr", "sep_sd_mode"} and {r.priority for r in dim} == {3}
    px = spark.createDataFrame([("m", 1, x, y, -(x - 2.3) ** 2 - 2 * (y - 1.6) ** 2) for x in range(5) for y in range(4)], "movie string, frame int, x int, y int, v double")
    got = {(r.x, r.y): (r.fx, r.fy) for r in E.refined_maxima(px.where("(x = 2 AND y = 2) OR (x = 0 AND y = 0)").select("movie", "frame", "x", "y"), px).collect()}
    assert got[0, 0] == (0, 0) and abs(got[2, 2][0] - 2.3) < 1e-9 and abs(got[2, 2][1] - 1.6) < 1e-9
