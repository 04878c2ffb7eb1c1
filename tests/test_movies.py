import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from moteflow.operators import trackers as K
from moteflow.streaming.movies import STATE_STORE, link_movies


@pytest.fixture
def store(spark):
    old = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def timed(spark, recs):
    """A frame a second."""
    return rows(spark, recs).withColumn("time", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame_number")))


def run(spark, df, batches, tmp_path, name, **kw):
    """The stream's rows when the row ids of ``batches`` arrive one batch after another, and the query's last progress."""
    src = str(tmp_path / name)
    for ids in batches:
        df.where(F.col("row_id").isin(ids)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = link_movies(stream, "time", **kw).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / (name + "_ck"))).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect(), [p for p in q.recentProgress]


def groups(label):
    return {frozenset(k for k in label if label[k] == v) for v in label.values()}


def test_any_order_of_batches_gives_the_tracks_of_the_batch(spark, store, tmp_path):
    recs = [{"f": f, "x": 10.0 * k + 0.8 * f, "y": 20.0 * k, "t": k} for f in range(1, 13) for k in range(4) if (f + k) % 5]
    df = timed(spark, recs)
    end = timed(spark, [{"f": 60, "x": 0.0, "y": 0.0, "id": 5000}]).withColumn("movie", F.lit("z"))
    want = {r.row_id: r.track_number for r in K.track_kalman(df).collect()}
    ids = list(range(len(recs)))
    r = random.Random(2)
    by_frame = sorted(ids, key=lambda i: (recs[i]["f"], r.random()))
    shuffled = sorted(ids, key=lambda i: recs[i]["f"] + r.randint(0, 3))  # out of order by at most three frames
    for name, order, size in (("whole", by_frame, 100), ("inorder", by_frame, 7), ("mixed", shuffled, 5)):
        batches = [order[i:i + size] for i in range(0, len(order), size)] + [[5000]]
        got, _ = run(spark, df.unionByName(end), batches, tmp_path, name, lateness="5 seconds", quiet="30 seconds")
        seen = {x.row_id: x.first_row for x in got if x.movie == "m"}
        assert not any(x.late for x in got) and groups(seen) == groups(want)
        assert all(x.first_row in seen for x in got if x.movie == "m")


def test_a_finished_movie_leaves_the_state_and_begins_anew(spark, store, tmp_path):
    recs = [{"f": f, "x": 50.0, "y": 50.0, "id": f} for f in (1, 2, 3)] + [{"f": 100, "x": 50.0, "y": 50.0, "id": 100}]
    other = [{"f": f, "x": 5.0, "y": 5.0, "id": 1000 + f} for f in (30, 60, 90, 160)]
    df = timed(spark, recs).unionByName(timed(spark, other).withColumn("movie", F.lit("z")))
    got, progress = run(spark, df, [[1, 2, 3], [1030], [1060], [1090], [100], [1160]], tmp_path, "over", lateness="1 second", quiet="20 seconds")
    first = {x.row_id: x.first_row for x in got}
    assert first[1] == first[2] == first[3] == 1 and first[100] == 100
    held = spark.read.format("statestore").option("stateVarName", "tracks").load(str(tmp_path / "over_ck")).select("key.*").collect()
    assert {k[0] for k in held} == {"z"}


def test_late_rows_are_told_or_counted(spark, store, tmp_path):
    recs = [{"f": f, "x": 50.0, "y": 50.0, "id": f} for f in (1, 2, 3, 30, 60)] + [{"f": 2, "x": 51.0, "y": 50.0, "id": 900}]
    got, progress = run(spark, timed(spark, recs), [[1, 2, 3], [30], [900], [60]], tmp_path, "late", lateness="1 second", quiet="500 seconds")
    told = [x.row_id for x in got if x.late]
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress if p["stateOperators"])
    assert len(told) + dropped == 1 and {x.row_id for x in got if not x.late} >= {1, 2, 3}


def test_nearest_tracker_and_empty_stream(spark, store, tmp_path):
    df = timed(spark, [{"f": f, "x": 10.0 + f, "y": 5.0, "id": f} for f in (1, 2, 3, 40)])
    got, _ = run(spark, df, [[1, 2, 3], [40]], tmp_path, "near", method="nearest", lateness="1 second", quiet="100 seconds")
    assert {x.row_id: x.first_row for x in got if x.row_id < 40} == {1: 1, 2: 1, 3: 1}
    none, _ = run(spark, df, [[77]], tmp_path, "none")
    assert none == []
