from pyspark.sql import functions as F

from helpers import rows
from moteflow.operators import trackers as K
from moteflow.streaming.linking import link_stream, running_pixel_stats


def test_stream_links_like_the_batch(spark, tmp_path):
    recs = [{"f": f, "x": 10.0 * k + 0.8 * f, "y": 20.0 * k, "t": k} for f in range(1, 13) for k in range(4) if (f + k) % 5]
    df = rows(spark, recs)
    src = str(tmp_path / "in")
    for i, (lo, hi) in enumerate(((1, 4), (5, 8), (9, 12))):
        df.where(F.col("frame_number").between(lo, hi)).coalesce(1).write.mode("append").parquet(src)
    df.where("frame_number = 1").limit(1).withColumn("row_id", F.lit(900).cast("long")).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = link_stream(stream, lateness=1).writeStream.format("memory").queryName("linked").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("linked")
    assert [r.row_id for r in got.where("late").collect()] in ([900], [])
    seen = {r.row_id: r.first_row for r in got.where("NOT late").collect()}
    assert max(r.frame_number for r in got.where("NOT late").collect()) == 10
    want = {r.row_id: r.track_number for r in K.track_kalman(df).collect()}
    groups = lambda m, keys: {frozenset(k for k in keys if m[k] == v) for v in {m[k] for k in keys}}
    keys = [k for k in seen if k != 900]
    assert groups(seen, keys) == groups(want, keys)


def test_running_pixel_statistics(spark, tmp_path):
    src = str(tmp_path / "px")
    px = spark.range(0, 40).select(F.lit("m").alias("movie"), (F.col("id") % 2).cast("int").alias("y"), F.lit(0).alias("x"), F.col("id").cast("double").alias("v"))
    px.repartition(4).write.parquet(src)
    q = running_pixel_stats(spark.readStream.schema(px.schema).option("maxFilesPerTrigger", 1).parquet(src), ["movie"]) \
        .writeStream.format("memory").queryName("pxstats").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r.y, round(r.m, 6), round(r.v, 6)) for r in px.groupBy("y").agg(F.avg("v").alias("m"), F.var_samp("v").alias("v")).collect()}
    assert {(r.y, round(r.mean, 6), round(r.variance, 6)) for r in spark.table("pxstats").collect()} == want
