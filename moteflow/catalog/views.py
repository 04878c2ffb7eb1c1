"""The given tables seen as localizations, lobes, pixels and curves (Spark form and SQL form).

``events`` become localizations: a user is a track, a day is a frame, and 48 consecutive users share one
256 x 256 px movie, so movies multiply with the data while the crowding of one frame stays the same.
``embeddings`` become 8 x 8 px frames, 100 per movie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from moteflow.operators.imaging import Shots
from moteflow.session import cut

TRACKS_PER_MOVIE = 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def loc(spark: SparkSession, sf_dir: str, per_movie: int = TRACKS_PER_MOVIE) -> DataFrame:
    """One localization per (user, day): its earliest event, picked by a map-side combined minimum, so
    a user holding a third of all events collapses before the shuffle."""
    ev = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value",
        (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).alias("frame_number"))
    first = ev.groupBy("user_id", "frame_number").agg(
        F.min_by(F.struct("event_id", "event_type", "value"), "event_id").alias("e")) \
        .select("user_id", "frame_number", "e.*")
    e, u, f = F.col("event_id"), F.col("user_id"), F.col("frame_number")
    base = first.select(
        e.alias("row_id"), F.concat(F.lit("m"), F.expr(f"user_id div {per_movie}").cast("string")).alias("movie"),
        u.cast("int").alias("track_number"), "frame_number",
        ((u * 97) % 256 + 1 + (e * 31 % 100) / F.lit(49.7) + ((f * 7) % 5) * F.lit(0.2471)).alias("xMean"),
        ((u * 61) % 256 + 1 + (e * 17 % 100) / F.lit(48.3) + ((f * 3) % 7) * F.lit(0.1237)).alias("yMean"),
        (((u * 37) % 180 + (F.col("value") * 7) % 24) % 180).alias("angleDegrees"),
        F.when(e % 23 != 5, (u * 13 % 40) - 20 + (e * 13 % 200) / F.lit(101.3) + f * F.lit(0.0613)
               + F.when(e % 29 == 0, F.lit(7.0)).otherwise(F.lit(0.0))).alias("zMicrons"),
        (F.lit(16) + (e % 60) / F.lit(10.0)).alias("lobeSeparationPixels"),
        (F.col("value") / F.lit(5.0) + 2).alias("minLobeSNR"),
        ((u * 53) % 400 + 40 + F.col("value") * F.lit(0.25)).alias("amplitude1"),
        ((u * 53) % 400 + 30 + (e * 7 % 60)).cast("double").alias("amplitude2"),
        (F.lit(2.0) + (e % 5) / F.lit(10.0)).alias("sigma1"), (F.lit(2.0) + (e % 7) / F.lit(10.0)).alias("sigma2"),
        F.when(e % 31 != 0, F.lit(0.05) + (e % 7) / F.lit(100.0)).alias("xPrecisionPx"),
        (F.lit(0.05) + (e % 5) / F.lit(100.0)).alias("yPrecisionPx"),
        (F.lit(0.3) + (e % 9) / F.lit(10.0)).alias("anglePrecisionDeg"),
        (F.lit(0.3) + (e % 11) / F.lit(20.0)).alias("zPrecisionUm"),
        (F.lit(0.3) + (e * 19 % 70) / F.lit(100.0)).alias("templateScore"),
        F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("recovered"),
        F.when(e % 37 == 0, 1).otherwise(0).alias("sharedLobe"),
        F.when(e % 23 == 5, (e % 2).cast("int") + 1).when(e % 13 == 0, 3).otherwise(0).alias("zStatus"))
    rad, half = F.radians("angleDegrees"), F.col("lobeSeparationPixels") / F.lit(2.0)
    return base.withColumns({
        "x1": F.col("xMean") - half * F.cos(rad), "y1": F.col("yMean") - half * F.sin(rad),
        "x2": F.col("xMean") + half * F.cos(rad), "y2": F.col("yMean") + half * F.sin(rad)})


LOC = f"""loc_first AS (
  SELECT * FROM (SELECT event_id AS e, user_id AS u, event_type, value,
    date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS f,
    row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS rn FROM events) WHERE rn = 1),
loc AS (SELECT *, xMean - lobeSeparationPixels / 2e0 * cos(radians(angleDegrees)) AS x1,
    yMean - lobeSeparationPixels / 2e0 * sin(radians(angleDegrees)) AS y1,
    xMean + lobeSeparationPixels / 2e0 * cos(radians(angleDegrees)) AS x2,
    yMean + lobeSeparationPixels / 2e0 * sin(radians(angleDegrees)) AS y2
  FROM (SELECT e AS row_id, 'm' || CAST(u // {TRACKS_PER_MOVIE} AS VARCHAR) AS movie,
    CAST(u AS INTEGER) AS track_number, CAST(f AS INTEGER) AS frame_number,
    (u * 97) % 256 + 1 + (e * 31 % 100) / 49.7e0 + ((f * 7) % 5) * 0.2471e0 AS xMean,
    (u * 61) % 256 + 1 + (e * 17 % 100) / 48.3e0 + ((f * 3) % 7) * 0.1237e0 AS yMean,
    ((u * 37) % 180 + (value * 7) % 24) % 180 AS angleDegrees,
    CASE WHEN e % 23 <> 5 THEN (u * 13 % 40) - 20 + (e * 13 % 200) / 101.3e0 + f * 0.0613e0
      + CASE WHEN e % 29 = 0 THEN 7e0 ELSE 0e0 END END AS zMicrons,
    16 + (e % 60) / 10e0 AS lobeSeparationPixels, value / 5e0 + 2 AS minLobeSNR,
    (u * 53) % 400 + 40 + value * 0.25e0 AS amplitude1,
    CAST((u * 53) % 400 + 30 + (e * 7 % 60) AS DOUBLE) AS amplitude2,
    2e0 + (e % 5) / 10e0 AS sigma1, 2e0 + (e % 7) / 10e0 AS sigma2,
    CASE WHEN e % 31 <> 0 THEN 0.05e0 + (e % 7) / 100e0 END AS xPrecisionPx,
    0.05e0 + (e % 5) / 100e0 AS yPrecisionPx, 0.3e0 + (e % 9) / 10e0 AS anglePrecisionDeg,
    0.3e0 + (e % 11) / 20e0 AS zPrecisionUm, 0.3e0 + (e * 19 % 70) / 100e0 AS templateScore,
    CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS recovered,
    CASE WHEN e % 37 = 0 THEN 1 ELSE 0 END AS sharedLobe,
    CASE WHEN e % 23 = 5 THEN CAST(e % 2 + 1 AS INTEGER) WHEN e % 13 = 0 THEN 3 ELSE 0 END AS zStatus
  FROM loc_first))"""


def lobes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lobes of every localization as rows (lobe_id = 2 x row_id + 0/1)."""
    both = F.array(
        F.struct((F.col("row_id") * 2).alias("lobe_id"), F.col("x1").alias("x"), F.col("y1").alias("y"),
                 F.col("amplitude1").alias("amp"), F.col("sigma1").alias("sigma")),
        F.struct((F.col("row_id") * 2 + 1).alias("lobe_id"), F.col("x2").alias("x"), F.col("y2").alias("y"),
                 F.col("amplitude2").alias("amp"), F.col("sigma2").alias("sigma")))
    return loc(spark, sf_dir).select("movie", "frame_number", "row_id", "track_number", F.inline(both))


LOBES = """lobes AS (
  SELECT movie, frame_number, row_id, track_number, row_id * 2 AS lobe_id, x1 AS x, y1 AS y, amplitude1 AS amp, sigma1 AS sigma FROM loc
  UNION ALL
  SELECT movie, frame_number, row_id, track_number, row_id * 2 + 1, x2, y2, amplitude2, sigma2 FROM loc)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 frames in counts."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("e"), F.expr("vec_id div 100").cast("string")).alias("movie"),
        (F.col("vec_id") % 100 + 1).cast("int").alias("frame"), F.lit(8).alias("height"), F.lit(8).alias("width"),
        F.col("label").alias("plane"),
        F.transform("embedding", lambda v: v.cast("double") * 50 + 100).alias("pixels"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_view(frames(spark, sf_dir), "plane")


def pixel_view(frames_df: DataFrame, *keep: str) -> DataFrame:
    """One row per pixel."""
    return frames_df.select("movie", "frame", "height", "width", *keep, F.posexplode("pixels").alias("i", "v")) \
        .select("movie", "frame", "height", "width", *keep, F.expr("i div width").cast("int").alias("y"),
                (F.col("i") % F.col("width")).cast("int").alias("x"), "v")


PIXELS = """pixels AS (
  SELECT 'e' || CAST(vec_id // 100 AS VARCHAR) AS movie, CAST(vec_id % 100 + 1 AS INTEGER) AS frame, 8 AS height, 8 AS width,
    label AS plane, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, v * 50 + 100 AS v
  FROM (SELECT vec_id, label, unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))"""


def curve(spark: SparkSession) -> DataFrame:
    """A generated calibration curve of 301 knots: two depths per angle below 70 degrees, one above."""
    z = F.col("id") / F.lit(10.0) - 10
    return spark.range(0, 301).select(
        F.col("id").cast("int").alias("i"), z.alias("z"), (F.lit(20.0) + F.lit(5.0) * F.abs(z)).alias("angle"),
        (F.lit(19.0) + z / F.lit(3.9) + z * z * F.lit(0.003)).alias("sep"))


CURVE = """curve AS (SELECT CAST(i AS INTEGER) AS i, i / 10e0 - 10 AS z, 20e0 + 5e0 * abs(i / 10e0 - 10) AS angle,
  19e0 + (i / 10e0 - 10) / 3.9e0 + (i / 10e0 - 10) * (i / 10e0 - 10) * 0.003e0 AS sep FROM range(0, 301) t(i))"""


def cal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Localizations of a calibration scan: every bead turns with the plane (= frame)."""
    e, f = F.col("row_id"), F.col("frame_number")
    return loc(spark, sf_dir).withColumns({
        "angleDegrees": F.pmod(f * F.lit(4.7) + (e * 29 % 160) / F.lit(11.3) - 7, F.lit(180.0)),
        "lobeSeparationPixels": F.lit(16.0) + f * F.lit(0.11) + (e % 60) / F.lit(29.7),
        "xMean": F.col("xMean") + F.lit(0.03) * f})


CAL = """cal AS (SELECT * REPLACE (
  ((frame_number * 4.7e0 + (row_id * 29 % 160) / 11.3e0 - 7) % 180 + 180) % 180 AS angleDegrees,
  16e0 + frame_number * 0.11e0 + (row_id % 60) / 29.7e0 AS lobeSeparationPixels,
  xMean + 0.03e0 * frame_number AS xMean) FROM loc)"""


IMAGE = 160
PER_IMAGE = 6
DRAWN = 32  # frames held at once while drawing; a batch of rows would be thousands


def _image(movie: str, frame: int, beads: list[dict]) -> np.ndarray:
    k = np.arange(-11, 12)
    rng = np.random.default_rng([sum(map(ord, movie)) * 31 + int(movie[1:]), int(frame)])
    img = 104.0 + rng.normal(0, 2, (IMAGE, IMAGE))
    for b in beads:
        a, sep = np.radians(b["angleDegrees"]), 16.5 + b["angleDegrees"] / 45.0
        for s in (-0.5, 0.5):
            cx, cy = b["x"] + s * sep * np.cos(a), b["y"] + s * sep * np.sin(a)
            x, y = int(cx) + k, int(cy) + k
            x, y = x[(x >= 0) & (x < IMAGE)], y[(y >= 0) & (y < IMAGE)]
            if len(x) and len(y):
                img[y[0]:y[-1] + 1, x[0]:x[-1] + 1] += b["amp"] * np.exp(-((x - cx) ** 2 + ((y - cy) ** 2)[:, None]) / (2 * 2.2 ** 2))
    return img.ravel().astype(np.float32)


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of movie, frame and beads with the frame's pixels in place of the beads."""
    for batch in (b.slice(i, DRAWN) for b in batches for i in range(0, b.num_rows, DRAWN)):
        keys = (batch[c].to_pylist() for c in ("movie", "frame", "beads"))
        pixels = np.concatenate([_image(*key) for key in zip(*keys, strict=True)])
        lists = pa.ListArray.from_arrays(np.arange(0, len(pixels) + 1, IMAGE * IMAGE, dtype=np.int32), pixels)
        yield batch.drop_columns(["beads"]).append_column("pixels", lists)


def bead_shots(spark: SparkSession, sf_dir: str, first: bool = False) -> Shots:
    """Localizations as 160 x 160 px frames (six tracks per movie): two Gaussian lobes per bead whose
    separation follows the calibration curve at their angle, a flat background and camera noise. Their beads are kept, and a frame is drawn where
    it is used, always alike. With ``first`` there is only each movie's first frame."""
    r = loc(spark, sf_dir, per_movie=PER_IMAGE)
    scale = F.lit((IMAGE - 40) / 262.0)
    r = r.select("movie", F.col("frame_number").alias("frame"), (F.col("xMean") * scale + 20).alias("x"), (F.col("yMean") * scale + 20).alias("y"),
                 "angleDegrees", (F.lit(60.0) + F.col("track_number") * 13 % 140).alias("amp"))
    packed = r.groupBy("movie", "frame").agg(F.array_sort(F.collect_list(F.struct("x", "y", "angleDegrees", "amp"))).alias("beads"))
    if first:
        packed = packed.withColumn("_f", F.min("frame").over(Window.partitionBy("movie"))).where("frame = _f").drop("_f")
    return Shots(cut(packed.withColumns({"height": F.lit(IMAGE), "width": F.lit(IMAGE)})), "beads", _draw)


def bead_frames(spark: SparkSession, sf_dir: str, first: bool = False) -> DataFrame:
    """The frames of ``bead_shots`` with their pixels."""
    shots = bead_shots(spark, sf_dir, first)
    return shots.load(shots.spread(shots.rows, "frame", "movie")).select("movie", "frame", "height", "width", "pixels")


def bead_curve(spark: SparkSession) -> DataFrame:
    """The calibration curve the drawn beads follow."""
    i = F.col("id")
    return spark.range(0, 361).select(i.cast("int").alias("i"), (i / F.lit(6.0) - 30).alias("z"), (i / F.lit(2.0)).alias("angle"), (F.lit(16.5) + i / F.lit(90.0)).alias("sep"))
