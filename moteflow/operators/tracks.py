"""Per-track statistics and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TRACK = ["movie", "track_number"]


def distance3(dx: Column, dy: Column, dz: Column, pixel_um: float) -> Column:
    """3-D distance in µm from pixel and µm differences; lateral only where z is missing."""
    z = F.coalesce(dz, F.lit(0.0))
    x, y = dx * F.lit(pixel_um), dy * F.lit(pixel_um)
    return F.sqrt(x * x + y * y + z * z)


def track_stats(rows: DataFrame, x: str, y: str, z: str, pixel_um: float) -> DataFrame:
    """Length, span, depth, net and largest move, recovered share per track. One shuffle by track: the
    step window and the aggregation share it."""
    w = Window.partitionBy(*TRACK).orderBy("frame_number", "row_id")
    step = distance3(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w), F.col(z) - F.lag(z).over(w), pixel_um)
    order = F.struct("frame_number", "row_id")
    at = F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z"))
    agg = rows.withColumn("_step", step).groupBy(*TRACK).agg(
        F.count("*").alias("n_rows"), F.min("frame_number").alias("first_frame"), F.max("frame_number").alias("last_frame"),
        F.avg(z).alias("mean_z"), (F.max(z) - F.min(z)).alias("z_range"), F.max("_step").alias("max_step"),
        (F.avg(F.col("recovered").cast("double")) * 100).alias("pct_recovered"),
        F.min_by(at, order).alias("_a"), F.max_by(at, order).alias("_b"))
    net = distance3(F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y"), F.col("_b.z") - F.col("_a.z"), pixel_um)
    return agg.withColumns({"net_move": net, "max_step": F.coalesce("max_step", F.lit(0.0))}).drop("_a", "_b")
