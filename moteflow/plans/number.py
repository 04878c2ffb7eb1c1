"""Consecutive numbers within a group of any size, and numbers of tasks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from moteflow.session import cut


def number_within(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """1, 2, 3, ... by ``order`` within ``key``: a range sort over (key, order) numbers each sorted partition
    and adds the counts before it."""
    part = cut(df.repartitionByRange(key, *order).withColumn("_pid", F.spark_partition_id()))
    counts = part.groupBy(key, "_pid").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(Window.partitionBy(key, "_pid").orderBy(*order))
    return part.withColumn("_rn", local).join(counts.select(key, "_pid", before.alias("_off")), [key, "_pid"]) \
        .withColumn(out, (F.col("_rn") + F.col("_off")).cast("int")).drop("_pid", "_rn", "_off")


def next_in_order(df: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """``value`` of the following row by ``order`` within ``key``. The table is range-sorted, each partition
    looks ahead on its own, and its last row of a key takes the first of the next partition."""
    part = cut(df.repartitionByRange(key, *order).withColumn("_pid", F.spark_partition_id()))
    heads = part.groupBy(key, "_pid").agg(F.min_by(value, F.struct(*order)).alias("_h"))
    heads = heads.select(key, "_pid", F.lead("_h").over(Window.partitionBy(key).orderBy("_pid")).alias("_h"))
    local = F.lead(value).over(Window.partitionBy(key, "_pid").orderBy(*order))
    return part.withColumn("_l", local).join(heads, [key, "_pid"]).withColumn(out, F.coalesce("_l", "_h")).drop("_pid", "_l", "_h")


def shares(df: DataFrame, rows: int) -> int:
    """Tasks of about ``rows`` rows, one for each core at least. For rows of few bytes but much work, which adaptive execution
    would merge into one task unless their number is given."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows))
