"""Runs of consecutive frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_runs(df: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """keys, start_frame, end_frame of each maximal run; repeated frames count once."""
    one = df.select(*keys, frame).distinct()
    island = F.col(frame) - F.row_number().over(Window.partitionBy(*keys).orderBy(frame))
    runs = one.withColumn("island", island).groupBy(*keys, "island").agg(F.min(frame).alias("start_frame"), F.max(frame).alias("end_frame"))
    return runs.drop("island")


def from_runs(df: DataFrame, frame: str = "frame") -> DataFrame:
    return df.withColumn(frame, F.explode(F.sequence("start_frame", "end_frame"))).drop("start_frame", "end_frame")


def is_consecutive(frames: Column) -> Column:
    return F.array_max(frames) - F.array_min(frames) + 1 == F.size(F.array_distinct(frames))
