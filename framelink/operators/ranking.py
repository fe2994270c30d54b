"""Threshold, merge over windows, and top-k of bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roles_of(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c.startswith("role_")), key=lambda c: int(c[5:]))


def merge_windows(matches: DataFrame) -> DataFrame:
    """Matches (video, roles, frame, of any window) to one row a binding with its frames and their number."""
    keys = ["video", *roles_of(matches)]
    return matches.groupBy(*keys).agg(F.sort_array(F.collect_set("frame")).alias("frames")).withColumn("n_frames", F.size("frames").cast("long"))


def over_threshold(merged: DataFrame, threshold: int) -> DataFrame:
    return merged.where(F.col("n_frames") > threshold)


def top_k(merged: DataFrame, k: int) -> DataFrame:
    """Most frames first; ties by binding."""
    return merged.orderBy(F.desc("n_frames"), "video", *roles_of(merged)).limit(k)
