"""Scans: tracker CSV files, boxes, and the adapter from an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import exists

MULTI = "frame long, id long, left double, top double, width double, height double, conf double, class int, x double, y double, z double"
SINGLE = "frame long, id long, left double, top double, width double, height double, conf double, x double, y double, z double"
DETECTION = ["video", "row_id", "frame", "track_id", "class_id", "cx", "cy", "width", "height"]


def read_tracks(spark: SparkSession, path: str, video: str | None = None, class_id: int | None = None) -> DataFrame:
    """Boxes of a headerless tracker CSV; class_id is set for files without a class column.

    row_id follows the order of lines in each file. Rows without frame, id or geometry are refused.
    """
    rows = spark.read.csv(path, schema=SINGLE if class_id is not None else MULTI, header=False, mode="FAILFAST")
    if class_id is not None:
        rows = rows.withColumn("class", F.lit(class_id))
    name = F.lit(video) if video is not None else F.regexp_extract(F.input_file_name(), "([^/]+?)(\\.[^./]*)?$", 1)
    bad = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("frame", "id", "class", "left", "top", "width", "height")])
    rows = rows.withColumn("frame", F.when(bad.isNull(), F.col("frame")).otherwise(F.raise_error(F.concat(F.lit("null in "), bad)).cast("long")))
    return rows.select(name.alias("video"), F.monotonically_increasing_id().alias("row_id"), "frame", F.col("id").alias("track_id"), F.col("class").alias("class_id"), "left", "top", "width", "height")


def cached_tracks(spark: SparkSession, path: str, cache: str, **options) -> DataFrame:
    """read_tracks(path), parsed once and kept as Parquet at `cache`, which is read as it stands if it's there."""
    if not exists(spark, f"{cache}/_SUCCESS"):
        read_tracks(spark, path, **options).write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def centers(boxes: DataFrame) -> DataFrame:
    """Boxes to centre points; frames below 1 are dropped."""
    return boxes.where("frame >= 1").select("video", "row_id", "frame", "track_id", "class_id", (F.col("left") + F.col("width") / 2).alias("cx"), (F.col("top") + F.col("height") / 2).alias("cy"), "width", "height")


def frame_ids(detections: DataFrame) -> DataFrame:
    """video, frame, ids for all frames from 1 to the last; gaps have an empty list."""
    last = detections.groupBy("video").agg(F.max("frame").alias("last")).where("last >= 1")
    every = last.select("video", F.explode(F.sequence(F.lit(1).cast("long"), "last")).alias("frame"))
    seen = detections.groupBy("video", "frame").agg(F.sort_array(F.collect_list(F.struct("row_id", "track_id")))["track_id"].alias("ids"))
    return every.join(seen, ["video", "frame"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<long>")))


def events_as_detections(events: DataFrame, frame_events: int = 12, tracks: int = 8) -> DataFrame:
    """The driver's event table as detections in a 1920 x 1080 frame; rows of one track and frame repeat and the last counts."""
    track = F.col("user_id") % tracks
    return events.select(
        F.lit("events").alias("video"), F.col("event_id").alias("row_id"), F.expr(f"event_id div {frame_events} + 1").alias("frame"), track.alias("track_id"), (track % 3).cast("int").alias("class_id"),
        F.least(F.col("value") * 10, F.lit(1900.0)).alias("cx"), (F.get_json_object("props", "$.k").cast("double") * 10).alias("cy"), F.lit(0.0).alias("width"), F.lit(0.0).alias("height"),
    )
