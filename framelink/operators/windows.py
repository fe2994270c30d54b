"""Windows of frames between key frames, and the indexes of each window."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = ["video", "window_id"]


def windows_from_key_frames(keys: DataFrame) -> DataFrame:
    """video, window_id, start_frame, end_frame (null: open) from ascending key frames; a key frame below 1 is an error."""
    by = Window.partitionBy("video").orderBy("start_frame")
    checked = F.when(F.col("start_frame") >= 1, F.col("start_frame")).otherwise(F.raise_error(F.lit("key frames begin at 1")).cast("long"))
    return keys.select("video", "start_frame").distinct().select("video", F.row_number().over(by).alias("window_id"), checked.alias("start_frame"), (F.lead("start_frame").over(by) - 1).alias("end_frame"))


def last_frames(df: DataFrame) -> DataFrame:
    return df.groupBy("video").agg(F.max("frame").alias("last"))


def assign_windows(df: DataFrame, windows: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """df with window_id; frames before the first key frame drop out.

    Each window is spread over its frames and joined by equality, so neither a broadcast that grows
    with the video nor a nested loop is needed. last: last_frames of the detections, where df is a
    self-join of them that isn't to be made twice.
    """
    last = last_frames(df) if last is None else last
    spans = windows.join(last, "video").withColumn("end_frame", F.least(F.coalesce("end_frame", "last"), "last")).where("start_frame <= end_frame")
    spread = spans.select("video", "window_id", F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    return df.join(spread, ["video", "frame"])


def segment(frame_ids: DataFrame, s: float) -> DataFrame:
    """Key frames: a frame whose set of ids has a Jaccard similarity below s to the last key frame's begins a window.

    Each key frame depends on the one before, so a video is read in order by one task; it carries
    the last key frame's ids from row to row and never holds the video.
    """

    def run(batches):
        video, last = None, None
        for b in batches:
            out = []
            for v, frame, ids in zip(b["video"], b["frame"], b["ids"], strict=True):
                ids = frozenset(ids)
                union = len(ids | last) if last is not None else 0
                if v != video or last is None or (union and len(ids & last) / union < s):
                    out.append((v, frame))
                    video, last = v, ids
            if out:
                yield pd.DataFrame(out, columns=["video", "start_frame"])

    return frame_ids.select("video", "frame", "ids").repartition("video").sortWithinPartitions("video", "frame").mapInPandas(run, "video string, start_frame long")


def type_index_last(detections: DataFrame) -> DataFrame:
    """video, window_id, track_id, class_id with the class of each track's last row in the window."""
    return detections.groupBy(*WINDOW, "track_id").agg(F.max_by("class_id", F.struct("frame", "row_id")).alias("class_id"))


def type_index_all(detections: DataFrame) -> DataFrame:
    return detections.select(*WINDOW, "track_id", "class_id").distinct()


def edge_index(edges: DataFrame) -> DataFrame:
    """video, window_id, sid, eid, theta_bin, dist_bin, frame: each once."""
    return edges.select(*WINDOW, "sid", "eid", "theta_bin", "dist_bin", "frame").distinct()


def compact(index: DataFrame) -> DataFrame:
    return index.groupBy(*WINDOW, "sid", "eid", "theta_bin", "dist_bin").agg(F.sort_array(F.collect_set("frame")).alias("frames"))


def filter_set(types_of: DataFrame, types) -> DataFrame:
    """Of windows with every type, the rows of those types."""
    wanted = sorted(set(types))
    rows = types_of.where(F.col("class_id").isin(*wanted))
    whole = rows.groupBy(*WINDOW).agg(F.countDistinct("class_id").alias("n")).where(F.col("n") == len(wanted)).drop("n")
    return rows.join(whole, WINDOW, "left_semi")


def filter_multiset(types_of: DataFrame, types) -> DataFrame:
    """Of windows with as many tracks of each type as the query names, the rows of those types."""
    wanted = Counter(types)
    rows = types_of.where(F.col("class_id").isin(*sorted(wanted)))
    enough = F.coalesce(*[F.when(F.col("class_id") == t, F.lit(n)) for t, n in sorted(wanted.items())])
    per = rows.groupBy(*WINDOW, "class_id").agg(F.countDistinct("track_id").alias("n")).where(F.col("n") >= enough)
    whole = per.groupBy(*WINDOW).count().where(F.col("count") == len(wanted)).drop("count")
    return rows.join(whole, WINDOW, "left_semi")
