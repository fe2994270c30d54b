"""Relations over a stream of frames.

A stream whose rows are whole frames (an array of objects each) needs no state: pairs come from the
array. A stream of single detections is gathered by frame first, in state that a watermark ends.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import quantize as Q

FRAME_SCHEMA = "video string, frame long, objects array<struct<track_id: long, class_id: int, cx: double, cy: double>>"


def frames_of(detections: DataFrame, time_col: str, delay: str = "1 minute") -> DataFrame:
    """Detections (video, row_id, frame, track_id, class_id, cx, cy and a time) of a stream to whole frames.

    A frame is kept by (video, frame), whatever times its rows have, and leaves once the watermark has
    passed its latest row; later rows are dropped. Of a track's rows in a frame the last by row_id
    gives the point, and every class counts.
    """

    def run(key, batches, state):
        held = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            last, classes = {}, {}
            for row, track, cls, x, y in sorted(map(tuple, held)):
                last[int(track)] = (float(x), float(y))
                classes.setdefault(int(track), set()).add(int(cls))
            yield pd.DataFrame({"video": [key[0]], "frame": [key[1]], "objects": [[{"track_id": t, "class_id": c, "cx": last[t][0], "cy": last[t][1]} for t in sorted(last) for c in sorted(classes[t])]]})
            return
        held, latest = [list(map(float, r)) for r in held], 0
        for b in batches:
            held += b[["row_id", "track_id", "class_id", "cx", "cy"]].astype(float).to_numpy().tolist()
            latest = max(latest, int(b["_ms"].max()))
        state.update((held,))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)

    rows = detections.withWatermark(time_col, delay).select("video", "frame", "row_id", "track_id", "class_id", "cx", "cy", time_col, F.unix_millis(time_col).alias("_ms"))
    return rows.groupBy("video", "frame").applyInPandasWithState(run, FRAME_SCHEMA, "rows array<array<double>>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_relations(frames: DataFrame, width: float, height: float, theta_parts: int = Q.THETA_PARTS, dist_parts: int = Q.DIST_PARTS) -> DataFrame:
    """Directed relations of each frame, for batch and streaming frames alike."""
    a = frames.select("video", "frame", "objects", F.explode("objects").alias("a"))
    ab = a.select("video", "frame", "a", F.explode("objects").alias("b")).where("a.track_id <> b.track_id")
    xy = [F.col(c) for c in ("a.cx", "a.cy", "b.cx", "b.cy")]
    return ab.select(
        "video", "frame", F.col("a.track_id").alias("src"), F.col("b.track_id").alias("dst"), F.col("a.class_id").alias("src_class"), F.col("b.class_id").alias("dst_class"),
        Q.theta_bin(Q.theta(*xy), theta_parts).alias("theta_bin"), Q.dist_bin(Q.distance(*xy) / F.lit(Q.base_length(width, height)), dist_parts).alias("dist_bin"),
    )
