"""Objects of each frame, and the edges and relations between them.

All joins here are on (video, frame). Detections are dealt by those two columns once; grouping by
track and the self-joins then need no further shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quantize as Q
from ..functions.intervals import to_runs

FRAME = ["video", "frame"]
MODES = ("normal", "complete", "pattern")


def objects(detections: DataFrame) -> DataFrame:
    """video, frame, track_id, cx, cy, slot, classes: the last row's point (of rows with one row_id the largest, so that every pass finds the same), the first row's place, every class seen."""
    return (
        detections.repartition(*FRAME)
        .groupBy(*FRAME, "track_id")
        .agg(F.max(F.struct("row_id", "cx", "cy")).alias("p"), F.min("row_id").alias("slot"), F.collect_set("class_id").alias("classes"))
        .select(*FRAME, "track_id", "p.cx", "p.cy", "slot", "classes")
    )


def positions(detections: DataFrame) -> DataFrame:
    return objects(detections).drop("classes")


def typed_objects(detections: DataFrame, types=None) -> DataFrame:
    """One row for each object, frame and observed class."""
    out = objects(detections).withColumn("class_id", F.explode("classes")).drop("classes", "slot")
    return out if types is None else out.where(F.col("class_id").isin(*sorted(set(types))))


def edges(detections: DataFrame, height: float, width: float, mode: str = "normal") -> DataFrame:
    """video, frame, sid, eid, theta, d, d_ratio. normal: one edge a pair, from the smaller (x, y); complete: both ways; pattern: from each frame's smallest to the rest."""
    if mode not in MODES:
        raise ValueError(f"build mode {mode!r} is none of {MODES}")
    p = positions(detections)
    if mode == "pattern":
        a = p.groupBy(*FRAME).agg(F.min(F.struct("cx", "cy", "slot", "track_id")).alias("a")).select(*FRAME, "a.*")
    else:
        a = p
    a, b = a.alias("a"), p.alias("b")
    on = (F.col("a.video") == F.col("b.video")) & (F.col("a.frame") == F.col("b.frame"))
    if mode == "normal":
        order = lambda s: F.struct(f"{s}.cx", f"{s}.cy", f"{s}.slot")
        on = on & (order("a") < order("b"))
    on = on & (F.col("a.track_id") != F.col("b.track_id"))
    xy = [F.col(c) for c in ("a.cx", "a.cy", "b.cx", "b.cy")]
    d = Q.distance(*xy)
    return a.join(b, on).select("a.video", "a.frame", F.col("a.track_id").alias("sid"), F.col("b.track_id").alias("eid"), Q.theta(*xy).alias("theta"), d.alias("d"), (d / F.lit(Q.base_length(width, height))).alias("d_ratio"))


def quantized(e: DataFrame, theta_parts: int = Q.THETA_PARTS, dist_parts: int = Q.DIST_PARTS) -> DataFrame:
    return e.withColumns({"theta_bin": Q.theta_bin(F.col("theta"), theta_parts), "dist_bin": Q.dist_bin(F.col("d_ratio"), dist_parts)})


def _pair(a: DataFrame, b: DataFrame, base: float, theta_parts: int, dist_parts: int) -> DataFrame:
    a, b = a.alias("a"), b.alias("b")
    xy = [F.col(c) for c in ("a.cx", "a.cy", "b.cx", "b.cy")]
    on = (F.col("a.video") == F.col("b.video")) & (F.col("a.frame") == F.col("b.frame")) & (F.col("a.track_id") != F.col("b.track_id"))
    return a.join(b, on).select(
        "a.video", "a.frame", F.col("a.track_id").alias("src"), F.col("b.track_id").alias("dst"), F.col("a.class_id").alias("src_class"), F.col("b.class_id").alias("dst_class"),
        Q.theta_bin(Q.theta(*xy), theta_parts).alias("theta_bin"), Q.dist_bin(Q.distance(*xy) / F.lit(base), dist_parts).alias("dist_bin"),
    )


def relations(detections: DataFrame, width: float, height: float, theta_parts: int = Q.THETA_PARTS, dist_parts: int = Q.DIST_PARTS, allowed_types=None, allowed_type_pairs=None) -> DataFrame:
    """Directed relations of all ordered pairs of different objects in a frame. Restrictions hold before the join, pair restrictions in it."""
    if allowed_type_pairs is not None:
        allowed_types = {t for p in allowed_type_pairs for t in p} & (set(allowed_types) if allowed_types is not None else {t for p in allowed_type_pairs for t in p})
    t = typed_objects(detections, allowed_types)
    out = _pair(t, t, Q.base_length(width, height), theta_parts, dist_parts)
    if allowed_type_pairs is not None:
        out = out.where(F.struct("src_class", "dst_class").isin(*[F.struct(F.lit(a).alias("src_class"), F.lit(b).alias("dst_class")) for a, b in sorted(allowed_type_pairs)]))
    return out


def relation_of(typed: DataFrame, src_class: int, dst_class: int, match: Column, width: float, height: float, theta_parts: int, dist_parts: int) -> DataFrame:
    """Frames and pairs of one constraint: only the two classes are joined."""
    return _pair(typed.where(F.col("class_id") == src_class), typed.where(F.col("class_id") == dst_class), Q.base_length(width, height), theta_parts, dist_parts).where(match)


def raw_row_relations(detections: DataFrame, width: float, height: float) -> DataFrame:
    """As relations, but rows that repeat a track in a frame stay objects of their own."""
    rows = detections.select(*FRAME, "track_id", "class_id", "cx", "cy").distinct()
    return _pair(rows, rows, Q.base_length(width, height), Q.THETA_PARTS, Q.DIST_PARTS).distinct()


def postings(rel: DataFrame) -> DataFrame:
    """Relations with consecutive frames run together: a row for each key, pair and maximal run."""
    return to_runs(rel, ["video", "src_class", "dst_class", "theta_bin", "dist_bin", "src", "dst"])


@dataclass(frozen=True)
class TemporalPattern:
    nodes: DataFrame
    edges: DataFrame
    length: int


def pattern_extract(detections: DataFrame, ids, start: int, end: int, height: float, width: float) -> TemporalPattern:
    """Chosen objects over an inclusive range of frames, with frames from 1, their edges from each frame's anchor, and the length."""
    nodes = detections.where(F.col("track_id").isin(*ids) & F.col("frame").between(start, end)).withColumn("frame", F.col("frame") - start + 1)
    return TemporalPattern(nodes, edges(nodes, height, width, "pattern"), end - start + 1)
