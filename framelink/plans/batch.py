"""Whole runs: building the indexes of a video set, and lists of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quantize as Q
from ..operators import compressed, match, patterns, ranking, relations, windows
from ..sources.shared import stored


def build_indexes(detections: DataFrame, keys: DataFrame, width: float = 1920, height: float = 1080, theta_parts: int = Q.THETA_PARTS, dist_parts: int = Q.DIST_PARTS, mode: str = "normal", all_types: bool = False) -> dict[str, DataFrame]:
    """type_index, edge_index, cg_vertices, cg_edges and cg_pairs of all windows between key frames."""
    spans = windows.windows_from_key_frames(keys)
    last = windows.last_frames(detections)
    inside = windows.assign_windows(detections, spans, last)
    e = relations.quantized(relations.edges(detections, height, width, mode), theta_parts, dist_parts)
    index = stored(windows.edge_index(windows.assign_windows(e, spans, last)))  # these two are read by several others
    vertices = stored(compressed.cg_vertices(patterns.node_sets(inside.select("video", "window_id", "frame", "track_id").distinct())))
    types = windows.type_index_all(inside) if all_types else windows.type_index_last(inside)
    return {"type_index": types, "edge_index": index, "cg_vertices": vertices, "cg_edges": compressed.cg_edges(vertices), "cg_pairs": compressed.cg_pairs(vertices, index)}


def threshold_query(types_of: DataFrame, index: DataFrame, types, limits=(1.0, 5.0), threshold: int = 2, topk: int | None = 5, strict: bool = True, cap: int | None = None) -> DataFrame:
    """Bindings with their frames over all windows; limits for all pairs, or one for each in a dict (strict only)."""
    hits = match.strict_match(types_of, index, types, limits, cap) if strict else match.lenient_match(types_of, index, types, *limits, cap)
    out = ranking.over_threshold(ranking.merge_windows(hits), threshold)
    return out if topk is None else ranking.top_k(out, topk)


def batch(types_of: DataFrame, index: DataFrame, type_lists, **options) -> DataFrame:
    """One query for each list of types; roles that a query lacks are null."""
    out = None
    for k, types in enumerate(type_lists):
        part = threshold_query(types_of, index, types, **options).withColumn("query_id", F.lit(f"q{k}"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
