"""Directed queries: all relations in the same frame, then maximal runs of consecutive frames.

A query compiles to equi-joins on (video, frame) and shared roles; the relation tables and the
objects are all dealt by (video, frame), so Spark needs one shuffle of the detections, and one more
by binding for the runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import from_runs, to_runs
from ..operators.relations import FRAME, postings, relation_of, relations, typed_objects
from .spec import QuerySpec, RelationConstraint


def constraint(c: RelationConstraint) -> Column:
    return F.col("theta_bin").isin(*sorted(c.theta_bins)) & F.col("dist_bin").between(c.d_min, c.d_max)


def join_order(relations: dict) -> list[tuple[int, int]]:
    """Each relation after one that shares a role with it, where there is one."""
    left, out, seen = sorted(relations), [], set()
    while left:
        nxt = next((r for r in left if seen & set(r)), left[0])
        left.remove(nxt)
        out.append(nxt)
        seen |= set(nxt)
    return out


def bindings(tables: dict[tuple[int, int], DataFrame], typed: DataFrame, spec: QuerySpec) -> DataFrame:
    """video, frame, roles: tables hold (video, frame, src, dst) that meet each constraint; typed: objects by class."""
    out, have = None, []

    def take(df: DataFrame, roles: list[int]) -> None:
        nonlocal out
        new = [i for i in roles if i not in have]
        out = df if out is None else out.join(df, [*FRAME, *(f"role_{i}" for i in roles if i in have)])
        for k, i in enumerate(new):
            for j in [*have, *new[:k]]:
                out = out.where(F.col(f"role_{i}") != F.col(f"role_{j}"))
        have.extend(new)

    for i, j in join_order(tables):
        take(tables[i, j].select(*FRAME, F.col("src").alias(f"role_{i}"), F.col("dst").alias(f"role_{j}")).distinct(), [i, j])
    for i, t in enumerate(spec.role_types):
        if i not in have:
            take(typed.where(F.col("class_id") == t).select(*FRAME, F.col("track_id").alias(f"role_{i}")).distinct(), [i])
    return out.select(*FRAME, *(f"role_{i}" for i in range(len(spec.role_types))))


def ranked_runs(bound: DataFrame, spec: QuerySpec, return_all: bool) -> DataFrame:
    """query_id, video, roles, start_frame, end_frame, length of runs that are long enough: the longest first, then the earliest, then by binding."""
    roles = [f"role_{i}" for i in range(len(spec.role_types))]
    runs = to_runs(bound, ["video", *roles]).withColumn("length", F.col("end_frame") - F.col("start_frame") + 1).where(F.col("length") >= spec.min_consecutive_frames)
    runs = runs.select(F.lit(spec.query_id).alias("query_id"), "video", *roles, "start_frame", "end_frame", "length")
    order = [F.desc("length"), "start_frame", *roles, "video"]
    return runs if return_all else runs.orderBy(*order).limit(spec.topk)


def exact_query(detections: DataFrame, spec: QuerySpec, width: float, height: float, return_all: bool = False, candidate_bindings: DataFrame | None = None, candidate_frames: DataFrame | None = None) -> DataFrame:
    """candidate_bindings (video, roles), candidate_frames (video, frame): if given, nothing else is looked at."""
    if candidate_frames is not None:
        detections = detections.join(candidate_frames.select(*FRAME).distinct(), FRAME, "left_semi")
    typed = typed_objects(detections, spec.role_types)
    tables = {(i, j): relation_of(typed, spec.role_types[i], spec.role_types[j], constraint(c), width, height, spec.theta_parts, spec.distance_parts) for (i, j), c in spec.relations.items()}
    bound = bindings(tables, typed, spec)
    if candidate_bindings is not None:
        bound = bound.join(candidate_bindings, ["video", *(f"role_{i}" for i in range(len(spec.role_types)))], "left_semi")
    return ranked_runs(bound, spec, return_all)


def run_stats(bound: DataFrame, results: DataFrame) -> DataFrame:
    """One row: candidate_bindings, candidate_frames (bindings and frames that meet all relations), results."""
    roles = [c for c in bound.columns if c.startswith("role_")]
    return bound.agg(F.countDistinct("video", *roles).alias("candidate_bindings"), F.countDistinct(*FRAME).alias("candidate_frames")).crossJoin(results.agg(F.count("*").alias("results")))


class DirectedIndex:
    """Relations run together by key, to be written by class pair: a query reads only the folders of its class pairs."""

    PARTITION_BY = ("src_class", "dst_class")

    def __init__(self, table: DataFrame, detections: DataFrame, theta_parts: int, distance_parts: int):
        self.table, self.detections, self.parts = table, detections, (theta_parts, distance_parts)

    @classmethod
    def build(cls, detections: DataFrame, width: float, height: float, theta_parts: int = 10, distance_parts: int = 8, allowed_types=None, allowed_type_pairs=None) -> DirectedIndex:
        rel = relations(detections, width, height, theta_parts, distance_parts, allowed_types, allowed_type_pairs)
        return cls(postings(rel), detections, theta_parts, distance_parts)

    def write(self, path: str) -> None:
        self.table.write.mode("overwrite").partitionBy(*self.PARTITION_BY).parquet(path)

    def from_path(self, path: str) -> DirectedIndex:
        return DirectedIndex(self.detections.sparkSession.read.parquet(path), self.detections, *self.parts)

    def lookup(self, src_class: int, dst_class: int, c: RelationConstraint) -> DataFrame:
        """Pairs and frames of one constraint."""
        hit = self.table.where((F.col("src_class") == src_class) & (F.col("dst_class") == dst_class)).where(constraint(c))
        return from_runs(hit).select(*FRAME, "src", "dst").distinct()

    def bound(self, spec: QuerySpec) -> DataFrame:
        """video, frame, roles that meet all relations."""
        if (spec.theta_parts, spec.distance_parts) != self.parts:
            raise ValueError(f"quantization of the query, {spec.theta_parts}/{spec.distance_parts} parts, isn't that of the index, {self.parts[0]}/{self.parts[1]}")
        tables = {(i, j): self.lookup(spec.role_types[i], spec.role_types[j], c) for (i, j), c in spec.relations.items()}
        return bindings(tables, typed_objects(self.detections, spec.role_types), spec)

    def query(self, spec: QuerySpec, return_all: bool = False) -> DataFrame:
        return ranked_runs(self.bound(spec), spec, return_all)

    def stats(self, spec: QuerySpec) -> DataFrame:
        bound = self.bound(spec)
        return run_stats(bound, ranked_runs(bound, spec, True))
