"""An engine over stored pair indexes that were made earlier, perhaps incomplete or for another frame size.

Stored pairs are compared with the detections once, at the first use, and what that finds is written by
class pair to the shared folder: each relation with the stored bins that stand for it, the frames in
which the store lacks a pair or holds a wrong bin, and which actual bins were seen under each stored
one. A query then reads only the folders of its class pairs, and there only stored bins whose audited
bins allow the constraint; the detections are joined anew in the frames that failed alone.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quantize as Q
from ..operators.relations import FRAME, relation_of, relations, typed_objects
from ..operators.windows import WINDOW
from ..sources.shared import file_system, hadoop_path, shared_folder, size_of, stored
from .exact import bindings, constraint, ranked_runs, run_stats
from .spec import QuerySpec, RelationConstraint

STORED = [*WINDOW, "sid", "eid", "theta_bin", "dist_bin", "frame"]


AUDIT = ("src_class", "dst_class")


class PreparedEngine:
    """detections: with any classes; sidecar, graph: stored pairs with columns STORED, either may be None. path: where the audit is written, else a folder of its own."""

    def __init__(
        self, detections: DataFrame, width: float, height: float, sidecar: DataFrame | None = None, graph: DataFrame | None = None, legacy_single_direction: bool = False,
        indexed_width: float | None = None, indexed_height: float | None = None, theta_parts: int = Q.THETA_PARTS, distance_parts: int = Q.DIST_PARTS, path: str | None = None,
    ):
        self.detections, self.size, self.parts, self.legacy = detections, (width, height), (theta_parts, distance_parts), legacy_single_direction
        self.scale = Q.base_length(width, height)
        self.indexed_scale = Q.base_length(width if indexed_width is None else indexed_width, height if indexed_height is None else indexed_height)
        none = detections.sparkSession.createDataFrame([], "video string, window_id int, sid long, eid long, theta_bin int, dist_bin int, frame long")
        self.sidecar, self.graph = (x.select(*STORED).distinct() if x is not None else none for x in (sidecar, graph))
        self.stored = self.sidecar.unionByName(self.graph).distinct()
        self.path, self.setup_seconds, self._tables = path, None, None

    def prepare(self) -> PreparedEngine:
        """Audit and write, once; later calls do nothing."""
        if self._tables is None:
            began = time.perf_counter()
            self.path = self.path or shared_folder(self.detections.sparkSession)
            actual = relations(self.detections, *self.size, *self.parts)
            # Both ways that a stored row can be read; reading it backwards is for stores with one direction only.
            bins = (F.col("theta_bin").alias("s_theta"), F.col("dist_bin").alias("s_dist"))
            forward = self.stored.select(*FRAME, F.col("sid").alias("src"), F.col("eid").alias("dst"), *bins, F.lit(False).alias("reverse"))
            backward = self.stored.select(*FRAME, F.col("eid").alias("src"), F.col("sid").alias("dst"), *bins, F.lit(True).alias("reverse"))
            seen = stored(actual.join(forward.unionByName(backward) if self.legacy else forward, [*FRAME, "src", "dst"], "left"), f"{self.path}/seen", AUDIT)
            failed = stored(self._failed(seen), f"{self.path}/fallback")
            hit = seen.where(F.col("s_theta").isNotNull())
            options = hit.groupBy("reverse", "s_theta", "s_dist").agg(F.sort_array(F.collect_set("theta_bin")).alias("theta_options"), F.sort_array(F.collect_set("dist_bin")).alias("distance_options"))
            self._tables = {"seen": seen, "fallback": failed, "options": stored(options, f"{self.path}/options")}
            self.setup_seconds = time.perf_counter() - began
        return self

    def _table(self, name: str) -> DataFrame:
        return self.prepare()._tables[name]

    def _agrees(self) -> Column:
        """The stored bins can stand for the actual ones. Equal points have angle 0 and distance 0 from either end; a wrong bin of that kind fails when it is read forwards."""
        same = (F.col("s_theta") == 0) & (F.col("theta_bin") == 0) & (F.col("s_dist") == 0) & (F.col("dist_bin") == 0)
        theta = F.when(F.col("reverse"), same | (Q.reversed_bin(F.col("s_theta"), self.parts[0]) == F.col("theta_bin")) | ((F.col("s_theta") == 0) & (F.col("theta_bin") == self.parts[0])) | (F.abs(F.pmod(F.col("s_theta") + self.parts[0] - F.col("theta_bin") + self.parts[0], F.lit(2 * self.parts[0])) - self.parts[0]) <= 1)).otherwise(F.col("s_theta") == F.col("theta_bin"))
        s, a = self.indexed_scale / self.parts[1], self.scale / self.parts[1]
        dist = F.col("s_dist") == F.col("dist_bin") if self.indexed_scale == self.scale else (F.col("s_dist") * F.lit(s) < (F.col("dist_bin") + 1) * F.lit(a)) & (F.col("dist_bin") * F.lit(a) < (F.col("s_dist") + 1) * F.lit(s))
        return theta & dist

    def _failed(self, seen: DataFrame) -> DataFrame:
        good = F.coalesce(self._agrees(), F.lit(False))
        per = seen.groupBy(*FRAME, "src", "dst", "theta_bin", "dist_bin").agg(F.max(good).alias("ok"), F.min(F.when(F.col("s_theta").isNotNull(), good)).alias("all_ok"))
        lacking = per.where(~F.col("ok") | ~F.coalesce("all_ok", F.lit(True))).select(*FRAME)
        stray = self.stored.select(*FRAME, F.col("sid").alias("src"), F.col("eid").alias("dst")).join(seen, [*FRAME, "src", "dst"], "left_anti").select(*FRAME)
        return lacking.unionByName(stray).distinct()

    def fallback_frames(self) -> DataFrame:
        """video, frame where a pair isn't stored, is stored with wrong bins only, or a stored row has no such pair."""
        return self._table("fallback")

    def bin_options(self) -> DataFrame:
        """Each stored bin pair, read either way, with the actual bins that were seen under it."""
        return self._table("options")

    def type_directory(self) -> DataFrame:
        """video, window_id, src_class, dst_class, reverse, sid, eid: pair keys only."""
        classes = typed_objects(self.detections).select("video", "frame", "track_id", "class_id")
        s, e = (classes.withColumnsRenamed({"track_id": k, "class_id": f"{k}_class"}) for k in ("sid", "eid"))
        keys = self.stored.select(*WINDOW, "frame", "sid", "eid").join(s, [*FRAME, "sid"]).join(e, [*FRAME, "eid"]).select(*WINDOW, "sid", "eid", "sid_class", "eid_class").distinct()
        forward = keys.select(*WINDOW, F.col("sid_class").alias("src_class"), F.col("eid_class").alias("dst_class"), F.lit(False).alias("reverse"), "sid", "eid")
        backward = keys.select(*WINDOW, F.col("eid_class").alias("src_class"), F.col("sid_class").alias("dst_class"), F.lit(True).alias("reverse"), "sid", "eid")
        return forward.unionByName(backward) if self.legacy else forward

    def _may(self, c: RelationConstraint) -> Column:
        """The stored bins under which the audit saw a bin of the constraint. Bin pairs are few, whatever the data: they come to the driver."""
        near = F.exists("distance_options", lambda d: d.between(c.d_min, c.d_max)) & F.arrays_overlap("theta_options", F.array(*[F.lit(b) for b in sorted(c.theta_bins)]))
        rows = self.bin_options().where(near).select("reverse", "s_theta", "s_dist").collect()
        key = F.struct("reverse", "s_theta", "s_dist")
        kinds = {f.name: f.dataType for f in self.bin_options().schema}
        literal = lambda r: F.struct(*[F.lit(r[n]).cast(kinds[n]).alias(n) for n in ("reverse", "s_theta", "s_dist")])
        return key.isin(*map(literal, rows)) if rows else F.lit(False)

    def candidates(self, spec: QuerySpec) -> dict[tuple[int, int], DataFrame]:
        failed, out = self.fallback_frames(), {}
        raw = typed_objects(self.detections.join(failed, FRAME, "left_semi"), spec.role_types)
        for (i, j), c in spec.relations.items():
            a, b = spec.role_types[i], spec.role_types[j]
            seen = self._table("seen").where((F.col("src_class") == a) & (F.col("dst_class") == b) & F.col("s_theta").isNotNull())
            found = seen.where(self._may(c) & constraint(c)).select(*FRAME, "src", "dst")
            plain = relation_of(raw, a, b, constraint(c), *self.size, *self.parts).select(*FRAME, "src", "dst")
            out[i, j] = found.unionByName(plain).distinct()
        return out

    def query(self, spec: QuerySpec, return_all: bool = False) -> DataFrame:
        if (spec.theta_parts, spec.distance_parts) != self.parts:
            raise ValueError(f"quantization of the query, {spec.theta_parts}/{spec.distance_parts} parts, isn't that of the index, {self.parts[0]}/{self.parts[1]}")
        return ranked_runs(self.bound(spec), spec, return_all)

    def bound(self, spec: QuerySpec) -> DataFrame:
        return bindings(self.candidates(spec), typed_objects(self.detections, spec.role_types), spec)

    def stats(self, spec: QuerySpec) -> DataFrame:
        bound = self.bound(spec)
        return run_stats(bound, ranked_runs(bound, spec, True))

    def metadata(self) -> DataFrame:
        """One row: counts, bytes of the audit, and the seconds that it took."""
        self.prepare()
        n = lambda df, name: df.agg(F.count("*").alias(name))
        frames = self.graph.select("video", "frame", "sid", "eid", "theta_bin", "dist_bin").join(self.sidecar, ["video", "frame", "sid", "eid", "theta_bin", "dist_bin"], "left_anti")
        windows = self.graph.select(*WINDOW).distinct().join(self.sidecar.select(*WINDOW).distinct(), WINDOW, "left_anti")
        doubled = self.detections.groupBy(*FRAME, "track_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_observation_rows"))
        out = n(self.stored, "stored_rows")
        for part in (n(self.fallback_frames(), "fallback_frames"), n(frames, "graph_sidecar_supplement_frames"), n(windows, "graph_only_windows"), doubled, n(self.type_directory(), "directory_entries")):
            out = out.crossJoin(part)  # rows of counts, one each
        return out.withColumns({"bytes": F.lit(size_of(self.detections.sparkSession, self.path)).cast("long"), "setup_seconds": F.lit(self.setup_seconds)})

    def release(self) -> None:
        """Delete the audit; the next use makes it anew."""
        if self._tables is not None:
            file_system(self.detections.sparkSession, self.path).delete(hadoop_path(self.detections.sparkSession, self.path), True)
            self._tables = None
