"""Threshold queries: lenient and strict matching of typed bindings in each window."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantize import under
from .windows import WINDOW, filter_multiset, filter_set


def product(types_of: DataFrame, types, distinct_ids: bool) -> DataFrame:
    """video, window_id, role_0, ...: all bindings of a window, joined by the window."""
    out = None
    for i, t in enumerate(types):
        role = types_of.where(F.col("class_id") == t).select(*WINDOW, F.col("track_id").alias(f"role_{i}"))
        out = role if out is None else out.join(role, WINDOW)
        if distinct_ids:
            for j in range(i):
                out = out.where(F.col(f"role_{j}") != F.col(f"role_{i}"))
    return out


def capped(bindings: DataFrame, n: int | None) -> DataFrame:
    """The first n bindings of each window in order of their ids."""
    if n is None:
        return bindings
    roles = [c for c in bindings.columns if c.startswith("role_")]
    return bindings.withColumn("rn", F.row_number().over(Window.partitionBy(*WINDOW).orderBy(*roles))).where(F.col("rn") <= n).drop("rn")


def _pairs(n: int, limits) -> Column:
    """Array of role pairs of a binding with the limits of each; limits: (theta, d) for all or {(i, j): (theta, d)}."""
    of = lambda i, j: limits[i, j] if isinstance(limits, dict) else limits
    return F.array(*[F.struct(F.lit(k).alias("pair"), F.col(f"role_{i}").alias("a"), F.col(f"role_{j}").alias("b"), *(F.lit(x).cast("double").alias(c) for x, c in zip(of(i, j), ("theta_lt", "d_lt"), strict=True))) for k, (i, j) in enumerate(combinations(range(n), 2))])


def _hits(bindings: DataFrame, index: DataFrame, n: int, limits, undirected: bool, extra: tuple[str, ...] = ()) -> DataFrame:
    """(binding, pair, frame) where a stored bin of the pair is under its limits."""
    asked = bindings.withColumn("p", F.explode(_pairs(n, limits))).select(*bindings.columns, "p.*")
    keys = [*WINDOW, *extra]
    stored = index.select(*keys, F.col("sid").alias("a"), F.col("eid").alias("b"), "theta_bin", "dist_bin", "frame")
    if undirected:  # an angle stored for the other direction is compared as it stands
        stored = stored.unionByName(stored.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "theta_bin", "dist_bin", "frame"))
    hit = asked.join(stored, [*keys, "a", "b"])
    limit = lambda c, v: F.col(v).isNull() | (F.col(c) < F.col(v))
    return hit.where(limit("theta_bin", "theta_lt") & limit("dist_bin", "d_lt")).select(*bindings.columns, "pair", "frame").distinct()


def lenient_match(types_of: DataFrame, index: DataFrame, types, theta_lt=None, d_lt=None, cap: int | None = None) -> DataFrame:
    """video, window_id, roles, frame: frames common to all pairs that have any; pairs without a match don't reject.

    Ids may repeat for repeated types, and a pair is looked up in role order only.
    """
    n = len(types)
    bindings = capped(product(filter_set(types_of, types), types, distinct_ids=False), cap)
    if n < 2:
        return bindings.withColumn("frame", F.lit(None).cast("long")).where("false")
    hits = _hits(bindings, index.where(under(F.col("theta_bin"), F.col("dist_bin"), theta_lt, d_lt)), n, (None, None), undirected=False)
    by_pair = hits.groupBy(*bindings.columns, "pair").agg(F.collect_set("frame").alias("frames"))
    sets = by_pair.groupBy(*bindings.columns).agg(F.collect_list("frames").alias("sets"))
    common = F.aggregate(F.slice("sets", 2, n * n), F.col("sets")[0], lambda acc, x: F.array_intersect(acc, x))
    return sets.select(*bindings.columns, F.explode(common).alias("frame"))


def strict_match(types_of: DataFrame, index: DataFrame, types, limits=(None, None), cap: int | None = None) -> DataFrame:
    """video, window_id, roles, frame: frames in which every pair of different ids is under its limits; limits as in _pairs."""
    n = len(types)
    bindings = capped(product(filter_multiset(types_of, types), types, distinct_ids=True), cap)
    return _every_pair(bindings, index, n, limits)


def _every_pair(bindings: DataFrame, index: DataFrame, n: int, limits, extra: tuple[str, ...] = ()) -> DataFrame:
    if n < 2:
        return bindings.withColumn("frame", F.lit(None).cast("long")).where("false")
    hits = _hits(bindings, index, n, limits, undirected=True, extra=extra)
    return hits.groupBy(*bindings.columns, "frame").agg(F.count("pair").alias("n")).where(F.col("n") == n * (n - 1) // 2).drop("n")


def strict_graph_match(types_of: DataFrame, vertices: DataFrame, closure: DataFrame, types, limits=(None, None)) -> DataFrame:
    """As strict_match, but a binding is looked for in its first vertex only, the smallest with all its ids, among the pairs of that vertex and those above it."""
    n = len(types)
    typed = filter_multiset(types_of, types)
    inside = vertices.select(*WINDOW, "v", F.size("name").alias("size"), F.explode("name").alias("track_id")).join(typed, [*WINDOW, "track_id"])
    out = None
    for i, t in enumerate(types):
        role = inside.where(F.col("class_id") == t).select(*WINDOW, "v", "size", F.col("track_id").alias(f"role_{i}"))
        out = role if out is None else out.join(role, [*WINDOW, "v", "size"])
        for j in range(i):
            out = out.where(F.col(f"role_{j}") != F.col(f"role_{i}"))
    roles = [f"role_{i}" for i in range(n)]
    first = out.groupBy(*WINDOW, *roles).agg(F.min(F.struct("size", "v"))["v"].alias("v"))
    return _every_pair(first, closure, n, limits, extra=("v",)).drop("v")


def _one_row(*parts: DataFrame) -> DataFrame:
    """Tables of one row each, side by side."""
    return reduce(DataFrame.crossJoin, parts)


def _asked(bindings: DataFrame, index: DataFrame, n: int, limits, undirected: bool) -> DataFrame:
    """Each binding and pair with `bins`, how many different bins are stored for it, and `ok`, whether one is under the limits."""
    asked = bindings.withColumn("p", F.explode(_pairs(n, limits))).select(*bindings.columns, "p.*")
    stored = index.select(*WINDOW, F.col("sid").alias("a"), F.col("eid").alias("b"), "theta_bin", "dist_bin")
    if undirected:
        stored = stored.unionByName(stored.select(*WINDOW, F.col("b").alias("a"), F.col("a").alias("b"), "theta_bin", "dist_bin"))
    bins = stored.groupBy(*WINDOW, "a", "b").agg(F.collect_set(F.struct("theta_bin", "dist_bin")).alias("set"))
    limit = lambda x, c, v: F.col(v).isNull() | (x[c] < F.col(v))
    some = F.exists("set", lambda x: limit(x, "theta_bin", "theta_lt") & limit(x, "dist_bin", "d_lt"))
    return asked.join(bins, [*WINDOW, "a", "b"], "left").select(*bindings.columns, "pair", F.when(F.col("set").isNull(), 0).otherwise(F.size("set")).alias("bins"), F.coalesce(some, F.lit(False)).alias("ok"))


def _window_counts(types_of: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    return types_of.agg(F.countDistinct(*WINDOW).alias("windows_total")), kept.agg(F.countDistinct(*WINDOW).alias("windows_kept"))


def lenient_stats(types_of: DataFrame, index: DataFrame, types, theta_lt=None, d_lt=None, cap: int | None = None) -> DataFrame:
    """One row: windows_total, windows_kept, combinations_total, combinations_matched, pair_lookups, bins_scanned of a lenient query, which looks up every pair."""
    n, kept = len(types), filter_set(types_of, types)
    bindings = capped(product(kept, types, distinct_ids=False), cap)
    matches = lenient_match(types_of, index, types, theta_lt, d_lt, cap)
    asked = _asked(bindings, index, n, (theta_lt, d_lt), undirected=False)
    counts = asked.agg(F.count("*").alias("pair_lookups"), F.coalesce(F.sum("bins"), F.lit(0)).alias("bins_scanned"))
    return _one_row(*_window_counts(types_of, kept), bindings.agg(F.count("*").alias("combinations_total")), matches.select(*bindings.columns).distinct().agg(F.count("*").alias("combinations_matched")), counts)


def strict_stats(types_of: DataFrame, index: DataFrame, types, limits=(None, None), cap: int | None = None) -> DataFrame:
    """One row: windows_total, windows_kept, bindings_total, bindings_matched, pair_lookups, bins_scanned of a strict query, which leaves a binding at its first pair without a match."""
    n, kept = len(types), filter_multiset(types_of, types)
    bindings = capped(product(kept, types, distinct_ids=True), cap)
    asked = _asked(bindings, index, n, limits, undirected=True)
    by = Window.partitionBy(*bindings.columns).orderBy("pair").rowsBetween(Window.unboundedPreceding, -1)
    reached = asked.withColumn("open", F.coalesce(F.min("ok").over(by), F.lit(True))).where("open")
    counts = reached.agg(F.count("*").alias("pair_lookups"), F.coalesce(F.sum("bins"), F.lit(0)).alias("bins_scanned"))
    matches = _every_pair(bindings, index, n, limits)
    return _one_row(*_window_counts(types_of, kept), bindings.agg(F.count("*").alias("bindings_total")), matches.select(*bindings.columns).distinct().agg(F.count("*").alias("bindings_matched")), counts)


def match_stats(types_of: DataFrame, kept: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: windows, windows that the type filter keeps, bindings with a frame, binding frames."""
    roles = [c for c in matches.columns if c.startswith("role_")]
    c = matches.agg(F.countDistinct("video", *roles).alias("bindings"), F.countDistinct("video", *roles, "frame").alias("binding_frames"))
    return _one_row(*_window_counts(types_of, kept), c)
