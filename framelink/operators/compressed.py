"""The compressed graph of a window: its node sets by inclusion, each pair kept at the highest set that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .windows import WINDOW


def cg_vertices(nodes: DataFrame) -> DataFrame:
    """video, window_id, v, name, n: numbered from 0, the core first, then by size and ids."""
    order = Window.partitionBy(*WINDOW).orderBy(F.desc("is_start"), F.size("name"), "name")
    return nodes.withColumn("v", (F.row_number().over(order) - 1).cast("int")).select(*WINDOW, "v", "name", "n")


def cg_ancestors(vertices: DataFrame) -> DataFrame:
    """video, window_id, parent, child: every proper subset of a vertex."""
    p, c = vertices.select(*WINDOW, F.col("v").alias("parent"), F.col("name").alias("p")), vertices.select(*WINDOW, F.col("v").alias("child"), F.col("name").alias("c"))
    return p.join(c, WINDOW).where((F.size("p") < F.size("c")) & (F.size(F.array_except("p", "c")) == 0)).select(*WINDOW, "parent", "child")


def cg_edges(vertices: DataFrame) -> DataFrame:
    """The subset steps with no vertex between."""
    up = cg_ancestors(vertices)
    via = up.select(*WINDOW, "parent", F.col("child").alias("mid")).join(up.select(*WINDOW, F.col("parent").alias("mid"), "child"), [*WINDOW, "mid"]).select(*WINDOW, "parent", "child").distinct()
    return up.join(via, [*WINDOW, "parent", "child"], "left_anti")


def cg_pairs(vertices: DataFrame, index: DataFrame) -> DataFrame:
    """video, window_id, v, sid, eid, theta_bin, dist_bin, frame: an edge index row at each vertex with both ids that no vertex above has."""
    ids = vertices.select(*WINDOW, "v", F.explode("name").alias("id"))
    keys = index.select(*WINDOW, "sid", "eid").distinct()
    inside = keys.join(ids.withColumnRenamed("id", "sid"), [*WINDOW, "sid"]).join(ids.withColumnRenamed("id", "eid"), [*WINDOW, "v", "eid"])
    above = inside.withColumnRenamed("v", "parent").join(cg_ancestors(vertices), [*WINDOW, "parent"]).select(*WINDOW, F.col("child").alias("v"), "sid", "eid").distinct()
    return inside.join(above, [*WINDOW, "v", "sid", "eid"], "left_anti").join(index, [*WINDOW, "sid", "eid"]).select(*WINDOW, "v", "sid", "eid", "theta_bin", "dist_bin", "frame")


def cg_closure(vertices: DataFrame, pairs: DataFrame, ancestors: DataFrame | None = None) -> DataFrame:
    """Pairs of each vertex with those of all vertices above it. ancestors: for graphs whose edges aren't inclusion."""
    up = (cg_ancestors(vertices) if ancestors is None else ancestors).unionByName(vertices.select(*WINDOW, F.col("v").alias("parent"), F.col("v").alias("child")))
    return pairs.withColumnRenamed("v", "parent").join(up, [*WINDOW, "parent"]).withColumnRenamed("child", "v").drop("parent").distinct()


def flatten_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs of all vertices of a window, each once."""
    return pairs.select(*WINDOW, "sid", "eid", "theta_bin", "dist_bin", "frame").distinct()


def ancestors_of(edges: DataFrame) -> DataFrame:
    """Transitive closure of given edges (video, window_id, parent, child). Each round doubles the steps and is written; it ends when one adds nothing."""
    out = stored(edges.select(*WINDOW, "parent", "child").distinct())
    size, before = out.count(), -1
    while size > before:
        two = out.withColumnRenamed("child", "mid").join(out.withColumnRenamed("parent", "mid"), [*WINDOW, "mid"]).select(*WINDOW, "parent", "child")
        out = stored(out.unionByName(two).distinct())
        size, before = out.count(), size
    return out
