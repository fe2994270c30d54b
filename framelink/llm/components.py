"""Connected components of an edge table by alternating large and small stars.

Each round is two aggregations and two joins on the vertex; hubs are never gathered, so a vertex
with a third of all edges costs a skewed join that Spark splits. Rounds are written to the shared
folder to cut lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges: u, v. Returns id, comp (the least id that it reaches) of every vertex with an edge to another."""

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before, k = state(now), 0
    while before[0]:
        k += 1
        two = both(now)
        large = two.join(least(two), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = least(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, now = f"{name}-{k - 1}", scratch.save(small, f"{name}-{k}")
        after = state(now)
        scratch.drop(old)
        if after == before:
            break
        before = after
    out = now.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return out.unionByName(out.select(F.col("comp").alias("id"), "comp").distinct())
