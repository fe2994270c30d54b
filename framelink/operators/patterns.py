"""Frequent sets of ids in each window: the prefix sets of frequency-ordered frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import WINDOW


def prefix_itemsets(transactions: DataFrame, keys: list[str] = WINDOW, min_support: int = 1) -> DataFrame:
    """transactions: keys, tid, items (array). Returns keys, items (ascending), n.

    Items of each transaction are put in order of frequency; every prefix of two or more is a set,
    counted in all transactions that hold it. A single item is listed if no listed set with it has
    its count. min_support bears on items, not on sets.
    """
    item = transactions.select(*keys, "tid", F.explode("items").alias("item"))
    freq = item.groupBy(*keys, "item").agg(F.count("*").alias("f")).where(F.col("f") >= min_support)
    ranked = item.distinct().join(freq, [*keys, "item"]).groupBy(*keys, "tid").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("f")).alias("r"), "item"))), lambda x: x["item"]).alias("path"))
    paths = ranked.groupBy(*keys, "path").agg(F.count("*").alias("times"))
    longer = paths.where(F.size("path") >= 2)
    sets = longer.select(*keys, F.explode(F.transform(F.sequence(F.lit(2), F.size("path")), lambda k: F.slice("path", F.lit(1), k))).alias("set")).distinct()
    # A set lies in a transaction only if its rarest item does: join on that and test the rest.
    holders = paths.select(*keys, F.explode("path").alias("last"), "path", "times")
    found = sets.withColumn("last", F.element_at("set", -1)).join(holders, [*keys, "last"]).where(F.size(F.array_except("set", "path")) == 0)
    many = found.groupBy(*keys, F.array_sort("set").alias("items")).agg(F.sum("times").alias("n"))
    covered = many.select(*keys, F.explode("items").alias("item"), F.col("n").alias("f")).distinct()
    single = freq.join(covered, [*keys, "item", "f"], "left_anti").select(*keys, F.array("item").alias("items"), F.col("f").alias("n"))
    return many.unionByName(single)


def window_core(frames: DataFrame) -> DataFrame:
    """video, window_id, track_id of ids that are in every frame of the window; frames: a row for each id, frame and window."""
    total = frames.groupBy(*WINDOW).agg(F.countDistinct("frame").alias("n_frames"))
    per = frames.groupBy(*WINDOW, "track_id").agg(F.countDistinct("frame").alias("n"))
    return per.join(total, WINDOW).where("n = n_frames").select(*WINDOW, "track_id")


def node_sets(frames: DataFrame) -> DataFrame:
    """video, window_id, name, n, is_start: the core alone, and with each set of the ids beside it.

    Windows with an empty frame have no core; the core's count is the number of the window's frames.
    """
    core = window_core(frames)
    rest = frames.select(*WINDOW, "frame", "track_id").distinct().join(core, [*WINDOW, "track_id"], "left_anti")
    sets = prefix_itemsets(rest.groupBy(*WINDOW, F.col("frame").alias("tid")).agg(F.collect_list("track_id").alias("items")))
    total = frames.groupBy(*WINDOW).agg(F.countDistinct("frame").alias("n"))
    start = total.join(core.groupBy(*WINDOW).agg(F.sort_array(F.collect_list("track_id")).alias("name")), WINDOW, "left").withColumn("name", F.coalesce("name", F.array().cast("array<long>")))
    beside = sets.join(start.select(*WINDOW, F.col("name").alias("core")), WINDOW).select(*WINDOW, F.array_sort(F.concat("items", "core")).alias("name"), "n", F.lit(False).alias("is_start"))
    return start.select(*WINDOW, "name", "n", F.lit(True).alias("is_start")).unionByName(beside)
