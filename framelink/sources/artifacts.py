"""Where indexes are kept, how they are written, and the text report of a batch."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import exists

# The stems of the artifacts.
KINDS = ("index", "cp_graphs", "node_index")


def discretization_tag(theta_parts: int, dist_parts: int) -> str:
    return f"theta{theta_parts}_d{dist_parts}"


def artifact_paths(video: str, s: float, output_tag: str = "", base_dir: str = "index") -> tuple[str, str, str, str]:
    """Type index, compressed graphs, edge index, build seconds."""
    stem = f"{base_dir}/{video}_{s}" + (f"_{output_tag}" if output_tag else "")
    return (*(f"{stem}_{k}" for k in KINDS), f"{stem}_time.txt")


def resolve_paths(spark: SparkSession, video: str, s: float | None = None, base_dir: str = "index") -> tuple[str, str | None, str]:
    """Of each artifact the first that exists of its name with s (if given) and without; a missing graph gives None, the others their first name."""
    stems = [video] if s is None else [f"{video}_{s}", video]
    names = {k: [f"{base_dir}/{stem}_{k}" for stem in stems] for k in KINDS}
    found = {k: next((p for p in paths if exists(spark, p)), None) for k, paths in names.items()}
    return found["index"] or names["index"][0], found["cp_graphs"], found["node_index"] or names["node_index"][0]


def write_index(tables: dict[str, DataFrame], base: str, partition_by: dict[str, list[str]] | None = None) -> dict[str, float]:
    """Each table as Parquet under base; returns the seconds of each, which a manifest keeps."""
    seconds = {}
    for name, df in tables.items():
        began = time.perf_counter()
        df.write.mode("overwrite").partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{base}/{name}")
        seconds[name] = time.perf_counter() - began
    return seconds


def manifest(spark: SparkSession, base: str, seconds: dict[str, float]) -> DataFrame:
    """name, rows, bytes, seconds of each written table."""
    out = None
    for name, s in seconds.items():
        df = spark.read.parquet(f"{base}/{name}")
        size = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("n")).distinct().agg(F.sum("n").alias("bytes"))
        row = df.agg(F.count("*").alias("rows")).crossJoin(size).select(F.lit(name).alias("name"), "rows", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.lit(s).alias("seconds"))
        out = row if out is None else out.unionByName(row)
    return out


def key_frames(spark: SparkSession, path_or_rows) -> DataFrame:
    """video, start_frame from Parquet or from rows; never from a pickle."""
    if isinstance(path_or_rows, str):
        return spark.read.parquet(path_or_rows).select("video", "start_frame")
    return spark.createDataFrame(path_or_rows, "video string, start_frame long")


def report_lines(results: DataFrame) -> DataFrame:
    """query_id, rank, value: one text line a binding in rank order, with its roles and its sorted frames."""
    roles = sorted(c for c in results.columns if c.startswith("role_"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_frames"), *roles))
    text = F.concat_ws(" ", "query_id", F.concat(F.lit("("), F.concat_ws(", ", *roles), F.lit(")")), F.lit("frames"), F.array_join(F.array_sort("frames").cast("array<string>"), ","))
    return results.select("query_id", rank.alias("rank"), text.alias("value"))


def append_report(results: DataFrame, path: str) -> None:
    """Lines are sorted over all part files, whose names keep their order."""
    report_lines(results).orderBy("query_id", "rank").select("value").write.mode("append").text(path)
