"""python -m framelink.cli COMMAND: build and repair indexes of tracker files, and query them.

build     tracks and key frames to an index folder      repair    type index anew, with every class that a track had
lenient, strict, pairs   threshold queries              batch     several of them, with a text report
directed  relations in one frame, for consecutive frames, over tracker files
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import match, windows
from .plans import batch, exact
from .plans.spec import QuerySpec, parse_pair_constraints, parse_relations, parse_types
from .sources import artifacts, tracks


def arguments(argv=None) -> argparse.Namespace:
    top = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("build", "repair", "lenient", "strict", "pairs", "batch", "directed"):
        p = commands.add_parser(name)
        if name in ("build", "repair", "directed"):
            p.add_argument("--tracks", required=True, help="headerless CSV files")
            p.add_argument("--class-id", type=int, help="class of all boxes, for files without a class column")
            p.add_argument("--width", type=float, default=1920)
            p.add_argument("--height", type=float, default=1080)
        if name in ("build", "repair"):
            p.add_argument("--keys", help="Parquet with video and start_frame; else key frames are found by --similarity")
            p.add_argument("--similarity", type=float, default=0.6)
        if name == "build":
            p.add_argument("--all-types", action="store_true", help="every class of a track in a window, not the last only")
        if name != "directed":
            p.add_argument("--index", required=True, help="folder of the index")
        if name in ("lenient", "strict", "pairs", "batch"):
            p.add_argument("--types", default="0,1", help="one class for each role; lists of a batch are parted by ;")
            p.add_argument("--theta-lt", type=float, default=1.0)
            p.add_argument("--d-lt", type=float, default=5.0)
            p.add_argument("--threshold", type=int, default=2)
            p.add_argument("--topk", type=int, default=5)
            p.add_argument("--cap", type=int, help="bindings of a window")
            p.add_argument("--stats", action="store_true", help="print what the query looked at")
        if name == "pairs":
            p.add_argument("--pairs", default="", help="limits of each pair: 0-1:1.0,5;0-2:0.5,2")
        if name == "batch":
            p.add_argument("--strict", action="store_true")
            p.add_argument("--report", help="folder of text lines, to which this batch is added")
        if name == "directed":
            p.add_argument("--types", default="0,1")
            p.add_argument("--relations", default="", help="distance bins from, to and angle bins of role pairs: 0-1:0,2:-5..5")
            p.add_argument("--frames", type=int, default=1, help="least length of a run")
            p.add_argument("--topk", type=int, default=10)
            p.add_argument("--stats", action="store_true")
    return top.parse_args(argv)


def detections(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return tracks.centers(tracks.read_tracks(spark, a.tracks, class_id=a.class_id))


def key_frames(spark: SparkSession, a: argparse.Namespace, d: DataFrame) -> DataFrame:
    return artifacts.key_frames(spark, a.keys) if a.keys else windows.segment(tracks.frame_ids(d), a.similarity)


def show(rows: DataFrame, began: float) -> None:
    found = rows.collect()
    for r in found:
        print(*(f"{k}={v}" for k, v in r.asDict().items()))
    print(f"{len(found)} rows in {time.perf_counter() - began:.2f} s")


def main(argv=None) -> None:
    a, began = arguments(argv), time.perf_counter()
    spark = SparkSession.builder.getOrCreate()
    if a.command in ("build", "repair"):
        d = detections(spark, a)
        keys = key_frames(spark, a, d)
        if a.command == "build":
            made = batch.build_indexes(d, keys, a.width, a.height, all_types=a.all_types)
        else:
            made = {"type_index": windows.type_index_all(windows.assign_windows(d, windows.windows_from_key_frames(keys)))}
        show(artifacts.manifest(spark, a.index, artifacts.write_index(made, a.index)), began)
    elif a.command == "directed":
        spec = QuerySpec("q", tuple(parse_types(a.types)), parse_relations(a.relations), a.frames, a.topk)
        d = detections(spark, a)
        show(exact.exact_query(d, spec, a.width, a.height).drop("query_id"), began)
        if a.stats:
            show(exact.DirectedIndex.build(d, a.width, a.height).stats(spec), began)
    else:
        index, types_of = (spark.read.parquet(f"{a.index}/{t}") for t in ("edge_index", "type_index"))
        lists = [parse_types(t) for t in a.types.split(";")]
        limits, strict = (a.theta_lt, a.d_lt), a.command in ("strict", "pairs") or getattr(a, "strict", False)
        if a.command == "pairs":
            limits = parse_pair_constraints(a.pairs, len(lists[0]))
        found = batch.batch(types_of, index, lists if a.command == "batch" else lists[:1], limits=limits, threshold=a.threshold, topk=a.topk, strict=strict, cap=a.cap)
        if getattr(a, "report", None):
            artifacts.append_report(found, a.report)
        show(found.drop("video").withColumn("frames", F.array_join(F.col("frames").cast("array<string>"), ",")), began)
        if a.stats:
            for types in lists:
                show(match.strict_stats(types_of, index, types, limits, a.cap) if strict else match.lenient_stats(types_of, index, types, *limits, a.cap), began)


if __name__ == "__main__":
    main()
