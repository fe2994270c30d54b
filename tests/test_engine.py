"""Fixtures of each operator, and seeded random inputs against a brute-force scan."""

import glob
import math
import random
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from framelink.functions import intervals
from framelink.functions import quantize as Q
from framelink.operators import compressed, match, patterns, ranking, relations, windows
from framelink.plans import batch, exact
from framelink.plans.prepared import PreparedEngine
from framelink.plans.spec import QuerySpec, RelationConstraint, parse_pair_constraints, parse_types
from framelink.sources import artifacts, tracks
from framelink.streaming.relations import FRAME_SCHEMA, stream_relations

DET = "video string, row_id long, frame long, track_id long, class_id int, cx double, cy double"
INDEX = "video string, window_id int, sid long, eid long, theta_bin double, dist_bin double, frame long"
TYPES = "video string, window_id int, track_id long, class_id int"
EVERY = RelationConstraint(0, 7, frozenset(range(-10, 11)))


def det(spark, rows):
    return spark.createDataFrame([("v", k, *r) for k, r in enumerate(rows)], DET)


def key_frames(spark, *starts):
    return spark.createDataFrame([("v", s) for s in starts], "video string, start_frame long")


def bins(a, b, size=100, parts=(10, 8)):
    dx, dy = b[0] - a[0], b[1] - a[1]
    return int(math.atan2(dy, dx) // (math.pi / parts[0])), int(math.hypot(dx, dy) / (2 * size) // (1 / parts[1]))


def brute(rows, spec, size=100):
    """Exact query over (frame, id, class, x, y) rows, frame by frame."""
    place, classes = {}, defaultdict(set)
    for f, i, c, x, y in rows:
        place[f, i] = (x, y)
        classes[f, c].add(i)
    frames = defaultdict(set)
    for f in {r[0] for r in rows}:
        for b in product(*(sorted(classes[f, t]) for t in spec.role_types)):
            if len(set(b)) == len(b):
                ok = True
                for (i, j), c in spec.relations.items():
                    t, d = bins(place[f, b[i]], place[f, b[j]], size)
                    ok = ok and t in c.theta_bins and c.d_min <= d <= c.d_max
                if ok:
                    frames[b].add(f)
    out = []
    for b, fs in frames.items():
        start = None
        for f in sorted(fs):
            start = f if f - 1 not in fs else start
            if f + 1 not in fs and f - start + 1 >= spec.min_consecutive_frames:
                out.append((*b, start, f))
    return sorted(out, key=lambda r: (r[-2] - r[-1], r[-2], r[:-2]))


def answers(df):
    return [tuple(r)[2:-1] for r in df.collect()]


C5 = [(f, i, c, x, y) for f in (1, 2, 3, 5, 6) for i, c, x, y in ((10, 0, 10.0, 50.0), (20, 1, 60.0, 50.0), (30, 2, 60.0, 80.0))]


def crowd(seed, tracks, last):
    """Tracks that walk, leave and come back, now and then under another class or twice in a frame."""
    rng, out = random.Random(seed), []
    for t in range(tracks):
        x, y, here = rng.uniform(0, 99), rng.uniform(0, 99), True
        for f in range(1, last + 1):
            here = here if rng.random() < 0.75 else not here
            x, y = (min(99.0, max(0.0, v + rng.gauss(0, 12))) for v in (x, y))
            if here:
                out += [(f, t + 1, (t + (rng.random() < 0.1)) % 4, round(x, 1), round(y, 1)) for _ in range(1 + (rng.random() < 0.08))]
    rng.shuffle(out)
    return out


# --- functions


@pytest.mark.parametrize(("a", "b", "want"), [((10, 50), (60, 50), (0, 2)), ((60, 50), (10, 50), (10, 2)), ((60, 50), (60, 80), (5, 1)), ((60, 80), (60, 50), (-5, 1)), ((5, 5), (5, 5), (0, 0))])
def test_pinned_bins(spark, a, b, want):
    xy = [F.lit(float(v)) for v in (*a, *b)]
    r = spark.range(1).select(Q.theta_bin(Q.theta(*xy)), Q.dist_bin(Q.distance(*xy) / 200)).first()
    assert tuple(r) == want == bins(a, b)


@pytest.mark.parametrize("parts", [7, 8, 9, 10, 12, 18, 36])
def test_floor_division_on_exact_multiples(spark, parts):
    y = math.pi / parts
    xs = [k * y for k in range(-parts, parts + 1)] + [math.nextafter(k * y, s) for k in range(-parts, parts + 1) for s in (-9, 9)]
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k long, x double").orderBy("k").select(Q.floor_div(F.col("x"), y)).collect()]
    assert got == [int(x // y) for x in xs]


def test_angles_beside_diagonals(spark):
    """Points of a decimal grid lie a rounding error off the diagonals, which are bin edges at 12 parts."""
    xs = [v / 100 * 10 for v in range(19001)]
    rows = {(sx * x, sy * 10.0 * j) for j in range(1, 100) for x in {b - a for a, b in zip(xs, xs[100 * j :])} for sx in (1, -1) for sy in (1, -1)} | {(0.0, 0.0), (0.0, 3.0), (-3.0, 0.0), (-1e9, 1.0), (50.0, 50.04), (50.0, 50.06)}
    z = F.lit(0.0)
    angle = Q.theta(z, z, F.col("x"), F.col("y"))
    got = spark.createDataFrame(sorted(rows), "x double, y double").select("x", "y", angle.alias("t"), Q.theta_bin(angle, 12).alias("b")).collect()
    want = {(x, y): math.atan2(y, x) for x, y in rows}
    assert [(r.x, r.y) for r in got if r.b != want[r.x, r.y] // (math.pi / 12) or abs(r.t - want[r.x, r.y]) > math.ulp(r.t)] == []


def test_reverse_and_rescale(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(Q.reversed_bin(F.lit(b))) for b in (0, 3, -3, 10)] == [-10, -7, 7, 0]
    assert one(Q.reverse_matches(F.lit(0), [10])) and not one(Q.reverse_matches(F.lit(1), [10])) and one(Q.reverse_matches(F.lit(0), [-10]))
    assert one(Q.rescaled_overlap(F.lit(2), 1, 1, 200, 400)) and not one(Q.rescaled_overlap(F.lit(2), 3, 3, 200, 400))


def test_runs(spark):
    d = spark.createDataFrame([("a", f) for f in (1, 2, 3, 3, 5, 6)], "k string, frame long")
    runs = intervals.to_runs(d, ["k"])
    assert sorted(map(tuple, runs.collect())) == [("a", 1, 3), ("a", 5, 6)]
    assert sorted(r.frame for r in intervals.from_runs(runs).collect()) == [1, 2, 3, 5, 6]
    assert [r[0] for r in spark.createDataFrame([([3, 1, 2],), ([1, 3],)], "f array<long>").select(intervals.is_consecutive(F.col("f"))).collect()] == [True, False]


# --- sources


def test_readers(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1,7,10,20,4,6,0.9,2,-1,-1,-1\n0,7,10,20,4,6,0.9,2,-1,-1,-1\n3,8,0,0,2,2,1,1,0,0,0\n")
    (tmp_path / "s.txt").write_text("1,7,10,20,4,6,0.9,-1,-1,-1\n")
    c = tracks.centers(tracks.read_tracks(spark, str(tmp_path / "m.txt")))
    assert sorted((r.video, r.frame, r.track_id, r.class_id, r.cx, r.cy) for r in c.collect()) == [("m", 1, 7, 2, 12.0, 23.0), ("m", 3, 8, 1, 1.0, 1.0)]
    assert [r.ids for r in tracks.frame_ids(c).orderBy("frame").collect()] == [[7], [], [8]]
    assert tracks.read_tracks(spark, str(tmp_path / "s.txt"), "x", 5).first().class_id == 5
    (tmp_path / "n.txt").write_text("1,,10,20,4,6,0.9,-1,-1,-1\n")
    with pytest.raises(Exception, match="null in id"):
        tracks.read_tracks(spark, str(tmp_path / "n.txt"), "x", 5).collect()


def test_artifacts(spark, tmp_path):
    assert artifacts.discretization_tag(10, 8) == "theta10_d8"
    assert artifacts.artifact_paths("v", 0.7, "t", "b") == ("b/v_0.7_t_index", "b/v_0.7_t_cp_graphs", "b/v_0.7_t_node_index", "b/v_0.7_t_time.txt")
    (tmp_path / "v_index").mkdir()
    (tmp_path / "v_0.7_node_index").mkdir()
    base = str(tmp_path)
    assert artifacts.resolve_paths(spark, "v", 0.7, base) == (f"{base}/v_index", None, f"{base}/v_0.7_node_index")
    assert artifacts.resolve_paths(spark, "v", None, base) == (f"{base}/v_index", None, f"{base}/v_node_index")
    assert artifacts.resolve_paths(spark, "w", 0.5, base) == (f"{base}/w_0.5_index", None, f"{base}/w_0.5_node_index")
    seconds = artifacts.write_index({"a": spark.range(5).withColumn("p", F.lit(1))}, f"{base}/w", {"a": ["p"]})
    m = artifacts.manifest(spark, f"{base}/w", seconds).first()
    assert (m.name, m.rows) == ("a", 5) and m.bytes > 0
    r = spark.createDataFrame([("q", k, 2, list(range(k, 0, -1)), k) for k in range(1, 40)], "query_id string, role_0 long, role_1 long, frames array<long>, n_frames long").repartition(5)
    artifacts.append_report(r, f"{base}/report")
    written = sorted(glob.glob(f"{base}/report/part-*"))
    lines = [x for p in written for x in open(p).read().splitlines()]
    assert lines == [f"q ({k}, 2) frames {','.join(map(str, range(1, k + 1)))}" for k in range(39, 0, -1)]
    artifacts.append_report(r, f"{base}/report")
    assert spark.read.text(f"{base}/report").count() == 78
    assert artifacts.key_frames(spark, [("v", 1)]).count() == 1


# --- edges and windows


def test_edge_modes(spark):
    d = det(spark, [(1, 1, 0, 5.0, 5.0), (1, 2, 0, 5.0, 5.0), (1, 3, 1, 0.0, 9.0), (1, 1, 0, 7.0, 1.0), (2, 4, 0, 1.0, 1.0)])
    pairs = lambda m: sorted((r.sid, r.eid) for r in relations.edges(d, 100, 100, m).collect())
    assert pairs("normal") == [(2, 1), (3, 1), (3, 2)]
    assert pairs("complete") == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]
    assert pairs("pattern") == [(3, 1), (3, 2)]
    with pytest.raises(ValueError, match="mode"):
        relations.edges(d, 100, 100, "other")
    tie = det(spark, [(1, 9, 0, 5.0, 5.0), (1, 2, 0, 5.0, 5.0)])
    assert [(r.sid, r.eid) for r in relations.edges(tie, 100, 100).collect()] == [(9, 2)]
    assert relations.raw_row_relations(d, 100, 100).where("src = 1 AND dst = 2").count() == 2


def test_postings_and_allowed_pairs(spark):
    p = relations.postings(relations.relations(det(spark, C5), 100, 100))
    got = defaultdict(list)
    for r in p.collect():
        got[r.src_class, r.dst_class, r.theta_bin, r.dist_bin, r.src, r.dst].append((r.start_frame, r.end_frame))
    assert sorted(got[0, 1, 0, 2, 10, 20]) == sorted(got[1, 0, 10, 2, 20, 10]) == [(1, 3), (5, 6)]
    only = relations.relations(det(spark, C5), 100, 100, allowed_type_pairs={(0, 1), (1, 0)}).select("src_class", "dst_class").distinct()
    assert {tuple(r) for r in only.collect()} == {(0, 1), (1, 0)}


def test_windows(spark):
    w = windows.windows_from_key_frames(key_frames(spark, 1, 4, 7))
    d = det(spark, [(f, 1, f % 2, 0.0, 0.0) for f in range(1, 9)])
    got = defaultdict(list)
    for r in windows.assign_windows(d, w).orderBy("frame").collect():
        got[r.window_id].append(r.frame)
    assert got == {1: [1, 2, 3], 2: [4, 5, 6], 3: [7, 8]}
    late = windows.windows_from_key_frames(key_frames(spark, 3))
    assert windows.assign_windows(d, late).agg(F.min("frame")).first()[0] == 3
    with pytest.raises(Exception, match="key frames"):
        windows.windows_from_key_frames(key_frames(spark, 0)).collect()
    inside = windows.assign_windows(d, w)
    assert {(r.window_id, r.class_id) for r in windows.type_index_last(inside).collect()} == {(1, 1), (2, 0), (3, 0)}
    assert windows.type_index_all(inside).count() == 6
    ids = spark.createDataFrame([("v", 1, [1, 2]), ("v", 2, [1, 2, 3]), ("v", 3, [4]), ("v", 4, [])], "video string, frame long, ids array<long>")
    assert [r.start_frame for r in windows.segment(ids, 0.6).orderBy("start_frame").collect()] == [1, 3, 4]


def test_window_filters(spark):
    t = spark.createDataFrame([("v", 1, 1, 0), ("v", 1, 2, 0), ("v", 1, 3, 1), ("v", 2, 4, 0), ("v", 2, 5, 1)], TYPES)
    of = lambda df: sorted({r.window_id for r in df.collect()})
    assert of(windows.filter_set(t, [0, 1, 0])) == [1, 2] and of(windows.filter_multiset(t, [0, 1, 0])) == [1]
    assert of(windows.filter_set(t, [0, 5])) == []


# --- threshold queries


def graph(spark, pairs, frames=(10, 11)):
    types = spark.createDataFrame([("v", 1, i, i - 1) for i in (1, 2, 3)], TYPES)
    index = spark.createDataFrame([("v", 1, *p, *b, f) for p, b in pairs.items() for f in frames], INDEX)
    vertices = spark.createDataFrame([("v", 1, 0, [1, 2]), ("v", 1, 1, [1, 2, 3])], "video string, window_id int, v int, name array<long>")
    return types, index, vertices


def found(df):
    out = defaultdict(set)
    for r in df.collect():
        out[tuple(r[c] for c in ranking.roles_of(df))].add(r.frame)
    return dict(out)


def test_strict_over_graph(spark):
    types, index, v = graph(spark, {(1, 2): (0.2, 0.3), (1, 3): (0.2, 0.3), (2, 3): (0.2, 0.3)})
    held = index.withColumn("v", F.when((F.col("sid") == 1) & (F.col("eid") == 2), 0).otherwise(1))
    closure = compressed.cg_closure(v, held)
    assert found(match.strict_graph_match(types, v, closure, [0, 1, 2], (1.0, 1.0))) == {(1, 2, 3): {10, 11}}
    edges = spark.createDataFrame([("v", 1, 0, 1), ("v", 1, 1, 2), ("v", 1, 2, 3)], "video string, window_id int, parent int, child int")
    assert compressed.ancestors_of(edges).count() == 6
    chain = spark.createDataFrame([("v", 1, k, k + 1) for k in range(100)], "video string, window_id int, parent int, child int")
    assert compressed.ancestors_of(chain).count() == 100 * 101 // 2  # no path is too long
    assert compressed.ancestors_of(edges.limit(0)).count() == 0
    lone = v.where("v = 0")
    assert found(match.strict_graph_match(types, lone, compressed.cg_closure(lone, held.where("false")), [0, 1], (1.0, 1.0))) == {}


def test_pair_limits(spark):
    types, index, _ = graph(spark, {(1, 2): (0.2, 0.3), (1, 3): (0.4, 1.5), (2, 3): (1.5, 6.0)})
    limits = {(0, 1): (1.0, 1.0), (0, 2): (0.5, 2.0), (1, 2): (2.0, 8.0)}
    assert found(match.strict_match(types, index, [0, 1, 2], limits)) == {(1, 2, 3): {10, 11}}
    assert found(match.strict_match(types, index, [0, 1, 2], limits | {(0, 2): (0.3, 2.0)})) == {}


def test_lenient_and_strict_differ(spark):
    types, index, _ = graph(spark, {(1, 2): (0.2, 0.3), (3, 1): (0.2, 0.3)})
    assert found(match.lenient_match(types, index, [0, 1, 2], 1, 1)) == {(1, 2, 3): {10, 11}}
    assert found(match.strict_match(types, index, [0, 1, 2], (1, 1))) == {}
    assert found(match.strict_match(types, index, [0, 2], (1, 1))) == {(1, 3): {10, 11}}
    assert found(match.lenient_match(types, index, [0, 2], 1, 1)) == {} == found(match.lenient_match(types, index, [0], 1, 1))
    assert match.capped(match.product(types, [0, 1], False), 1).count() == 1


def test_ranking_and_batch(spark):
    types, index, _ = graph(spark, {(1, 2): (0.2, 0.3), (1, 3): (0.2, 0.3)}, frames=(1, 2, 3))
    out = batch.batch(types, index, [[0, 1], [0, 2]], limits=(1, 1), threshold=2, topk=5)
    assert sorted((r.query_id, r.role_0, r.role_1, r.n_frames) for r in out.collect()) == [("q0", 1, 2, 3), ("q1", 1, 3, 3)]
    assert batch.threshold_query(types, index, [0, 1], (1, 1), threshold=3).count() == 0


@pytest.mark.parametrize("text", ["", "0-1", "0-1:1", "0-0:1,1", "0-5:1,1", "0-1:1,1;1-0:1,1", "0-1:1.0,5;0-2:0.5,2", "a-1:1,1", "0-1:x,1"])
def test_bad_pair_constraints(text):
    with pytest.raises(ValueError):
        parse_pair_constraints(text, 3)


def test_pair_constraints():
    assert parse_pair_constraints("0-1:1.0,5;2-0:0.5,2;1-2:2.0,8", 3) == {(0, 1): (1.0, 5.0), (0, 2): (0.5, 2.0), (1, 2): (2.0, 8.0)}
    assert parse_pair_constraints("", 1) == {} and parse_types("0, 1,,2") == [0, 1, 2]


# --- directed queries


def cases():
    two = {(0, 1): RelationConstraint(2, 2, frozenset({0})), (1, 0): RelationConstraint(2, 2, frozenset({10}))}
    yield "two", C5, QuerySpec("q", (0, 1), two, 3)
    yield "three", C5, QuerySpec("q", (0, 1, 2), two | {(1, 2): RelationConstraint(1, 1, frozenset({5})), (2, 1): RelationConstraint(1, 1, frozenset({-5}))}, 3)
    yield "single", C5, QuerySpec("q", (0,), {}, 2)
    change = [(f, i, c, x, 20.0) for f in range(1, 6) for i, c, x in ((10, 0 if f != 3 else 2, 10.0), (20, 1, 60.0))]
    yield "class change", change, QuerySpec("q", (0, 1), {(0, 1): EVERY}, 2)
    same = [(f, i, 0, x, 20.0) for f in (1, 2, 3) for i, x in ((10, 10.0), (20, 40.0), (30, 70.0))]
    yield "repeated type", same, QuerySpec("q", (0, 0), {(0, 1): EVERY})
    double = [(1, -1, 0, 10.0, 20.0), (1, -1, 2, 30.0, 20.0), (1, 20, 1, 60.0, 20.0)]
    yield "both classes, last point", double, QuerySpec("q", (0, 1), {(0, 1): RelationConstraint(1, 1, frozenset({0}))})
    yield "both classes, last point 2", double, QuerySpec("q", (2, 1), {(0, 1): RelationConstraint(1, 1, frozenset({0}))})
    wide = RelationConstraint(0, 3, frozenset({*range(-9, 3), 6, 10}))
    for seed, types in ((401, (1, 2)), (402, (0, 1, 3)), (403, (2, 2, 0)), (404, (3, 0, 1, 2))):
        yield f"crowd {types}", crowd(seed, 7, 6), QuerySpec("q", types, {(i, i - 1): wide for i in range(1, len(types))}, topk=500)
    yield "crowd without a relation for one role", crowd(405, 6, 5), QuerySpec("q", (3, 1, 0), {(2, 0): wide}, topk=500)


@pytest.mark.parametrize(("rows", "spec"), [c[1:] for c in cases()], ids=[c[0] for c in cases()])
def test_exact_index_and_engine(spark, rows, spec):
    d, want = det(spark, rows), brute(rows, spec)
    assert want
    assert answers(exact.exact_query(d, spec, 100, 100)) == want[: spec.topk]
    order = lambda df: sorted(answers(df), key=lambda r: (r[-2] - r[-1], r[-2], r[:-2]))
    assert order(exact.DirectedIndex.build(d, 100, 100).query(spec, True)) == want
    assert order(engine(spark, d).query(spec, True)) == want


def engine(spark, d, missing="false", graph=None, sidecar=True, legacy=True, size=100, **more):
    step = 3
    e = relations.quantized(relations.edges(d, size, size, "normal")).withColumn("window_id", F.expr(f"cast((frame - 1) div {step} + 1 AS int)"))
    stored = e.select("video", "window_id", "sid", "eid", "theta_bin", "dist_bin", "frame").where(f"NOT ({missing})")
    return PreparedEngine(d, 100, 100, stored if sidecar else None, stored if graph is None and not sidecar else graph, legacy_single_direction=legacy, indexed_width=size, indexed_height=size, **more)


TRACK = [(f, i, c, x, 20.0) for f in (1, 2, 3) for i, c, x in ((10, 0, 10.0), (20, 1, 60.0))]


def fallback(e):
    return sorted(r.frame for r in e.fallback_frames().collect())


def test_engine_audit(spark):
    d, spec = det(spark, TRACK), QuerySpec("q", (0, 1), {(0, 1): EVERY}, 3)
    whole, lacking, from_graph = engine(spark, d), engine(spark, d, "frame = 2"), engine(spark, d, sidecar=False)
    assert fallback(whole) == [] and fallback(lacking) == [2]
    for e in (whole, lacking, from_graph):
        assert answers(e.query(spec)) == [(10, 20, 1, 3)]
    assert from_graph.metadata().first().graph_only_windows == 1
    wrong = spark.createDataFrame([("v", 1, 10, 20, 7, 9, 1)], "video string, window_id int, sid long, eid long, theta_bin int, dist_bin int, frame long")
    assert fallback(PreparedEngine(d.where("frame = 1"), 100, 100, wrong)) == [1]
    more = PreparedEngine(d.where("frame < 3"), 100, 100, whole.sidecar.where("frame = 1"), whole.sidecar.where("frame < 3"), legacy_single_direction=True)
    m = more.metadata().first()
    assert (m.graph_sidecar_supplement_frames, m.fallback_frames, m.directory_entries) == (1, 0, 2) and m.setup_seconds > 0
    whole.release()


def test_engine_forward_only(spark):
    """A store with one direction, not said to be legacy, is scanned raw for the other."""
    d = det(spark, TRACK)
    e = engine(spark, d, legacy=False)
    assert answers(e.query(QuerySpec("q", (1, 0), {(0, 1): RelationConstraint(2, 2, frozenset({10}))}, 3))) == [(20, 10, 1, 3)]


def test_engine_reverse_boundaries(spark):
    for k, angle in enumerate((math.pi / 10, -math.pi / 10, math.pi / 2, -math.pi / 2, math.pi - 1e-12)):
        rows = [(1, 10, 0, 50.0, 50.0), (1, 20, 1, 50.0 + 20 * math.cos(angle), 50.0 + 20 * math.sin(angle))]
        t, dist = bins(rows[1][3:], rows[0][3:])
        spec = QuerySpec(f"q{k}", (1, 0), {(0, 1): RelationConstraint(dist, dist, frozenset({t}))})
        assert answers(engine(spark, det(spark, rows)).query(spec)) == brute(rows, spec)


def test_engine_audit_of_equal_points(spark):
    """Two objects in one place are stored as angle 0, distance 0, which is right from both ends; a near pair stored so is not."""
    d = det(spark, [(f, i, c, x, 20.0) for f in (1, 2) for i, c, x in ((10, 0, 20.0), (20, 1, 20.0), (30, 2, 70.0))])
    for e in (engine(spark, d), engine(spark, d, size=200)):
        assert fallback(e) == []
        assert answers(e.query(QuerySpec("q", (1, 0), {(0, 1): RelationConstraint(0, 0, frozenset({0}))}))) == [(20, 10, 1, 2)]
    near = det(spark, [(1, 10, 0, 20.0, 20.0), (1, 20, 1, 19.0, 19.9)])
    assert bins((20.0, 20.0), (19.0, 19.9)) == (-10, 0)
    wrong = spark.createDataFrame([("v", 1, 10, 20, 0, 0, 1)], "video string, window_id int, sid long, eid long, theta_bin int, dist_bin int, frame long")
    assert fallback(PreparedEngine(near, 100, 100, wrong, legacy_single_direction=True)) == [1]


def test_metadata_of_equal_points(spark):
    """Two objects in one place cost no fallback frame, wherever their pair is stored; a frame that isn't stored does."""
    d = det(spark, [(f, i, c, 20.0, 20.0) for f in (1, 2, 3) for i, c in ((10, 0), (20, 1))])
    whole = engine(spark, d, "frame = 3").stored
    m = PreparedEngine(d, 100, 100, whole.where("frame = 1"), whole, legacy_single_direction=True).metadata().first()
    assert (m.stored_rows, m.fallback_frames, m.graph_sidecar_supplement_frames, m.directory_entries) == (2, 1, 1, 2)


def test_metadata_of_repeated_row_ids(spark):
    """Where rows of a track share frame and row_id, index and audit take the same point, in whatever order they meet the rows."""
    rows = [("v", 0, 1, 10, 0, 20.0, 20.0), ("v", 1, 1, 20, 1, 70.0, 20.0), ("v", 1, 1, 20, 1, 20.0, 90.0), ("v", 2, 2, 10, 0, 20.0, 20.0), ("v", 3, 2, 20, 1, 70.0, 20.0)]
    up, down = (spark.createDataFrame(r, DET).coalesce(1) for r in (rows, rows[::-1]))
    want = [(1, 10, 20.0, 20.0), (1, 20, 70.0, 20.0), (2, 10, 20.0, 20.0), (2, 20, 70.0, 20.0)]
    for d in (up, down):
        assert sorted(tuple(r) for r in relations.positions(d).select("frame", "track_id", "cx", "cy").collect()) == want
    for d, of in product((up, down), repeat=2):
        m = PreparedEngine(d, 100, 100, engine(spark, of).stored, legacy_single_direction=True).metadata().first()
        assert (m.stored_rows, m.fallback_frames, m.duplicate_observation_rows, m.directory_entries) == (2, 0, 1, 2)


def test_engine_rescaled_and_options(spark):
    d = det(spark, TRACK)
    e = engine(spark, d, size=200)
    spec = QuerySpec("q", (0, 1), {(0, 1): RelationConstraint(2, 2, frozenset({0}))}, 3)
    assert fallback(e) == [] and answers(e.query(spec)) == [(10, 20, 1, 3)]
    assert {(r.s_dist, tuple(r.distance_options)) for r in e.bin_options().collect()} == {(1, (2,))}
    one = det(spark, [(1, 10, 0, 10.0, 20.0), (1, 20, 1, 60.0, 20.0), (1, 21, 1, 85.0, 20.0)])
    assert engine(spark, one).bound(spec).count() == 1


def test_quantization_must_agree(spark):
    d = det(spark, TRACK)
    for spec in (QuerySpec("q", (0, 1), {(0, 1): EVERY}, theta_parts=12), QuerySpec("q", (0, 1), {(0, 1): EVERY}, theta_parts=8, distance_parts=8)):
        for e in (exact.DirectedIndex.build(d, 100, 100), engine(spark, d)):
            with pytest.raises(ValueError, match="quantization"):
                e.query(spec)


def test_index_is_pruned_by_class_pair(spark, tmp_path):
    index = exact.DirectedIndex.build(det(spark, C5), 100, 100)
    index.write(str(tmp_path / "i"))
    again = index.from_path(str(tmp_path / "i"))
    spec = next(cases())[2]
    assert answers(again.query(spec)) == answers(index.query(spec))
    plan = again.lookup(0, 1, EVERY)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(src_class" in plan


# --- patterns


def test_prefix_itemsets(spark):
    rows = [[1, 2], [2, 3], [1, 2, 3], [1, 2, 3, 4], [1, 2, 3, 4, 5]]
    t = spark.createDataFrame([("v", 1, k, r) for k, r in enumerate(rows)], "video string, window_id int, tid long, items array<long>")
    got = {tuple(r.items_): r.n for r in patterns.prefix_itemsets(t).withColumnRenamed("items", "items_").collect()}
    assert got == {(2,): 5, (1, 2): 4, (2, 3): 4, (1, 2, 3): 3, (1, 2, 3, 4): 2, (1, 2, 3, 4, 5): 1}


def test_graph_build_keeps_every_inner_pair(spark):
    rows = crowd(406, 6, 8)
    ix = batch.build_indexes(det(spark, rows), key_frames(spark, 1, 5), 100, 100)
    v, pairs = ix["cg_vertices"].persist(), ix["cg_pairs"].persist()
    starts = v.where("v = 0")
    assert starts.count() == 2
    inside = compressed.cg_closure(v, pairs).select("window_id", "sid", "eid", "theta_bin", "dist_bin", "frame").distinct()
    held = ix["edge_index"].select("window_id", "sid", "eid", "theta_bin", "dist_bin", "frame")
    names = defaultdict(list)
    for r in v.collect():
        names[r.window_id].append(set(r.name))
    want = {tuple(r) for r in held.collect() if any({r.sid, r.eid} <= s for s in names[r.window_id])}
    assert {tuple(r) for r in inside.collect()} == want
    once = pairs.groupBy("window_id", "v", "sid", "eid", "theta_bin", "dist_bin", "frame").count().where("count > 1").count()
    assert once == 0
    up = {(r.window_id, r.parent, r.child) for r in ix["cg_edges"].collect()}
    by = {(r.window_id, r.v): set(r.name) for r in v.collect()}
    for w, p, c in up:
        assert by[w, p] < by[w, c] and not any(by[w, p] < s < by[w, c] for (x, _), s in by.items() if x == w)


# --- streams


def test_stream_equals_batch(spark, tmp_path):
    rows = crowd(407, 5, 6)
    d = det(spark, rows)
    frames = relations.typed_objects(d).groupBy("video", "frame").agg(F.collect_list(F.struct("track_id", "class_id", "cx", "cy")).alias("objects"))
    frames.write.parquet(str(tmp_path / "in"))
    q = stream_relations(spark.readStream.schema(FRAME_SCHEMA).parquet(str(tmp_path / "in")), 100, 100).writeStream.format("memory").queryName("rel").trigger(availableNow=True).start()
    q.awaitTermination(60)
    cols = ["frame", "src", "dst", "src_class", "dst_class", "theta_bin", "dist_bin"]
    assert sorted(map(tuple, spark.table("rel").select(cols).collect())) == sorted(map(tuple, relations.relations(d, 100, 100).select(cols).collect()))


def test_frames_of_a_stream(spark, tmp_path):
    """A frame whose rows lie on both sides of a minute is one frame; the last row gives a track's point and every class counts."""
    from pyspark.sql import types as T

    from framelink.streaming.relations import frames_of

    at = lambda s: f"2024-01-01 00:{int(s) // 60:02d}:{s % 60:06.3f}"
    rows = [
        [("v", 1, 5, 10, 0, 10.0, 50.0, at(59.9)), ("v", 3, 6, 10, 0, 10.0, 50.0, at(61.0))],
        [("v", 2, 5, 20, 1, 60.0, 50.0, at(60.1)), ("v", 5, 6, 20, 1, 90.0, 50.0, at(61.2)), ("v", 4, 6, 20, 2, 1.0, 1.0, at(61.1))],
        [("v", 9, 99, 1, 0, 0.0, 0.0, at(900.0))],
        [("v", 11, 100, 1, 0, 0.0, 0.0, at(1800.0))],
        [("v", 12, 5, 30, 1, 0.0, 0.0, at(59.0)), ("v", 13, 101, 1, 0, 0.0, 0.0, at(1900.0))],
    ]
    schema = T._parse_datatype_string("video string, row_id long, frame long, track_id long, class_id int, cx double, cy double, at string")
    for k, r in enumerate(rows):
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"n={k}"))
    stream = spark.readStream.schema(T.StructType([*schema.fields, T.StructField("n", T.IntegerType())])).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("at", F.to_timestamp("at")).drop("n")
    q = stream_relations(frames_of(stream, "at", "10 seconds"), 100, 100).writeStream.format("memory").queryName("framed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("framed").where("frame < 50").select("frame", "src", "dst", "src_class", "dst_class", "theta_bin", "dist_bin").collect())
    assert [r for r in got if r[0] == 5] == [(5, 10, 20, 0, 1, 0, 2), (5, 20, 10, 1, 0, 10, 2)]
    assert {r[1:5] for r in got if r[0] == 6} == {(10, 20, 0, 1), (10, 20, 0, 2), (20, 10, 1, 0), (20, 10, 2, 0)} and {r[6] for r in got if r[0] == 6} == {3}


# --- statistics, command line


def test_stats(spark):
    types, index, _ = graph(spark, {(1, 2): (0.2, 0.3), (1, 3): (9.0, 0.3), (2, 3): (0.2, 0.3)})
    more = index.unionByName(index.where("sid = 1 AND eid = 2").withColumn("theta_bin", F.lit(5.0)))
    assert tuple(match.lenient_stats(types, more, [0, 1, 2], 1, 1).first()) == (1, 1, 1, 1, 3, 4)
    assert tuple(match.strict_stats(types, more, [0, 1, 2], (1, 1)).first()) == (1, 1, 1, 0, 2, 3)
    assert tuple(match.strict_stats(types, more, [0, 1, 2], (10, 1)).first()) == (1, 1, 1, 1, 3, 4)
    d, spec = det(spark, C5), next(cases())[2]
    assert tuple(exact.DirectedIndex.build(d, 100, 100).stats(spec).first()) == (1, 5, 1)
    only = spark.createDataFrame([("v", 10, 20)], "video string, role_0 long, role_1 long")
    few = spark.createDataFrame([("v", 1), ("v", 2), ("v", 3)], "video string, frame long")
    assert answers(exact.exact_query(d, spec, 100, 100, candidate_bindings=only, candidate_frames=few)) == [(10, 20, 1, 3)]
    assert answers(exact.exact_query(d, spec, 100, 100, candidate_bindings=only.limit(0))) == []


def test_relations_text():
    from framelink.plans.spec import parse_relations

    assert parse_relations("0-1:0,2:-5..5; 1-2:0,7:3,-4") == {(0, 1): RelationConstraint(0, 2, frozenset(range(-5, 6))), (1, 2): RelationConstraint(0, 7, frozenset({3, -4}))}
    assert parse_relations("") == {}
    with pytest.raises(ValueError, match="isn't of the form"):
        parse_relations("0-1:0:5")


def test_command_line(spark, tmp_path, capsys):
    from framelink import cli

    rows = [(f, i, x, y, c) for f in range(1, 7) for i, x, y, c in ((10, 8, 47, 0), (20, 58, 47, 1 if f != 4 else 2), (30, 58, 77, 2))]
    (tmp_path / "v.txt").write_text("".join(f"{f},{i},{x},{y},4,6,1,{c},-1,-1,-1\n" for f, i, x, y, c in rows))
    spark.createDataFrame([("v", 1), ("v", 4)], "video string, start_frame long").write.parquet(str(tmp_path / "keys"))
    size = ["--width", "100", "--height", "100"]
    files, index = ["--tracks", str(tmp_path / "v.txt"), *size], ["--index", str(tmp_path / "ix")]

    def run(*words):
        cli.main(list(words))
        return capsys.readouterr().out

    built = run("build", *files, *index, "--keys", str(tmp_path / "keys"))
    assert "name=edge_index rows=18" in built and "name=type_index rows=6" in built
    assert "role_0=10 role_1=20" in run("lenient", *index, "--types", "0,1", "--stats") and "pair_lookups" in run("strict", *index, "--types", "0,1", "--stats")
    assert "role_0=10 role_1=20" in run("pairs", *index, "--types", "0,1", "--pairs", "0-1:1,5")
    out = run("batch", *index, "--types", "0,1;0,2", "--strict", "--theta-lt", "3", "--report", str(tmp_path / "report"))
    assert "query_id=q1" in out and "frames 1,2,3" in "".join(r.value for r in spark.read.text(str(tmp_path / "report")).collect())
    assert "name=type_index rows=7" in run("repair", *files, *index, "--keys", str(tmp_path / "keys"))
    found = run("directed", *files, "--types", "0,1", "--relations", "0-1:2,2:0", "--frames", "3", "--stats")
    assert "role_0=10 role_1=20 start_frame=1 end_frame=3" in found and "candidate_frames=5" in found
