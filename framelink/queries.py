"""The engine's operators as queries over the driver's event table, each with its SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import quantize as Q
from .functions.intervals import from_runs, is_consecutive, to_runs
from .operators import compressed, match, patterns, ranking, relations, windows
from .plans import batch, exact
from .plans.prepared import PreparedEngine
from .plans.spec import QuerySpec, RelationConstraint, parse_pair_constraints
from .sources import artifacts, tracks
from .sources.shared import shared_folder, stored
from .streaming.relations import stream_relations

WIDTH, HEIGHT, BASE = 1920, 1080, 3000.0
STEP, SHORT = 25, 2
VIDEO = "video string, start_frame long"
FORWARD = frozenset(range(-5, 6))

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, longs: str = "", texts: str = ""):
    """Register a query; integer columns are BIGINT on both sides and the video's name is left out."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.col(c).cast("long").alias(c) for c in longs.split()], *texts.split())

        QUERIES[f.__name__] = run
        if sql:
            cols = ", ".join([*(f"{c}::BIGINT AS {c}" for c in longs.split()), *texts.split()])
            ctes, _, last = sql.rpartition("\n;")
            SQL[f.__name__] = f"WITH {ctes or RAW}\nSELECT {cols} FROM ({last or sql})"
        return run

    return add


# --- input -----------------------------------------------------------------------------------


def detections(spark, sf_dir) -> DataFrame:
    return tracks.events_as_detections(spark.read.parquet(f"{sf_dir}/events.parquet"))


def changing(spark, sf_dir) -> DataFrame:
    """As detections, but a track's class follows its event type and so changes; frames of 8 events, 12 tracks."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return tracks.events_as_detections(events.withColumn("kind", F.length("event_type") % 3), 8, 12).drop("class_id").join(events.select(F.col("event_id").alias("row_id"), (F.length("event_type") % 3).alias("class_id")), "row_id")


def spans(last: DataFrame, step: int) -> DataFrame:
    """Windows of `step` frames up to each video's last."""
    return windows.windows_from_key_frames(last.select("video", F.explode(F.sequence(F.lit(1).cast("long"), "last", F.lit(step).cast("long"))).alias("start_frame")))


def in_windows(d: DataFrame, step: int = STEP, of: DataFrame | None = None) -> DataFrame:
    """d with windows of `step` frames; of: the detections that d was joined from."""
    last = windows.last_frames(d if of is None else of)
    return windows.assign_windows(d, spans(last, step), last)


def normal_edges(d: DataFrame) -> DataFrame:
    return relations.quantized(relations.edges(d, HEIGHT, WIDTH, "normal"))


def index_of(d: DataFrame, step: int = STEP) -> DataFrame:
    return windows.edge_index(in_windows(normal_edges(d), step, of=d))


def frames_in_windows(d: DataFrame, step: int) -> DataFrame:
    return in_windows(d, step).select("video", "window_id", "frame", "track_id").distinct()


# --- SQL pieces ------------------------------------------------------------------------------

_RAW = """raw AS (
  SELECT event_id AS row_id, event_id // {per} + 1 AS frame, user_id % {tracks} AS track_id, {cls} AS class_id,
    least(value * 10, 1900.0::DOUBLE) AS cx, json_extract_string(props, '$.k')::DOUBLE * 10 AS cy FROM events),
pos AS (
  SELECT frame, track_id, max(row_id) AS row_id, min(row_id) AS slot, arg_max(cx, row_id) AS cx, arg_max(cy, row_id) AS cy
  FROM raw GROUP BY frame, track_id),
cls AS (SELECT DISTINCT frame, track_id, class_id FROM raw),
pairs AS (
  SELECT a.frame, a.track_id AS src, b.track_id AS dst, atan2(b.cy - a.cy, b.cx - a.cx) AS theta,
    sqrt((b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy)) AS d,
    a.cx AS ax, a.cy AS ay, a.slot AS aslot, b.cx AS bx, b.cy AS by_, b.slot AS bslot
  FROM pos a JOIN pos b ON a.frame = b.frame AND a.track_id <> b.track_id),
bins AS (SELECT *, floor(theta / (pi() / 10))::INT AS theta_bin, floor(d / 3000.0::DOUBLE / 0.125::DOUBLE)::INT AS dist_bin FROM pairs),
rel AS (
  SELECT p.frame, src, dst, x.class_id AS src_class, y.class_id AS dst_class, theta_bin, dist_bin FROM bins p
  JOIN cls x ON p.frame = x.frame AND src = x.track_id JOIN cls y ON p.frame = y.frame AND dst = y.track_id),
edge AS (
  SELECT frame, (frame - 1) // 25 + 1 AS window_id, src AS sid, dst AS eid, theta_bin, dist_bin FROM bins
  WHERE ax < bx OR (ax = bx AND (ay < by_ OR (ay = by_ AND aslot < bslot)))),
types AS (SELECT DISTINCT (frame - 1) // 25 + 1 AS window_id, track_id, class_id FROM cls)"""
RAW = _RAW.format(per=12, tracks=8, cls="(user_id % 8) % 3")
RAW_CHANGING = _RAW.format(per=8, tracks=12, cls="length(event_type) % 3")


def with_(more: str, last: str, raw: str = RAW) -> str:
    return f"{raw}{',' if more else ''}\n{more}\n;{last}"


def runs_sql(table: str, keys: str, least: int = 1) -> str:
    return f"""SELECT {keys}, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS length FROM (
  SELECT *, frame - row_number() OVER (PARTITION BY {keys} ORDER BY frame) AS island FROM (SELECT DISTINCT frame, {keys} FROM {table}))
  GROUP BY {keys}, island HAVING count(*) >= {least}"""


def exact_sql(spec: QuerySpec, raw: str = RAW, tail: str = "") -> str:
    roles = [f"role_{i}" for i in range(len(spec.role_types))]
    out, have = "", set()
    for i, j in exact.join_order(dict(spec.relations)):
        c = spec.relations[i, j]
        t = f"(SELECT DISTINCT frame, src AS role_{i}, dst AS role_{j} FROM rel WHERE src_class = {spec.role_types[i]} AND dst_class = {spec.role_types[j]} AND theta_bin IN ({', '.join(map(str, sorted(c.theta_bins)))}) AND dist_bin BETWEEN {c.d_min} AND {c.d_max})"
        out = t if not out else f"{out} JOIN {t} USING ({', '.join(['frame', *(f'role_{k}' for k in (i, j) if k in have)])})"
        have |= {i, j}
    for i, t in enumerate(spec.role_types):
        if i not in have:
            s = f"(SELECT DISTINCT frame, track_id AS role_{i} FROM cls WHERE class_id = {t})"
            out = s if not out else f"{out} JOIN {s} USING (frame)"
    differ = " AND ".join(f"{a} <> {b}" for a, b in combinations(roles, 2)) or "true"
    bound = f"bound AS (SELECT frame, {', '.join(roles)} FROM {out} WHERE {differ})"
    return with_(bound, runs_sql("bound", ", ".join(roles), spec.min_consecutive_frames) + tail, raw)


def spec_columns(spec: QuerySpec) -> str:
    return " ".join([*(f"role_{i}" for i in range(len(spec.role_types))), "start_frame", "end_frame", "length"])


def register_exact(name: str, spec: QuerySpec, source=detections, raw: str = RAW, return_all: bool = True) -> None:
    order = ", ".join(f"role_{i}" for i in range(len(spec.role_types)))
    tail = "" if return_all else f" ORDER BY length DESC, start_frame, {order} LIMIT {spec.topk}"

    def f(spark, sf_dir):
        return exact.exact_query(source(spark, sf_dir), spec, WIDTH, HEIGHT, return_all)

    f.__name__ = name
    query(exact_sql(spec, raw, tail), spec_columns(spec))(f)


# --- scans, edges, windows -------------------------------------------------------------------


@query(with_("", "SELECT event_id AS row_id, event_id // 12 AS frame, user_id % 8 AS track_id, round((least(value * 10, 1900.0::DOUBLE) + (user_id % 7) / 2) * 100) AS cx100, round((json_extract_string(props, '$.k')::DOUBLE * 10 + 1.5::DOUBLE) * 100) AS cy100 FROM events WHERE event_id // 12 >= 1"), "row_id frame track_id cx100 cy100")
def detections_scan(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    boxes = e.select(F.lit("events").alias("video"), F.col("event_id").alias("row_id"), F.expr("event_id div 12").alias("frame"), (F.col("user_id") % 8).alias("track_id"), F.lit(1).alias("class_id"), F.least(F.col("value") * 10, F.lit(1900.0)).alias("left"), (F.get_json_object("props", "$.k").cast("double") * 10).alias("top"), (F.col("user_id") % 7).alias("width"), F.lit(3).alias("height"))
    c = tracks.centers(boxes)
    return c.select("row_id", "frame", "track_id", F.round(F.col("cx") * 100).alias("cx100"), F.round(F.col("cy") * 100).alias("cy100"))


@query(with_("g AS (SELECT unnest(range(1, (SELECT max(frame) FROM raw) + 1)) AS frame)", "SELECT g.frame, count(r.track_id) AS n_ids, coalesce(string_agg(r.track_id::VARCHAR, ',' ORDER BY r.row_id), '') AS ids FROM g LEFT JOIN raw r ON g.frame = r.frame GROUP BY g.frame"), "frame n_ids", "ids")
def frame_density(spark, sf_dir):
    f = tracks.frame_ids(detections(spark, sf_dir))
    return f.select("frame", F.size("ids").alias("n_ids"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(with_("", "SELECT * FROM edge"), "frame sid eid theta_bin dist_bin")
def edges_normal(spark, sf_dir):
    return normal_edges(detections(spark, sf_dir))


@query(with_("", "SELECT frame, src AS sid, dst AS eid, theta_bin, dist_bin FROM bins"), "frame sid eid theta_bin dist_bin")
def edges_complete(spark, sf_dir):
    return relations.quantized(relations.edges(detections(spark, sf_dir), HEIGHT, WIDTH, "complete"))


@query(with_("a AS (SELECT frame, arg_min(track_id, (cx, cy, slot)) AS sid FROM pos GROUP BY frame)", "SELECT b.frame, sid, dst AS eid, theta_bin, dist_bin FROM bins b JOIN a ON a.frame = b.frame AND b.src = a.sid"), "frame sid eid theta_bin dist_bin")
def edges_pattern(spark, sf_dir):
    return relations.quantized(relations.edges(detections(spark, sf_dir), HEIGHT, WIDTH, "pattern"))


def _floor_div_sql(x: str, y: str) -> str:
    q = f"(({x} - {x} % {y}) / {y} - CASE WHEN {x} % {y} < 0 THEN 1 ELSE 0 END)"
    return f"(floor({q}) + CASE WHEN {q} - floor({q}) > 0.5 THEN 1 ELSE 0 END)::INT"


@query(with_("", f"SELECT frame, src AS sid, dst AS eid, {_floor_div_sql('theta', '(pi() / 12)')} AS theta_bin, {_floor_div_sql('(d / 3000.0::DOUBLE)', '(1.0::DOUBLE / 6)')} AS dist_bin FROM bins"), "frame sid eid theta_bin dist_bin")
def quantized_edges(spark, sf_dir):
    return relations.quantized(relations.edges(detections(spark, sf_dir), HEIGHT, WIDTH, "complete"), 12, 6)


@query(with_("", "SELECT row_id, frame, (frame - 1) // 25 + 1 AS window_id FROM raw"), "row_id frame window_id")
def window_assign(spark, sf_dir):
    return in_windows(detections(spark, sf_dir))


@query(with_("", "SELECT (frame - 1) // 25 + 1 AS window_id, track_id, arg_max(class_id, (frame, row_id)) AS class_id FROM raw GROUP BY 1, 2", RAW_CHANGING), "window_id track_id class_id")
def type_index_last(spark, sf_dir):
    return windows.type_index_last(in_windows(changing(spark, sf_dir)))


@query(with_("", "SELECT * FROM types", RAW_CHANGING), "window_id track_id class_id")
def type_index_all(spark, sf_dir):
    return windows.type_index_all(in_windows(changing(spark, sf_dir)))


@query(with_("", "SELECT window_id, sid, eid, theta_bin, dist_bin, count(*) AS n_frames, string_agg(frame::VARCHAR, ',' ORDER BY frame) AS frames FROM edge GROUP BY ALL"), "window_id sid eid theta_bin dist_bin n_frames", "frames")
def edge_index(spark, sf_dir):
    c = windows.compact(index_of(detections(spark, sf_dir)))
    return c.withColumn("n_frames", F.size("frames")).withColumn("frames", F.array_join(F.col("frames").cast("array<string>"), ","))


_SHORT_TYPES = "t AS (SELECT DISTINCT (frame - 1) // 2 + 1 AS window_id, track_id, class_id FROM cls)"


@query(with_(_SHORT_TYPES, "SELECT * FROM t WHERE class_id IN (0, 1, 2) AND window_id IN (SELECT window_id FROM t GROUP BY 1 HAVING count(DISTINCT class_id) = 3)", RAW_CHANGING), "window_id track_id class_id")
def window_filter_set(spark, sf_dir):
    return windows.filter_set(windows.type_index_all(in_windows(changing(spark, sf_dir), SHORT)), [0, 1, 2, 1])


@query(with_(_SHORT_TYPES + ", n AS (SELECT window_id, class_id, count(*) AS n FROM t GROUP BY ALL)", "SELECT * FROM t WHERE class_id IN (0, 1, 2) AND window_id IN (SELECT window_id FROM n WHERE (class_id = 0 AND n >= 3) OR (class_id = 1 AND n >= 2) OR (class_id = 2 AND n >= 3) GROUP BY 1 HAVING count(*) = 3)", RAW_CHANGING), "window_id track_id class_id")
def window_filter_multiset(spark, sf_dir):
    return windows.filter_multiset(windows.type_index_all(in_windows(changing(spark, sf_dir), SHORT)), [0, 1, 2, 0, 2, 1, 0, 2])


_KEY = "src_class, dst_class, theta_bin, dist_bin, src, dst"


@query(with_("", runs_sql("rel", _KEY)), "src_class dst_class theta_bin dist_bin src dst start_frame end_frame")
def relation_postings(spark, sf_dir):
    return relations.postings(relations.relations(detections(spark, sf_dir), WIDTH, HEIGHT))


@query(with_("", f"SELECT {_KEY}, count(*) AS n_frames, min(frame) AS first_frame, max(frame) AS last_frame FROM rel GROUP BY ALL"), "src_class dst_class theta_bin dist_bin src dst n_frames first_frame last_frame")
def interval_expand(spark, sf_dir):
    p = from_runs(relations.postings(relations.relations(detections(spark, sf_dir), WIDTH, HEIGHT)))
    return p.groupBy(*_KEY.split(", ")).agg(F.count("*").alias("n_frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


@query(with_("", "SELECT * FROM rel WHERE (src_class, dst_class) IN ((0, 1), (1, 0))", RAW_CHANGING), "frame src dst src_class dst_class theta_bin dist_bin")
def allowed_type_pairs(spark, sf_dir):
    return relations.relations(changing(spark, sf_dir), WIDTH, HEIGHT, allowed_type_pairs={(0, 1), (1, 0)})


@query(with_("o AS (SELECT frame, track_id, class_id, cx, cy FROM raw GROUP BY ALL)", "SELECT DISTINCT a.frame, a.track_id AS src, b.track_id AS dst, a.class_id AS src_class, b.class_id AS dst_class, floor(atan2(b.cy - a.cy, b.cx - a.cx) / (pi() / 10))::INT AS theta_bin, floor(sqrt((b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy)) / 3000.0::DOUBLE / 0.125::DOUBLE)::INT AS dist_bin FROM o a JOIN o b ON a.frame = b.frame AND a.track_id <> b.track_id", RAW_CHANGING), "frame src dst src_class dst_class theta_bin dist_bin")
def raw_row_relations(spark, sf_dir):
    return relations.raw_row_relations(changing(spark, sf_dir), WIDTH, HEIGHT)


@query(with_("c AS (SELECT src, dst, theta_bin, dist_bin, list(DISTINCT frame) AS f FROM rel GROUP BY ALL)", "SELECT src, dst, theta_bin, dist_bin, (list_max(f) - list_min(f) + 1 = len(f))::INT AS consecutive FROM c"), "src dst theta_bin dist_bin consecutive")
def consecutive_test(spark, sf_dir):
    c = relations.relations(detections(spark, sf_dir), WIDTH, HEIGHT).groupBy("src", "dst", "theta_bin", "dist_bin").agg(F.collect_set("frame").alias("frames"))
    return c.withColumn("consecutive", is_consecutive(F.col("frames")).cast("int"))


@query(with_("", "SELECT a.frame, a.src, a.dst FROM bins a JOIN bins b ON b.frame = a.frame + 1 AND a.src = b.src AND a.dst = b.dst WHERE abs(a.theta_bin - b.theta_bin) <= 1 AND abs(abs(a.dist_bin) - abs(b.dist_bin)) <= 0"), "frame src dst")
def tolerance_match(spark, sf_dir):
    r = relations.relations(detections(spark, sf_dir), WIDTH, HEIGHT)
    nxt = r.select("video", (F.col("frame") - 1).alias("frame"), "src", "dst", F.col("theta_bin").alias("t2"), F.col("dist_bin").alias("d2"))
    return r.join(nxt, ["video", "frame", "src", "dst"]).where(Q.near(F.col("theta_bin"), F.col("t2"), F.col("dist_bin"), F.col("d2"), 1, 0))




@query(
    with_(
        "f AS (SELECT frame, list(DISTINCT track_id) AS ids, row_number() OVER (ORDER BY frame) AS rn FROM raw GROUP BY frame), "
        "s AS (SELECT rn, frame, ids AS last, true AS is_key FROM f WHERE rn = 1 UNION ALL SELECT f.rn, f.frame, CASE WHEN k THEN f.ids ELSE s.last END, k "
        "FROM s JOIN f ON f.rn = s.rn + 1, LATERAL (SELECT len(list_intersect(s.last, f.ids)) / len(list_distinct(list_concat(s.last, f.ids)))::DOUBLE < 0.6 AS k))",
        "SELECT frame AS start_frame FROM s WHERE is_key",
    ).replace("raw AS (", "RECURSIVE raw AS (", 1),
    "start_frame",
)
def key_frame_segments(spark, sf_dir):
    return windows.segment(tracks.frame_ids(detections(spark, sf_dir)), 0.6)


# --- threshold queries -----------------------------------------------------------------------


def _bindings_sql(types, distinct: bool) -> str:
    roles = ", ".join(f"t{i}.track_id AS role_{i}" for i in range(len(types)))
    join = " ".join(f"JOIN types t{i} ON t{i}.window_id = t0.window_id" for i in range(1, len(types)))
    where = [f"t{i}.class_id = {t}" for i, t in enumerate(types)] + ([f"t{i}.track_id <> t{j}.track_id" for i, j in combinations(range(len(types)), 2)] if distinct else [])
    return f"b AS (SELECT t0.window_id, {roles} FROM types t0 {join} WHERE {' AND '.join(where)})"


def _match_sql(types, limits, strict: bool) -> str:
    n, roles = len(types), ", ".join(f"role_{i}" for i in range(len(types)))
    parts = []
    for k, (i, j) in enumerate(combinations(range(n), 2)):
        t, d = limits[i, j] if isinstance(limits, dict) else limits
        ends = f"(e.sid = role_{i} AND e.eid = role_{j})" + (f" OR (e.sid = role_{j} AND e.eid = role_{i})" if strict else "")
        parts.append(f"SELECT DISTINCT b.*, {k} AS pair, e.frame FROM b JOIN edge e ON e.window_id = b.window_id AND ({ends}) WHERE e.theta_bin < {t} AND e.dist_bin < {d}")
    need = str(n * (n - 1) // 2) if strict else f"(SELECT count(DISTINCT pair) FROM h x WHERE x.window_id = h.window_id AND {' AND '.join(f'x.role_{i} = h.role_{i}' for i in range(n))})"
    if not strict:
        return f"{_bindings_sql(types, strict)}, h AS ({' UNION ALL '.join(parts)}), np AS (SELECT window_id, {roles}, count(DISTINCT pair) AS np FROM h GROUP BY ALL), m AS (SELECT window_id, {roles}, frame FROM (SELECT window_id, {roles}, frame, count(*) AS c FROM h GROUP BY ALL) JOIN np USING (window_id, {roles}) WHERE c = np)"
    return f"{_bindings_sql(types, strict)}, h AS ({' UNION ALL '.join(parts)}), m AS (SELECT window_id, {roles}, frame FROM h GROUP BY ALL HAVING count(*) = {need})"


def _ranked(types, threshold: int, k: int | None) -> str:
    roles = ", ".join(f"role_{i}" for i in range(len(types)))
    return f"SELECT {roles}, count(DISTINCT frame) AS n_frames, string_agg(DISTINCT frame::VARCHAR, ',' ORDER BY frame::VARCHAR) AS frames FROM m GROUP BY {roles} HAVING count(DISTINCT frame) > {threshold}" + (f" ORDER BY n_frames DESC, {roles} LIMIT {k}" if k else "")


def _texted(df: DataFrame) -> DataFrame:
    return df.withColumn("frames", F.array_join(F.array_sort(F.col("frames").cast("array<string>")), ","))


TRIPLE, DOUBLED = [0, 1, 2], [0, 1, 1]
LIMITS = parse_pair_constraints("0-1:2,1;0-2:3,2;1-2:0,2", 3)


@query(with_(_match_sql(TRIPLE, (1, 1), False), "SELECT window_id, role_0, role_1, role_2, frame FROM m"), "window_id role_0 role_1 role_2 frame")
def legacy_match(spark, sf_dir):
    d = detections(spark, sf_dir)
    return match.lenient_match(windows.type_index_all(in_windows(d)), index_of(d), TRIPLE, 1, 1)


@query(with_(_match_sql([0, 0], (1, 2), False), _ranked([0, 0], 2, 5)), "role_0 role_1 n_frames", "frames")
def legacy_topk(spark, sf_dir):
    d = detections(spark, sf_dir)
    return _texted(batch.threshold_query(windows.type_index_last(in_windows(d)), index_of(d), [0, 0], (1, 2), strict=False))


@query(with_(f"{_bindings_sql([0, 1], False)}, c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY role_0, role_1) <= 4)", "SELECT * FROM c"), "window_id role_0 role_1")
def capped_bindings(spark, sf_dir):
    d = detections(spark, sf_dir)
    return match.capped(match.product(windows.filter_set(windows.type_index_last(in_windows(d)), [0, 1]), [0, 1], False), 4)


@query(with_(_match_sql(DOUBLED, (3, 2), True), "SELECT window_id, role_0, role_1, role_2, frame FROM m"), "window_id role_0 role_1 role_2 frame")
def strict_match(spark, sf_dir):
    d = detections(spark, sf_dir)
    return match.strict_match(windows.type_index_last(in_windows(d)), index_of(d), DOUBLED, (3, 2))


@query(with_(_match_sql(TRIPLE, LIMITS, True), _ranked(TRIPLE, 0, None)), "role_0 role_1 role_2 n_frames", "frames")
def pair_constraint_match(spark, sf_dir):
    d = detections(spark, sf_dir)
    return _texted(batch.threshold_query(windows.type_index_last(in_windows(d)), index_of(d), TRIPLE, LIMITS, 0, None))


@query(with_(_match_sql(DOUBLED, (3, 2), True), "SELECT count(DISTINCT window_id) AS windows_total, (SELECT count(DISTINCT window_id) FROM types) AS windows_kept, (SELECT count(*) FROM (SELECT DISTINCT role_0, role_1, role_2 FROM m)) AS bindings, (SELECT count(*) FROM (SELECT DISTINCT role_0, role_1, role_2, frame FROM m)) AS binding_frames FROM types"), "windows_total windows_kept bindings binding_frames")
def query_stats(spark, sf_dir):
    d = detections(spark, sf_dir)
    types = windows.type_index_last(in_windows(d))
    return match.match_stats(types, windows.filter_multiset(types, DOUBLED), match.strict_match(types, index_of(d), DOUBLED, (3, 2)))


_BINS_SQL = "ub AS (SELECT window_id, a, b, count(*) AS bins, max(CASE WHEN theta_bin < {t} AND dist_bin < {d} THEN 1 ELSE 0 END) AS ok FROM (SELECT DISTINCT window_id, a, b, theta_bin, dist_bin FROM (SELECT window_id, sid AS a, eid AS b, theta_bin, dist_bin FROM edge{back})) GROUP BY ALL)"
_WINDOWS_SQL = "(SELECT count(DISTINCT window_id) FROM types) AS windows_total, (SELECT count(DISTINCT window_id) FROM types WHERE window_id IN (SELECT window_id FROM types WHERE class_id = 0) AND window_id IN (SELECT window_id FROM types WHERE class_id = 1) AND window_id IN (SELECT window_id FROM types WHERE class_id = 2)) AS windows_kept"


@query(with_(f"{_match_sql(TRIPLE, (1, 1), False)}, {_BINS_SQL.format(t=1, d=1, back='')}, p AS (SELECT b.*, unnest([(role_0, role_1), (role_0, role_2), (role_1, role_2)]) AS x FROM b)", f"SELECT {_WINDOWS_SQL}, (SELECT count(*) FROM b) AS combinations_total, (SELECT count(*) FROM (SELECT DISTINCT window_id, role_0, role_1, role_2 FROM m)) AS combinations_matched, count(*) AS pair_lookups, coalesce(sum(bins), 0) AS bins_scanned FROM p LEFT JOIN ub ON ub.window_id = p.window_id AND ub.a = p.x[1] AND ub.b = p.x[2]"), "windows_total windows_kept combinations_total combinations_matched pair_lookups bins_scanned")
def lenient_stats(spark, sf_dir):
    d = detections(spark, sf_dir)
    return match.lenient_stats(windows.type_index_last(in_windows(d)), index_of(d), TRIPLE, 1, 1)


@query(with_(f"{_match_sql(TRIPLE, (1, 1), True)}, {_BINS_SQL.format(t=1, d=1, back=' UNION ALL SELECT window_id, eid, sid, theta_bin, dist_bin FROM edge')}, p AS (SELECT b.*, unnest([(role_0, role_1), (role_0, role_2), (role_1, role_2)]) AS x, unnest([0, 1, 2]) AS k FROM b), q AS (SELECT p.*, coalesce(bins, 0) AS bins, coalesce(ok, 0) AS ok, min(coalesce(ok, 0)) OVER (PARTITION BY p.window_id, role_0, role_1, role_2 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p LEFT JOIN ub ON ub.window_id = p.window_id AND ub.a = p.x[1] AND ub.b = p.x[2])", f"SELECT {_WINDOWS_SQL}, (SELECT count(*) FROM b) AS bindings_total, (SELECT count(*) FROM (SELECT DISTINCT window_id, role_0, role_1, role_2 FROM m)) AS bindings_matched, count(*) AS pair_lookups, coalesce(sum(bins), 0) AS bins_scanned FROM q WHERE coalesce(before, 1) = 1"), "windows_total windows_kept bindings_total bindings_matched pair_lookups bins_scanned")
def strict_stats(spark, sf_dir):
    d = detections(spark, sf_dir)
    return match.strict_stats(windows.type_index_last(in_windows(d)), index_of(d), TRIPLE, (1, 1))


_BATCH = [[0, 1], [1, 2], [2, 2]]


@query(
    with_(
        ", ".join(_match_sql(t, (2, 2), True).replace("b AS (", f"b{k} AS (").replace(" FROM b ", f" FROM b{k} b ").replace("h AS (", f"h{k} AS (").replace("FROM h ", f"FROM h{k} ").replace("m AS (", f"m{k} AS (") for k, t in enumerate(_BATCH)),
        " UNION ALL ".join(f"SELECT '{q}' AS query_id, * FROM ({_ranked(t, 2, 3).replace('FROM m ', f'FROM m{k} ')})" for k, (q, t) in enumerate(zip(("q0", "q1", "q2"), _BATCH, strict=True))),
    ),
    "role_0 role_1 n_frames",
    "query_id frames",
)
def batch_topk(spark, sf_dir):
    d = detections(spark, sf_dir)
    return _texted(batch.batch(windows.type_index_last(in_windows(d)), index_of(d), _BATCH, limits=(2, 2), topk=3))


# --- directed queries ------------------------------------------------------------------------

NEAR = RelationConstraint(0, 1, FORWARD)
ANY = RelationConstraint(0, 1, frozenset(range(-10, 11)))
TWO = QuerySpec("two", (0, 1), {(0, 1): NEAR}, 2, 20)
THREE = QuerySpec("three", (0, 1, 2), {(0, 1): ANY, (1, 2): ANY}, 2)
register_exact("exact_two_role", TWO)
register_exact("exact_three_role", THREE)
register_exact("exact_four_role", QuerySpec("four", (0, 1, 2, 0), {(0, 1): ANY, (1, 2): ANY, (2, 3): ANY}, 1))
register_exact("exact_single_role", QuerySpec("one", (1,), {}, 2))
register_exact("exact_uncovered_role", QuerySpec("uncovered", (0, 1, 2), {(0, 1): NEAR}, 2))
register_exact("exact_disjoint_relations", QuerySpec("disjoint", (0, 1, 1, 2), {(0, 1): NEAR, (2, 3): NEAR}, 1))
register_exact("exact_repeated_type", QuerySpec("repeated", (0, 0), {(0, 1): NEAR, (1, 0): RelationConstraint(0, 1, frozenset(range(-10, 11)))}, 2))
register_exact("exact_class_change", QuerySpec("change", (0, 1), {(0, 1): ANY}, 1), changing, RAW_CHANGING)
register_exact("exact_topk", TWO, return_all=False)


@query(exact_sql(THREE), spec_columns(THREE))
def directed_index_query(spark, sf_dir):
    return exact.DirectedIndex.build(detections(spark, sf_dir), WIDTH, HEIGHT).query(THREE, return_all=True)


@query(with_("", "SELECT frame, eid AS src, sid AS dst FROM edge WHERE CASE WHEN theta_bin >= 0 THEN theta_bin - 10 ELSE theta_bin + 10 END IN (5, 6, 7, 8, 9, 10) OR theta_bin = 0"), "frame src dst")
def reverse_direction_match(spark, sf_dir):
    e = normal_edges(detections(spark, sf_dir)).where(Q.reverse_matches(F.col("theta_bin"), range(5, 11)))
    return e.select("frame", F.col("eid").alias("src"), F.col("sid").alias("dst"))


@query(with_("s AS (SELECT *, floor(d / 2000.0::DOUBLE / 0.125::DOUBLE)::INT AS stored FROM bins)", "SELECT frame, src, dst, stored FROM s WHERE stored * 250.0::DOUBLE < 3 * 375.0::DOUBLE AND 1 * 375.0::DOUBLE < (stored + 1) * 250.0::DOUBLE"), "frame src dst stored")
def rescaled_match(spark, sf_dir):
    r = relations.relations(detections(spark, sf_dir), 1280, 720)
    return r.where(Q.rescaled_overlap(F.col("dist_bin"), 1, 2, 2000, BASE)).withColumnRenamed("dist_bin", "stored")


@query(with_("p AS (SELECT * FROM pos WHERE track_id IN (1, 2, 5) AND frame BETWEEN 11 AND 60), a AS (SELECT frame, arg_min(track_id, (cx, cy, slot)) AS sid FROM p GROUP BY frame)", "SELECT b.frame - 10 AS frame, sid, dst AS eid, theta_bin, dist_bin FROM bins b JOIN a ON a.frame = b.frame AND b.src = a.sid WHERE dst IN (1, 2, 5)"), "frame sid eid theta_bin dist_bin")
def pattern_extract(spark, sf_dir):
    return relations.quantized(relations.pattern_extract(detections(spark, sf_dir), [1, 2, 5], 11, 60, HEIGHT, WIDTH).edges)


# --- patterns and compressed graphs ----------------------------------------------------------

PATTERN_STEP = 5


def _text(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",")


_SETS_SQL = """fr AS (SELECT DISTINCT (frame - 1) // 5 + 1 AS w, frame, track_id AS item FROM raw),
nf AS (SELECT w, count(DISTINCT frame) AS nf FROM fr GROUP BY w),
core AS (SELECT w, item FROM fr GROUP BY w, item HAVING count(*) = (SELECT nf FROM nf WHERE nf.w = fr.w)),
it AS ({items}),
fq AS (SELECT w, item, count(*) AS f FROM it GROUP BY w, item),
pa AS (SELECT w, frame, list(item ORDER BY f DESC, item) AS path FROM it JOIN fq USING (w, item) GROUP BY w, frame),
se AS (SELECT DISTINCT w, list_sort(path[1:k]) AS items FROM (SELECT w, path, unnest(range(2, len(path) + 1)) AS k FROM pa)),
su AS (SELECT s.w, s.items, count(*) AS n FROM se s JOIN pa p ON s.w = p.w AND list_has_all(p.path, s.items) GROUP BY s.w, s.items),
mi AS (SELECT * FROM su UNION ALL SELECT w, [item], f FROM fq WHERE NOT EXISTS (SELECT 1 FROM su WHERE su.w = fq.w AND su.n = fq.f AND list_contains(su.items, fq.item)))"""
_ALL_ITEMS, _REST_ITEMS = "SELECT * FROM fr", "SELECT fr.* FROM fr LEFT JOIN core c ON c.w = fr.w AND c.item = fr.item WHERE c.item IS NULL"
_VERTEX_SQL = (
    _SETS_SQL.format(items=_REST_ITEMS)
    + """,
co AS (SELECT nf.w, nf.nf, coalesce(list_sort(list(core.item) FILTER (WHERE core.item IS NOT NULL)), []::BIGINT[]) AS name FROM nf LEFT JOIN core ON core.w = nf.w GROUP BY nf.w, nf.nf),
nd AS (SELECT w, name, nf AS n, true AS st FROM co UNION ALL SELECT mi.w, list_sort(list_concat(mi.items, co.name)), mi.n, false FROM mi JOIN co ON co.w = mi.w),
vx AS (SELECT w AS window_id, (row_number() OVER (PARTITION BY w ORDER BY st DESC, len(name), name) - 1)::INT AS v, name, n FROM nd),
anc AS (SELECT p.window_id, p.v AS parent, c.v AS child FROM vx p JOIN vx c ON p.window_id = c.window_id AND len(p.name) < len(c.name) AND list_has_all(c.name, p.name)),
ed AS (SELECT * FROM anc a WHERE NOT EXISTS (SELECT 1 FROM anc x JOIN anc y ON x.window_id = y.window_id AND x.child = y.parent WHERE x.window_id = a.window_id AND x.parent = a.parent AND y.child = a.child)),
e5 AS (SELECT DISTINCT (frame - 1) // 5 + 1 AS window_id, sid, eid, theta_bin, dist_bin, frame FROM edge),
ins AS (SELECT DISTINCT e.window_id, v.v, e.sid, e.eid FROM e5 e JOIN vx v ON v.window_id = e.window_id AND list_contains(v.name, e.sid) AND list_contains(v.name, e.eid)),
cp AS (SELECT e.window_id, i.v, e.sid, e.eid, e.theta_bin, e.dist_bin, e.frame FROM ins i JOIN e5 e ON e.window_id = i.window_id AND e.sid = i.sid AND e.eid = i.eid
  WHERE NOT EXISTS (SELECT 1 FROM anc a JOIN ins p ON p.window_id = a.window_id AND p.v = a.parent AND p.sid = i.sid AND p.eid = i.eid WHERE a.window_id = i.window_id AND a.child = i.v))"""
)


def _vertices(d: DataFrame) -> DataFrame:
    return compressed.cg_vertices(patterns.node_sets(frames_in_windows(d, PATTERN_STEP))).persist()


@query(with_(_SETS_SQL.format(items=_ALL_ITEMS), "SELECT w AS window_id, n, array_to_string(items, ',') AS items FROM mi"), "window_id n", "items")
def prefix_itemsets(spark, sf_dir):
    f = frames_in_windows(detections(spark, sf_dir), PATTERN_STEP)
    return patterns.prefix_itemsets(f.groupBy("video", "window_id", F.col("frame").alias("tid")).agg(F.collect_list("track_id").alias("items"))).withColumn("items", _text("items"))


@query(with_(_SETS_SQL.format(items=_ALL_ITEMS), "SELECT w AS window_id, item AS track_id FROM core"), "window_id track_id")
def window_core(spark, sf_dir):
    return patterns.window_core(frames_in_windows(detections(spark, sf_dir), PATTERN_STEP))


@query(with_(_VERTEX_SQL, "SELECT window_id, v, n, array_to_string(name, ',') AS name FROM vx"), "window_id v n", "name")
def cg_vertices(spark, sf_dir):
    return _vertices(detections(spark, sf_dir)).withColumn("name", _text("name"))


@query(with_(_VERTEX_SQL, "SELECT * FROM ed"), "window_id parent child")
def cg_edges(spark, sf_dir):
    return compressed.cg_edges(_vertices(detections(spark, sf_dir)))


@query(with_(_VERTEX_SQL, "SELECT * FROM cp"), "window_id v sid eid theta_bin dist_bin frame")
def cg_pairs(spark, sf_dir):
    d = detections(spark, sf_dir)
    return compressed.cg_pairs(_vertices(d), index_of(d, PATTERN_STEP))


@query(
    with_(
        _VERTEX_SQL + ", ty AS (SELECT DISTINCT (frame - 1) // 5 + 1 AS window_id, track_id, class_id FROM cls), "
        "b AS (SELECT DISTINCT v.window_id, x.track_id AS role_0, y.track_id AS role_1, arg_min(v.v, (len(v.name), v.v)) AS v FROM vx v JOIN ty x ON x.window_id = v.window_id AND x.class_id = 0 AND list_contains(v.name, x.track_id) JOIN ty y ON y.window_id = v.window_id AND y.class_id = 1 AND list_contains(v.name, y.track_id) GROUP BY ALL), "
        "cl AS (SELECT window_id, v, sid, eid, theta_bin, dist_bin, frame FROM cp UNION SELECT a.window_id, a.child, p.sid, p.eid, p.theta_bin, p.dist_bin, p.frame FROM anc a JOIN cp p ON p.window_id = a.window_id AND p.v = a.parent)",
        "SELECT DISTINCT b.window_id, role_0, role_1, frame FROM b JOIN cl ON cl.window_id = b.window_id AND cl.v = b.v AND ((sid = role_0 AND eid = role_1) OR (sid = role_1 AND eid = role_0)) WHERE theta_bin < 2 AND dist_bin < 2",
    ),
    "window_id role_0 role_1 frame",
)
def strict_graph_match(spark, sf_dir):
    d = detections(spark, sf_dir)
    v = _vertices(d)
    closure = compressed.cg_closure(v, compressed.cg_pairs(v, index_of(d, PATTERN_STEP).persist())).persist()
    return match.strict_graph_match(windows.type_index_last(in_windows(d, PATTERN_STEP)), v, closure, [0, 1], (2, 2))


# --- prepared engine -------------------------------------------------------------------------


def _engine(spark, sf_dir, legacy: bool, keep: str = "true", small: bool = False) -> PreparedEngine:
    d = detections(spark, sf_dir)
    if small:
        r = relations.relations(d, 1280, 720).select("video", "frame", F.col("src").alias("sid"), F.col("dst").alias("eid"), "theta_bin", "dist_bin")
        return PreparedEngine(d, WIDTH, HEIGHT, windows.edge_index(in_windows(r, of=d)), indexed_width=1280, indexed_height=720)
    return PreparedEngine(d, WIDTH, HEIGHT, index_of(d).where(keep), legacy_single_direction=legacy)


@query(with_("", "SELECT DISTINCT frame FROM bins WHERE frame % 10 = 0"), "frame")
def audit_fallback_frames(spark, sf_dir):
    return _engine(spark, sf_dir, True, "frame % 10 <> 0").fallback_frames()


@query(with_("s AS (SELECT *, floor(d / 2000.0::DOUBLE / 0.125::DOUBLE)::INT AS s_dist FROM bins)", "SELECT theta_bin AS s_theta, s_dist, string_agg(DISTINCT dist_bin::VARCHAR, ',' ORDER BY dist_bin::VARCHAR) AS options FROM s GROUP BY ALL"), "s_theta s_dist", "options")
def bin_options(spark, sf_dir):
    return _engine(spark, sf_dir, False, small=True).bin_options().withColumn("options", F.array_join(F.array_sort(F.col("distance_options").cast("array<string>")), ","))


@query(exact_sql(TWO), spec_columns(TWO))
def prepared_query(spark, sf_dir):
    return _engine(spark, sf_dir, True, "frame % 10 <> 0").query(TWO, return_all=True)


@query(exact_sql(TWO), spec_columns(TWO))
def prepared_rescaled_query(spark, sf_dir):
    return _engine(spark, sf_dir, False, small=True).query(TWO, return_all=True)


@query(with_("", "SELECT DISTINCT e.window_id, x.class_id AS src_class, y.class_id AS dst_class, 0 AS reverse, sid, eid FROM edge e JOIN cls x ON x.frame = e.frame AND x.track_id = sid JOIN cls y ON y.frame = e.frame AND y.track_id = eid UNION SELECT DISTINCT e.window_id, y.class_id, x.class_id, 1, sid, eid FROM edge e JOIN cls x ON x.frame = e.frame AND x.track_id = sid JOIN cls y ON y.frame = e.frame AND y.track_id = eid"), "window_id src_class dst_class reverse sid eid")
def type_directory(spark, sf_dir):
    return _engine(spark, sf_dir, True).type_directory()


@query(with_("", "SELECT * FROM rel"), "frame src dst src_class dst_class theta_bin dist_bin")
def streamed_relations(spark, sf_dir):
    """The per-frame form that a stream uses, here over a batch."""
    t = relations.typed_objects(detections(spark, sf_dir))
    frames = t.groupBy("video", "frame").agg(F.collect_list(F.struct("track_id", "class_id", "cx", "cy")).alias("objects"))
    return stream_relations(frames, WIDTH, HEIGHT)


@query(with_("c AS (SELECT * FROM edge WHERE frame % 10 <> 0), y AS (SELECT DISTINCT c.window_id, x.class_id AS a, y.class_id AS b, sid, eid FROM c JOIN cls x ON x.frame = c.frame AND x.track_id = sid JOIN cls y ON y.frame = c.frame AND y.track_id = eid)", "SELECT (SELECT count(*) FROM c) AS stored_rows, (SELECT count(DISTINCT frame) FROM bins WHERE frame % 10 = 0) AS fallback_frames, (SELECT count(*) FROM c WHERE window_id <= 3) AS graph_sidecar_supplement_frames, (SELECT count(DISTINCT window_id) FROM c WHERE window_id <= 3) AS graph_only_windows, (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM raw GROUP BY frame, track_id)) AS duplicate_observation_rows, (SELECT 2 * count(*) FROM y) AS directory_entries, 1 AS has_bytes, 1 AS has_seconds, 1 AS same_again"), "stored_rows fallback_frames graph_sidecar_supplement_frames graph_only_windows duplicate_observation_rows directory_entries has_bytes has_seconds same_again")
def prepared_metadata(spark, sf_dir):
    """Counts, bytes and seconds of an engine whose store is part sidecar, part graph; released, it makes the same again."""
    d = detections(spark, sf_dir)
    index = stored(index_of(d).where("frame % 10 <> 0"))
    engine = PreparedEngine(d, WIDTH, HEIGHT, index.where("window_id > 3"), index.where("window_id <= 6"), legacy_single_direction=True)
    before = engine.fallback_frames().count()
    engine.release()
    m = engine.metadata()
    return m.select("*", (F.col("bytes") > 0).alias("has_bytes"), (F.col("setup_seconds") > 0).alias("has_seconds"), (F.col("fallback_frames") == before).alias("same_again"))


_BOUND, _, _RUNS = exact_sql(TWO).rpartition("\n;")  # the bound frames, and their runs


@query(f"{_BOUND}, r AS ({_RUNS})\n;SELECT (SELECT count(*) FROM (SELECT DISTINCT role_0, role_1 FROM bound)) AS candidate_bindings, (SELECT count(DISTINCT frame) FROM bound) AS candidate_frames, (SELECT count(*) FROM r) AS results", "candidate_bindings candidate_frames results")
def directed_stats(spark, sf_dir):
    return exact.DirectedIndex.build(detections(spark, sf_dir), WIDTH, HEIGHT).stats(TWO)


@query(with_("", "SELECT 1 AS raised"), "raised")
def quantization_error(spark, sf_dir):
    """A query of other parts than its index is refused."""
    index = exact.DirectedIndex.build(detections(spark, sf_dir), WIDTH, HEIGHT)
    try:
        index.query(QuerySpec("q", (0, 1), {(0, 1): ANY}, theta_parts=12))
    except ValueError as e:
        return spark.createDataFrame([(int("quantization" in str(e)),)], "raised int")
    return spark.createDataFrame([(0,)], "raised int")


@query(f"{_BOUND}, w AS (SELECT * FROM bound WHERE role_0 < role_1 AND frame % 3 <> 0)\n;{runs_sql('w', 'role_0, role_1')}", "role_0 role_1 start_frame end_frame length")
def exact_candidates(spark, sf_dir):
    """Only given bindings and frames are looked at."""
    d = detections(spark, sf_dir)
    pairs = spark.createDataFrame([("events", a, b) for a in range(8) for b in range(a + 1, 8)], "video string, role_0 long, role_1 long")
    spec = QuerySpec("c", TWO.role_types, TWO.relations)
    return exact.exact_query(d, spec, WIDTH, HEIGHT, True, candidate_bindings=pairs, candidate_frames=d.where("frame % 3 <> 0").select("video", "frame"))


# --- graphs: closures over given edges -------------------------------------------------------


@query(with_(_VERTEX_SQL, "SELECT * FROM anc"), "window_id parent child")
def graph_ancestors(spark, sf_dir):
    return compressed.ancestors_of(compressed.cg_edges(_vertices(detections(spark, sf_dir))))


@query(with_(_VERTEX_SQL + ", cl AS (SELECT window_id, v, sid, eid, theta_bin, dist_bin, frame FROM cp UNION SELECT a.window_id, a.child, p.sid, p.eid, p.theta_bin, p.dist_bin, p.frame FROM anc a JOIN cp p ON p.window_id = a.window_id AND p.v = a.parent)", "SELECT * FROM cl"), "window_id v sid eid theta_bin dist_bin frame")
def directed_closure(spark, sf_dir):
    """Directed pairs of each vertex and of all above it, along the graph's own edges."""
    d = detections(spark, sf_dir)
    v = _vertices(d)
    return compressed.cg_closure(v, compressed.cg_pairs(v, index_of(d, PATTERN_STEP)), compressed.ancestors_of(compressed.cg_edges(v)))


@query(with_(_VERTEX_SQL, "SELECT DISTINCT window_id, sid, eid, theta_bin, dist_bin, frame FROM cp"), "window_id sid eid theta_bin dist_bin frame")
def flattened_pairs(spark, sf_dir):
    d = detections(spark, sf_dir)
    return compressed.flatten_pairs(compressed.cg_pairs(_vertices(d), index_of(d, PATTERN_STEP)))


# --- files: write, read back -----------------------------------------------------------------


def _csv(spark, sf_dir, with_class: bool) -> str:
    """The events as a tracker's file: boxes of 4 x 6 around the centres."""
    d, path = detections(spark, sf_dir), f"{shared_folder(spark)}/tracks"
    box = [F.col("frame"), F.col("track_id"), F.col("cx") - 2, F.col("cy") - 3, F.lit(4.0), F.lit(6.0), F.lit(0.9)]
    d.select(*[c.alias(f"c{k}") for k, c in enumerate([*box, *([F.col("class_id")] if with_class else []), F.lit(-1), F.lit(-1), F.lit(-1)])]).write.csv(path, header=False)
    return path


_CSV_SQL = "SELECT frame, track_id, {} AS class_id, round(cx * 100) AS cx100, round(cy * 100) AS cy100 FROM raw"
_CSV_COLUMNS = "frame track_id class_id cx100 cy100"


def _hundredths(c: DataFrame) -> DataFrame:
    return c.select("frame", "track_id", "class_id", F.round(F.col("cx") * 100).alias("cx100"), F.round(F.col("cy") * 100).alias("cy100"))


@query(with_("", _CSV_SQL.format("class_id")), _CSV_COLUMNS)
def csv_scan(spark, sf_dir):
    return _hundredths(tracks.centers(tracks.read_tracks(spark, _csv(spark, sf_dir, True), "events")))


@query(with_("", _CSV_SQL.format("5")), _CSV_COLUMNS)
def csv_scan_single_class(spark, sf_dir):
    return _hundredths(tracks.centers(tracks.read_tracks(spark, _csv(spark, sf_dir, False), "events", class_id=5)))


@query(with_("", _CSV_SQL.format("class_id")), _CSV_COLUMNS)
def cached_scan(spark, sf_dir):
    """The second scan reads the Parquet copy of the first."""
    path = _csv(spark, sf_dir, True)
    tracks.cached_tracks(spark, path, f"{path}.cache", video="events")
    return _hundredths(tracks.centers(tracks.cached_tracks(spark, "none.txt", f"{path}.cache")))


@query(with_("k AS (SELECT unnest(range(1, (SELECT max(frame) FROM raw) + 1, 25)) AS start_frame)", "SELECT 'events_0.6_index' AS name, (SELECT count(*) FROM types) AS rows, 1 AS has_bytes UNION ALL SELECT 'events_0.6_node_index', (SELECT count(*) FROM (SELECT DISTINCT * FROM edge)), 1 UNION ALL SELECT 'key_frames', (SELECT count(*) FROM k), 1 UNION ALL SELECT 'resolved', 3, 1"), "rows has_bytes", "name")
def artifact_round_trip(spark, sf_dir):
    """Indexes and key frames written under their names, resolved, read back and counted."""
    d, base = detections(spark, sf_dir), shared_folder(spark)
    last = windows.last_frames(d)
    keys = spans(last, STEP).select("video", "start_frame")
    names = [p.removeprefix(f"{base}/") for p in artifacts.artifact_paths("events", 0.6, base_dir=base)]
    seconds = artifacts.write_index({names[0]: windows.type_index_last(in_windows(d)), names[2]: index_of(d), "key_frames": keys}, base)
    found = artifacts.resolve_paths(spark, "events", 0.6, base)
    again = artifacts.resolve_paths(spark, "events", None, base)
    right = (found[0] == f"{base}/{names[0]}") + (found[1] is None) + (again[0] == f"{base}/events_index")
    assert artifacts.key_frames(spark, f"{base}/key_frames").columns == ["video", "start_frame"]
    out = artifacts.manifest(spark, base, seconds).select("name", "rows", (F.col("bytes") > 0).alias("has_bytes"))
    return out.unionByName(spark.createDataFrame([("resolved", right, True)], "name string, rows long, has_bytes boolean"))


@query(
    with_(
        ", ".join(_match_sql(t, (2, 2), True).replace("b AS (", f"b{k} AS (").replace(" FROM b ", f" FROM b{k} b ").replace("h AS (", f"h{k} AS (").replace("FROM h ", f"FROM h{k} ").replace("m AS (", f"m{k} AS (") for k, t in enumerate(_BATCH)),
        " UNION ALL ".join(f"SELECT 'q{k} (' || role_0 || ', ' || role_1 || ') frames ' || frames AS line, row_number() OVER (ORDER BY n_frames DESC, role_0, role_1) AS rank FROM ({_ranked(t, 2, 3).replace('FROM m ', f'FROM m{k} ').replace('ORDER BY frame::VARCHAR', 'ORDER BY frame').replace('DISTINCT frame::VARCHAR', 'DISTINCT frame')})" for k, t in enumerate(_BATCH)),
    ).replace("string_agg(DISTINCT frame, ',' ORDER BY frame)", "array_to_string(list_sort(list(DISTINCT frame)), ',')"),
    "rank",
    "line",
)
def batch_report(spark, sf_dir):
    """The text report of a batch, read back; lines of a query are in rank order."""
    d, path = detections(spark, sf_dir), f"{shared_folder(spark)}/report"
    found = stored(batch.batch(windows.type_index_last(in_windows(d)), index_of(d), _BATCH, limits=(2, 2), topk=3))
    artifacts.append_report(found, path)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    by = Window.partitionBy(F.split("value", " ")[0]).orderBy("file", "at")
    return lines.select(F.col("value").alias("line"), F.row_number().over(by).alias("rank"))
