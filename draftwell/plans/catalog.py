"""Named queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import AnalysisConfig, ExecutionConfig
from ..functions import scalars as fn
from ..operators import buckets, detectors, grid, issues as iss, locate, profile, repair, snapshot, topology
from ..operators.vertices import vertices
from ..session import stored, table
from ..sources import adapter, hierarchy
from . import sql
from .analysis import Analysis
from .sql import with_

CONFIG = AnalysisConfig()
T = CONFIG.tolerance
START, END = grid.START, grid.END
QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "issue_summary"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return adapter.edges(spark, d)


def _layers(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.layer_records(_edges(spark, d), adapter.faces(spark, d), adapter.visible_layers(spark))


def _containers(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.container_counts(adapter.nodes(spark, d))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """The walk over containers alone."""
    return hierarchy.flatten(adapter.nodes(spark, d).where(F.col("kind").isin(*hierarchy.CONTAINERS)))


def _analysis(spark: SparkSession, d: str) -> Analysis:
    return Analysis(stored(_edges(spark, d)), adapter.faces(spark, d), _layers(spark, d), _containers(spark, d), CONFIG)


def _plan(spark: SparkSession, d: str):
    edges = stored(_edges(spark, d))
    derived = repair.derive(edges)
    return edges, derived, repair.propose(edges, derived, T.duplicate, "snap")


# ---- profile


@query(with_(sql.EDGES) + "SELECT edge_id, length FROM edges")
def edge_length(spark, d):
    return _edges(spark, d).select("edge_id", "length")


@query(with_(sql.EDGES, sql.VERTICES, sql.FACTS) + "SELECT * FROM box")
def bounding_box(spark, d):
    return profile.bounding_box(_edges(spark, d))


@query(with_(sql.EDGES) + "SELECT coalesce(min(least(sz, ez)), 0) AS z_min, coalesce(max(greatest(sz, ez)), 0) AS z_max FROM edges")
def z_range(spark, d):
    return profile.z_range(_edges(spark, d))


@query(with_(sql.EDGES) + "SELECT layer, count(*) AS edge_count FROM edges GROUP BY layer")
def layer_distribution(spark, d):
    return profile.layer_distribution(_edges(spark, d))


@query(with_(sql.EDGES) + "SELECT count(*) FILTER (abs(sz) > 1e-6 OR abs(ez) > 1e-6) AS nonzero_z_edges, CAST(sum((abs(sz) > 1e-6)::INT + (abs(ez) > 1e-6)::INT) AS BIGINT) AS nonzero_z_endpoints FROM edges")
def nonzero_z(spark, d):
    return profile.nonzero_z(_edges(spark, d), T.coordinate_epsilon)


@query(with_(sql.EDGES, sql.VERTICES, sql.FACTS) + "SELECT * FROM zv")
def z_vertices(spark, d):
    return profile.z_vertices(_edges(spark, d), T.coordinate_epsilon, T.big_z)


@query(with_(sql.EDGES, sql.VERTICES, sql.FACTS) + "SELECT * FROM large")
def large_coord_extrema(spark, d):
    return profile.large_extrema(_edges(spark, d), T.large_coordinate)


@query(with_(sql.EDGES, sql.VERTICES, sql.FACTS) + "SELECT * FROM warnings")
def preflight_warnings(spark, d):
    return _analysis(spark, d).warnings()


@query(
    with_(sql.EDGES, sql.VERTICES, sql.FACTS, sql.FACES)
    + """SELECT (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM vertices) AS vertex_count,
    (SELECT count(*) FROM edges WHERE abs(sz) > 1e-6 OR abs(ez) > 1e-6) AS nonzero_z_edges, (SELECT CAST(sum((abs(sz) > 1e-6)::INT + (abs(ez) > 1e-6)::INT) AS BIGINT) FROM edges) AS nonzero_z_endpoints,
    zv.*, large.*, (SELECT count(*) FROM faces) AS face_count, (SELECT count(*) FROM faces WHERE inner_loop_count > 0) AS faces_with_holes_count, containers.*, box.min_z AS z_min, box.max_z AS z_max,
    (SELECT count(*) FROM layers) AS layer_count FROM zv, large, containers, box"""
)
def preflight_report(spark, d):
    return _analysis(spark, d).report()


# ---- scalars

_NAMES = ["DIM-XX", "dim-xx", "TEXT-NOTES", "LABEL", "GUIDE-LINES", "XLINE", "Layer0", "default", "Untagged", "WEIRD-LAYER", "", "DIM-ANNO", "TEXT-DIM-XX", "EXTERIOR"]
_NAME_SQL = "names AS (SELECT k, ([" + ", ".join(f"'{n}'" for n in _NAMES) + "])[CAST(k % 14 + 1 AS INTEGER)] AS name FROM (SELECT o_orderkey AS k FROM orders))"


def _names(spark, d):
    k = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return k.select("k", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("k") % 14 + 1).cast("int")).alias("name"))


@query(
    with_(_NAME_SQL)
    + """SELECT k, name, CASE WHEN regexp_matches(name, '(?i)dim(ension)?') THEN 'dimension' WHEN regexp_matches(name, '(?i)(anno|t?ext|label)') THEN 'annotation'
    WHEN regexp_matches(name, '(?i)(guide|constr(uction)?|xline)') THEN 'guide' WHEN lower(name) IN ('layer0', 'default', 'untagged') THEN 'construction' ELSE 'unknown' END AS role,
    CASE WHEN regexp_matches(name, '(?i)dim') THEN 'name_dimension' WHEN regexp_matches(name, '(?i)(anno|ext|label)') THEN 'name_annotation'
    WHEN regexp_matches(name, '(?i)(guide|constr|xline)') THEN 'name_guide' WHEN lower(name) IN ('layer0', 'default', 'untagged') THEN 'name_default_layer' ELSE 'name_no_match' END AS role_rule FROM names"""
)
def layer_role(spark, d):
    return _names(spark, d).select("k", "name", fn.layer_role(F.col("name")).alias("role"), fn.layer_role_rule(F.col("name")).alias("role_rule"))


@query(with_(_NAME_SQL) + "SELECT k, CASE WHEN name = '' OR lower(name) IN ('layer0', 'default', 'untagged') THEN 'Layer0' ELSE name END AS norm_layer FROM names")
def layer_normalize(spark, d):
    return _names(spark, d).select("k", fn.normalized_layer(F.col("name")).alias("norm_layer"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'Visibility: unknown' WHEN 1 THEN 'Visible' ELSE 'Off-screen' END AS label FROM orders")
def visibility_label(spark, d):
    k = F.col("o_orderkey")
    shown, unknown = fn.visibility(F.when(k % 3 != 0, k % 3 == 1))
    return table(spark, d, "orders").select(k.alias("k"), fn.visibility_label(shown, unknown).alias("label"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'low' WHEN 'click' THEN 'high' ELSE 'medium' END AS severity FROM events")
def severity_map(spark, d):
    kind = F.when(F.col("event_type") == "view", "short_edge").when(F.col("event_type") == "click", "abnormal_large_coord").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", fn.severity(kind).alias("severity"))


@query("SELECT o_orderkey AS k, 'a' || chr(9) || 'b' || o_orderpriority || chr(10) AS message FROM orders")
def message_sanitize(spark, d):
    raw = F.concat(F.lit("a\x01\x1f\tb\x7f"), F.col("o_orderpriority"), F.lit("\x0b\n"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), fn.sanitized(raw).alias("message"))


@query(with_(sql.EDGES) + "SELECT edge_id, CAST(CAST(round(length * 10000) AS BIGINT) // 10000 AS VARCHAR) || '.' || lpad(CAST(CAST(round(length * 10000) AS BIGINT) % 10000 AS VARCHAR), 4, '0') || ' inch' AS display_length FROM edges")
def display_length(spark, d):
    return _edges(spark, d).select("edge_id", fn.display_length(F.col("length")).alias("display_length"))


_Q = lambda x: f"CAST(round({x} * CAST(10000.0 AS DOUBLE)) AS BIGINT)"
_P = lambda p, sep: f" || '{sep}' || ".join(_Q(f"{p}{c}") for c in "xyz")
KEY_SQL = f"'geom|' || CASE WHEN '[' || {_P('s', ', ')} || ']' <= '[' || {_P('e', ', ')} || ']' THEN {_P('s', ',')} || '|' || {_P('e', ',')} ELSE {_P('e', ',')} || '|' || {_P('s', ',')} END || '|layer=' || norm_layer"


@query(with_(sql.EDGES) + f"SELECT edge_id, {KEY_SQL} AS geometry_key FROM edges")
def canonical_geometry_key(spark, d):
    return _edges(spark, d).select("edge_id", fn.geometry_key([F.col(c) for c in START], [F.col(c) for c in END], F.col("layer")).alias("geometry_key"))


@query(with_(sql.EDGES) + "SELECT edge_id, CASE WHEN complete THEN 'occ-' ELSE 'transient-occ-' END || array_to_string(pid_path, '>') AS occurrence_id, array_to_string(pid_path, '.') AS path FROM edges")
def occurrence_id(spark, d):
    e = _edges(spark, d).select("edge_id", fn.occurrence_id(F.col("pid_path"), F.col("instance_path"), F.col("pid_path_complete"), F.col("edge_id")).alias("occurrence_id"))
    return e.select("*", fn.pid_path_text(fn.path_of_occurrence(F.col("occurrence_id"))).alias("path"))


@query(
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_orderkey % 4 AS VARCHAR) || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '.' END END || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS path,
    o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 AS complete, CAST(2 AS INTEGER) AS depth FROM orders"""
)
def structural_facts(spark, d):
    k = F.col("o_orderkey")
    ancestors, leaf = F.array(F.when(k % 4 != 0, k % 4)), F.when(k % 5 != 0, k)
    path, complete = fn.structural_path(ancestors, leaf)
    return table(spark, d, "orders").select(k.alias("k"), fn.pid_path_text(path).alias("path"), complete.alias("complete"), fn.structural_depth(F.array(F.lit(None).cast("bigint")), ancestors).alias("depth"))


@query(
    """SELECT o_orderkey AS k, CASE WHEN c AND NOT n THEN 'inst_path_leaf' WHEN c THEN 'inst_path_root' WHEN NOT n AND e THEN 'entity_id' ELSE 'skip' END AS kind,
    CASE WHEN c OR (NOT n AND e) THEN NULL WHEN n AND p THEN 'incomplete-nested-partial-leaf' WHEN n THEN 'incomplete-nested-partial-ancestry' ELSE 'fully-missing' END AS reason
    FROM (SELECT *, o_orderkey % 2 = 0 AS c, o_orderkey % 3 = 0 AS n, o_orderkey % 5 <> 0 AS e, o_orderkey % 7 <> 0 AS p FROM orders)"""
)
def locator_policy(spark, d):
    k = F.col("o_orderkey")
    path = F.when(k % 7 != 0, F.array(k)).otherwise(F.array().cast("array<bigint>"))
    kind, reason = fn.locator_target(path, F.when(k % 5 != 0, k), k % 3 == 0, k % 2 == 0)
    return table(spark, d, "orders").select(k.alias("k"), kind.alias("kind"), reason.alias("reason"))


# ---- detectors


@query(with_(sql.EDGES) + "SELECT edge_id, (sx + ex) / 2 AS lx, (sy + ey) / 2 AS ly, (sz + ez) / 2 AS lz, 'Short edge detected (length=' || printf('%.6f', length) || ' < threshold=0.5).' AS message FROM edges WHERE length < 0.5")
def short_edges(spark, d):
    return detectors.short_edges(_edges(spark, d), T.short_edge).select(F.get("edge_ids", F.lit(0)).alias("edge_id"), "lx", "ly", "lz", "message")


@query(with_(sql.EDGES, sql.PAIRS) + "SELECT id_a, id_b, kind FROM pairs")
def duplicate_pairs(spark, d):
    return grid.duplicate_pairs(_edges(spark, d), T.duplicate).select("id_a", "id_b", "kind")


@query(
    with_(sql.EDGES)
    + """SELECT a.edge_id AS id_a, b.edge_id AS id_b, CASE WHEN a.sx = b.sx AND a.sy = b.sy AND a.sz = b.sz AND a.ex = b.ex AND a.ey = b.ey AND a.ez = b.ez THEN 'forward' ELSE 'reversed' END AS kind
    FROM edges a JOIN edges b ON a.norm_layer = b.norm_layer AND a.sy = b.sy AND least(a.sx, a.ex) = least(b.sx, b.ex) AND greatest(a.sx, a.ex) = greatest(b.sx, b.ex) AND a.edge_id < b.edge_id
    WHERE (a.sx = b.sx AND a.sz = b.sz AND a.ex = b.ex AND a.ez = b.ez) OR (a.sx = b.ex AND a.sz = b.ez AND a.ex = b.sx AND a.ez = b.sz)"""
)
def duplicate_pairs_exact(spark, d):
    return grid.duplicate_pairs(_edges(spark, d), 0.0).select("id_a", "id_b", "kind")


@query(with_(sql.EDGES, sql.VERTICES) + "SELECT vertex_id, leader, x, y, z, degree FROM vertices")
def merged_vertices(spark, d):
    return vertices(_edges(spark, d), T.coordinate_epsilon).select("vertex_id", "leader", "x", "y", "z", "degree")


@query(with_(sql.EDGES, sql.VERTICES) + "SELECT vertex_id, edge_id, x, y, z FROM opens")
def open_endpoints(spark, d):
    return detectors.open_vertices(vertices(_edges(spark, d), T.coordinate_epsilon)).select("vertex_id", "edge_id", "x", "y", "z")


@query(with_(sql.EDGES, sql.VERTICES, sql.GAPS) + "SELECT v1, v2, e1, e2, d AS distance FROM gaps")
def gap_candidates(spark, d):
    vs = vertices(_edges(spark, d), T.coordinate_epsilon)  # stored with its positions
    found = grid.gap_pairs(detectors.open_vertices(vs), T.gap_search)
    return found.select(F.col("p_vertex_id").alias("v1"), F.col("q_vertex_id").alias("v2"), F.col("p_edge_id").alias("e1"), F.col("q_edge_id").alias("e2"), "distance")


# ---- issues

_ALL = [sql.EDGES, sql.VERTICES, sql.GAPS, sql.PAIRS, sql.FACTS]


@query(with_(*_ALL, sql.ISSUES) + "SELECT issue_type, severity, confidence, array_to_string(edge_ids, ',') AS edge_ids, message FROM raw")
def issues_normalized(spark, d):
    return _analysis(spark, d).normalized().select("issue_type", "severity", "confidence", fn.pid_path_text(F.col("edge_ids"), ",").alias("edge_ids"), "message")


@query(with_(*_ALL, sql.ISSUES) + "SELECT issue_id, issue_type, severity, layer_name, locatable, edges_text AS edge_ids FROM issues")
def issue_ids(spark, d):
    return _analysis(spark, d).issues.select("issue_id", "issue_type", "severity", "layer_name", "locatable", fn.pid_path_text(F.col("edge_ids"), ",").alias("edge_ids"))


@query(with_(*_ALL, sql.ISSUES) + "SELECT issue_type, count(*) AS issue_count, bool_or(severity = 'high') AS has_high FROM issues GROUP BY issue_type")
def issue_summary(spark, d):
    return iss.summary(_analysis(spark, d).counted)


_TYPE_RANK = "list_position([" + ", ".join(f"'{t}'" for t in fn.ISSUE_TYPES) + "], issue_type)"


@query(
    with_(*_ALL, sql.ISSUES)
    + f"""SELECT issue_type AS type, row_number() OVER (ORDER BY {_TYPE_RANK}) AS rank, n AS issue_count, CASE WHEN max(h::INT) OVER () = 1 THEN h ELSE row_number() OVER (ORDER BY {_TYPE_RANK}) = 1 END AS default_open
    FROM (SELECT issue_type, count(*) AS n, bool_or(severity = 'high') AS h FROM issues GROUP BY issue_type)"""
)
def issue_groups(spark, d):
    return iss.groups(_analysis(spark, d).counted).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    with_(*_ALL, sql.ISSUES)
    + """SELECT layer_name AS name, n AS issue_count, CASE WHEN max(h::INT) OVER () = 1 THEN h ELSE false END AS default_open FROM (SELECT layer_name, count(*) AS n, bool_or(severity = 'high') AS h FROM issues GROUP BY layer_name)"""
)
def issues_by_layer(spark, d):
    layers = _layers(spark, d).select("name", F.col("role_rank").alias("display_rank"))
    return iss.layer_groups(_analysis(spark, d).counted, layers).select("name", "issue_count", "default_open")


_LAYER_RANK = "CASE layer_name WHEN 'DIM-A' THEN 1 WHEN 'TEXT-N' THEN 2 WHEN 'XLINE' THEN 3 WHEN 'WALL' THEN 6 WHEN 'Layer0' THEN 4 ELSE 5 END"


def _chunks(name: str, rank: str) -> str:
    """SQL twin of buckets cut into chunks of a hundred issues, with every field of an issue."""
    text = "issue_id || '~' || issue_type || '~' || severity || '~' || confidence || '~' || edges_text || '~' || layer_name || '~' || CASE WHEN locatable THEN 'true' ELSE 'false' END || '~' || message"
    return with_(*_ALL, sql.ISSUES) + f"""SELECT name, dense_rank() OVER (ORDER BY rk) AS rank, issue_count, default_open, chunk, chunk * 100 AS first_position, count(*) AS held, string_agg(line, chr(10) ORDER BY place) AS issues
    FROM (SELECT {name} AS name, {rank} AS rk, count(*) OVER b AS issue_count, CASE WHEN max((severity = 'high')::INT) OVER () = 1 THEN max((severity = 'high')::INT) OVER b = 1 ELSE {rank} = min({rank}) OVER () END AS default_open,
      row_number() OVER (PARTITION BY {name} ORDER BY issue_id) - 1 AS place, (row_number() OVER (PARTITION BY {name} ORDER BY issue_id) - 1) // 100 AS chunk, {text} AS line FROM issues WINDOW b AS (PARTITION BY {name}))
    GROUP BY name, rk, issue_count, default_open, chunk"""


_LINE = ["issue_id", "issue_type", "severity", "confidence", "edge_ids", "layer_name", "locatable", "message"]


def _lines(chunks: DataFrame) -> DataFrame:
    line = lambda i: F.concat_ws("~", i["issue_id"], i["issue_type"], i["severity"], i["confidence"], fn.pid_path_text(i["edge_ids"], ","), i["layer_name"], i["locatable"].cast("string"), i["message"])
    return chunks.withColumn("held", F.size("issues").cast("bigint")).withColumn("issues", F.array_join(F.transform("issues", line), "\n")).withColumn("rank", F.col("rank").cast("bigint"))


@query(_chunks("issue_type", _TYPE_RANK))
def issue_buckets(spark, d):
    return _lines(buckets.type_buckets(_analysis(spark, d).issues.select(*_LINE), size=100))


@query(_chunks("layer_name", _LAYER_RANK))
def layer_issue_buckets(spark, d):
    shown = _layers(spark, d)
    place = F.col("role_rank") * 2 + F.when(F.col("visible"), 0).otherwise(1)
    return _lines(buckets.layer_buckets(_analysis(spark, d).issues.select(*_LINE), shown.select("name", place.alias("display_rank")), size=100))


@query(
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'non-canonical severity: urgent' WHEN event_id % 7 = 0 THEN 'non-canonical confidence: nil' WHEN event_id % 11 = 0 THEN 'issue_type must be a non-empty String'
    WHEN event_id % 17 = 0 THEN 'sources must be an Array' WHEN event_id % 19 = 0 THEN 'source_entity_ids must be an Array' WHEN event_id % 23 = 0 THEN 'location must be nil or [x, y, z]' ELSE 'locatable must be a Boolean' END AS reason
    FROM events WHERE event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0"""
)
def issue_rejects(spark, d):
    k = F.col("event_id")
    rows = table(spark, d, "events").select(
        "event_id", F.when(k % 5 == 0, "urgent").otherwise("low").alias("severity"), F.when(k % 7 != 0, "high").alias("confidence"), F.when(k % 11 == 0, "").otherwise("short_edge").alias("issue_type"),
        k.cast("string").alias("issue_id"), F.array(k).alias("edge_ids"), F.lit("m").alias("message"), F.when(k % 13 != 0, F.lit(True)).alias("locatable"),
        F.when(k % 17 != 0, F.array(k)).alias("sources"), F.when(k % 19 != 0, F.array(k)).alias("source_entity_ids"), F.when(k % 23 == 0, F.array(F.lit(1.0))).alias("location"),
        F.create_map(F.lit("a"), F.lit("b")).alias("metadata"), F.lit(None).cast("string").alias("display_length"),
    )
    return iss.registry(rows)[1].select("event_id", "reason")


@query(
    with_(*_ALL, sql.ISSUES, sql.FACES)
    + """SELECT name, edge_count, face_count, faces_with_holes_count, role, role_rule, CASE WHEN visibility_unknown THEN 'Visibility: unknown' WHEN visible THEN 'Visible' ELSE 'Off-screen' END AS visibility, coalesce(n, 0) AS issue_count,
    row_number() OVER (ORDER BY role_rank, NOT visible, -coalesce(n, 0), name) AS position FROM layers LEFT JOIN (SELECT layer_name, count(*) AS n FROM issues GROUP BY layer_name) ON layer_name = name"""
)
def layer_summary(spark, d):
    from pyspark.sql import Window

    counts = _analysis(spark, d).counted.groupBy(F.col("layer_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    rows = _layers(spark, d).join(counts, "name", "left").withColumn("issue_count", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy(F.lit(0)).orderBy("role_rank", ~F.col("visible"), -F.col("issue_count"), "name")  # one row a layer
    return rows.select("name", "edge_count", "face_count", "faces_with_holes_count", "role", "role_rule", fn.visibility_label(F.col("visible"), F.col("visibility_unknown")).alias("visibility"), "issue_count", F.row_number().over(order).cast("bigint").alias("position"))


@query(with_(*_ALL, sql.ISSUES) + "SELECT issue_id, issue_type, message FROM issues WHERE issue_type = 'abnormal_large_coord'")
def find_issue(spark, d):
    return _analysis(spark, d).find("abnormal_large_coord||1").select("issue_id", "issue_type", "message")


_FOUR = lambda x: f"CAST(CAST(round({x} * 10000) AS BIGINT) // 10000 AS VARCHAR) || '.' || lpad(CAST(CAST(round({x} * 10000) AS BIGINT) % 10000 AS VARCHAR), 4, '0') || ' inch'"


@query(
    with_(*_ALL, sql.ISSUES)
    + f"""SELECT issue_id, issue_type AS type, severity, confidence, '[' || edges_text || ']' AS edges, layer_name AS layer, CASE WHEN locatable THEN 'true' ELSE 'false' END AS locatable, message,
    CASE issue_type WHEN 'short_edge' THEN {_FOUR("(SELECT any_value(length) FROM edges e WHERE e.edge_id = i.edge_ids[1])")} WHEN 'gap_candidate' THEN {_FOUR("gap")} END AS display_length,
    CASE WHEN lx IS NULL THEN 0 ELSE 3 END AS coordinates FROM issues i"""
)
def issue_documents(spark, d):
    doc = lambda path: F.get_json_object("document", f"$.{path}")
    rows = _analysis(spark, d).as_json()
    return rows.select(
        "issue_id", doc("issue_type").alias("type"), doc("severity").alias("severity"), doc("confidence").alias("confidence"), doc("edge_ids").alias("edges"), doc("layer_name").alias("layer"), doc("locatable").alias("locatable"),
        doc("message").alias("message"), doc("display_length").alias("display_length"), F.coalesce(F.json_array_length(doc("location")), F.lit(0)).alias("coordinates"),
    )


# ---- hierarchy


@query(
    """SELECT k, r * 10000 + 2.0 * (k % 5) AS sx, n * 100 + 2.0 * (k % 3) AS sy, CAST(c % 10 AS DOUBLE) AS sz, r * 10000 + 2.0 * (k % 5 + 1) AS ex,
    (r + 1) || '.' || (n + 100) || '.' || (c + 1000000) || CASE WHEN k % 97 <> 0 THEN '.' || (k + 1000000000) ELSE '' END AS path, k % 97 <> 0 AS complete, CAST(3 AS INTEGER) AS depth
    FROM (SELECT o.o_orderkey AS k, c.c_custkey AS c, CAST(c.c_nationkey AS BIGINT) AS n, CAST(t.n_regionkey AS BIGINT) AS r
      FROM customer c JOIN orders o ON o.o_custkey = CASE WHEN c.c_custkey % 4 = 3 THEN c.c_custkey - 2 ELSE c.c_custkey END JOIN nation t ON t.n_nationkey = c.c_nationkey)
    WHERE k % 11 <> 0 AND k % 13 <> 0 AND n <> 7"""
)
def world_edges(spark, d):
    occ = hierarchy.flatten(adapter.nodes(spark, d))
    return hierarchy.world_edges(occ).select((F.col("edge_id") - 1000000000).alias("k"), "sx", "sy", "sz", "ex", fn.pid_path_text(F.col("pid_path")).alias("path"), F.col("pid_path_complete").alias("complete"), F.col("structural_depth").alias("depth"))


@query(
    """SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation WHERE n_nationkey <> 7) + (SELECT count(*) FROM customer WHERE c_nationkey <> 7 AND c_custkey % 2 = 0) AS group_count,
    (SELECT count(*) FROM customer WHERE c_nationkey <> 7 AND c_custkey % 2 = 1) AS component_count, CAST(3 AS BIGINT) AS deepest_nesting"""
)
def container_facts(spark, d):
    return hierarchy.container_counts(adapter.nodes(spark, d))


# How the adapter names shared definitions; every fifth has no name.
_PLACED = """
placed AS (
  SELECT c_custkey AS c, n_nationkey AS n, n_regionkey AS r, CASE WHEN c_custkey % 2 = 1 THEN CASE WHEN c_custkey % 4 = 3 THEN c_custkey - 2 ELSE c_custkey END + 5000000 END AS def
  FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey <> 7),
boxes AS (
  SELECT CAST(r_regionkey + 1 AS BIGINT) AS node_id, 'group' AS kind, 'Group:Region ' || r_regionkey AS label, 'Group:Region ' || r_regionkey AS path_text, CAST(r_regionkey + 1 AS VARCHAR) AS pid_text FROM region
  UNION ALL SELECT n_nationkey + 100, 'group', 'Group:Nation ' || n_nationkey, 'Group:Region ' || n_regionkey || ' > Group:Nation ' || n_nationkey, (n_regionkey + 1) || '/' || (n_nationkey + 100) FROM nation WHERE n_nationkey <> 7
  UNION ALL SELECT c + 1000000, CASE WHEN def IS NULL THEN 'group' ELSE 'instance' END, l, 'Group:Region ' || r || ' > Group:Nation ' || n || ' > ' || l, (r + 1) || '/' || (n + 100) || '/' || (c + 1000000)
  FROM (SELECT *, CASE WHEN def IS NULL THEN 'Group:Customer ' || c ELSE 'ComponentInstance:' || CASE WHEN def % 5 = 0 THEN 'Customer ' || c ELSE 'Block ' || def END || '#0x' || printf('%x', c + 1000000) END AS l FROM placed))
"""


def _labelled_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The containers as they are placed, under the labels that tell instances of one definition apart."""
    boxes = adapter.nodes(spark, d).where(F.col("kind").isin(*hierarchy.CONTAINERS))
    return hierarchy.flatten(hierarchy.labelled(boxes, adapter.definitions(spark, d)))


@query(with_(_PLACED) + "SELECT node_id, kind, label, path_text, pid_text FROM boxes")
def container_labels(spark, d):
    return _labelled_boxes(spark, d).select("node_id", "kind", F.col("name").alias("label"), fn.instance_path_text(F.col("labels")).alias("path_text"), fn.pid_path_text(F.col("path"), "/").alias("pid_text"))


@query(
    with_(
        _PLACED, "lines AS (SELECT sha256(kind || '|' || pid_text || '|' || replace(path_text, ' > ', '>') || '|') AS h FROM boxes)",
        "w AS (SELECT count(*) AS n, " + ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {1 + 8 * k}, 8))::UBIGINT AS HUGEINT)) AS VARCHAR) AS w{k}" for k in range(4)) + " FROM lines)",
    )
    + "SELECT n AS entries, sha256(concat_ws(',', CAST(n AS VARCHAR), w0, w1, w2, w3)) AS digest FROM w"
)
def selection_scope(spark, d):
    return snapshot.selection_digest(snapshot.selection_scope(_labelled_boxes(spark, d)))


@query(
    "SELECT count(DISTINCT p_brand || '/' || p_type) AS materials, sha256(string_agg(DISTINCT p_brand || '/' || p_type, chr(10) ORDER BY p_brand || '/' || p_type)) AS digest FROM part"
)
def material_digest(spark, d):
    names = table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("name")).distinct()
    return names.agg(F.count(F.lit(1)).alias("materials")).crossJoin(snapshot.material_digest(names))


@query("SELECT 'group' AS selection_type")
def selection_type(spark, d):
    return hierarchy.selection_type(adapter.nodes(spark, d).where("parent_id IS NULL"))


@query(
    with_(sql.EDGES, sql.FACES)
    + """SELECT name, face_count, faces_with_holes_count, upper(role[1]) || role[2:] AS role_label, row_number() OVER (ORDER BY role_rank, NOT visible, name) AS position FROM layers WHERE face_count > 0"""
)
def face_inventory(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy(F.lit(0)).orderBy("role_rank", ~F.col("visible"), "name")  # one row a layer
    return _layers(spark, d).where("face_count > 0").select("name", "face_count", "faces_with_holes_count", fn.role_label(F.col("role")).alias("role_label"), F.row_number().over(order).cast("bigint").alias("position"))


@query(
    with_(*_ALL, sql.ISSUES)
    + """SELECT issue_id, kind, target FROM (SELECT issue_id, CASE WHEN ca THEN 'inst_path_root' ELSE 'skip' END AS kind, CASE WHEN ca THEN array_to_string(pa, '.') END AS target FROM issues WHERE locatable AND len(edge_ids) > 0
    UNION ALL SELECT issue_id, CASE WHEN cb THEN 'inst_path_root' ELSE 'skip' END, CASE WHEN cb THEN array_to_string(pb, '.') END FROM issues WHERE locatable AND len(edge_ids) > 1 AND edge_ids[2] <> edge_ids[1])"""
)
def locate_targets(spark, d):
    rows = _analysis(spark, d).issues.where("locatable").select("issue_id", F.explode("sources").alias("t"))
    kind, _ = fn.locator_target(F.col("t.pid_path"), F.col("t.entity_id"), F.col("t.nested"), F.col("t.pid_path_complete"))
    return rows.select("issue_id", kind.alias("kind"), F.when(kind != "skip", fn.pid_path_text(F.col("t.pid_path"))).alias("target"))


_ROOT = "FROM issues WHERE locatable AND {c} AND EXISTS (SELECT 1 FROM region WHERE r_regionkey + 1 = {p}[1])"


@query(with_(*_ALL, sql.ISSUES) + "SELECT issue_id, pa[1] AS entity " + _ROOT.format(c="ca", p="pa") + " UNION SELECT issue_id, pb[1] " + _ROOT.format(c="cb", p="pb"))
def located_entities(spark, d):
    return locate.locate(_analysis(spark, d).issues, _edges(spark, d), _roots(spark, d))[0]


def _roots(spark, d):
    return _boxes(spark, d).where("depth = 0").select(F.col("node_id").alias("entity"), F.col("path").alias("pid_path"))


@query(with_(*_ALL, sql.ISSUES) + "SELECT issue_id, 'incomplete-nested-partial-leaf' AS reason FROM issues WHERE locatable AND (NOT ca OR (NOT cb AND edge_ids[2] <> edge_ids[1]))")
def unresolved_targets(spark, d):
    return locate.locate(_analysis(spark, d).issues, _edges(spark, d), _roots(spark, d))[1]


# ---- topology and repair

_REPAIR = with_(sql.EDGES, sql.PAIRS, sql.COMPONENTS, recursive=True)


@query(_REPAIR + "SELECT node, component, members, pairs, required, repairable FROM nodes")
def duplicate_components(spark, d):
    return topology.edge_components(stored(_edges(spark, d).where("pid_path_complete")), T.duplicate)


@query(
    _REPAIR
    + """SELECT CAST(sum(pairs) AS BIGINT) AS direct_pairs, CAST(sum(members) AS BIGINT) AS edges_in_pairs, count(*) FILTER (repairable) AS repairable_components, count(*) FILTER (NOT repairable) AS non_transitive_components
    FROM (SELECT DISTINCT component, members, pairs, repairable FROM nodes)"""
)
def topology_metrics(spark, d):
    return topology.metrics(duplicate_components(spark, d))


@query(
    with_(
        sql.EDGES, sql.PAIRS, sql.COMPONENTS.replace("FROM pairs WHERE complete", "FROM pairs"),
        "adj AS (SELECT u, v FROM links l JOIN nodes n ON n.node = l.u WHERE NOT n.repairable)",
        """grown AS (SELECT component, [node] AS clique FROM nodes WHERE NOT repairable
      UNION ALL SELECT g.component, list_append(g.clique, a.v) FROM grown g JOIN adj a ON a.u = g.clique[len(g.clique)] AND a.v > a.u
      WHERE (SELECT count(*) FROM adj b WHERE b.u = a.v AND list_contains(g.clique, b.v)) = len(g.clique))""",
        recursive=True,
    )
    + """SELECT component, array_to_string(clique, ',') AS clique FROM grown g
    WHERE NOT EXISTS (SELECT 1 FROM adj b WHERE list_contains(g.clique, b.v) AND NOT list_contains(g.clique, b.u) GROUP BY b.u HAVING count(*) = len(g.clique))"""
)
def maximal_cliques(spark, d):
    pairs = stored(grid.duplicate_pairs(_edges(spark, d), T.duplicate).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    found = topology.maximal_cliques(pairs, topology.components(pairs))
    return found.select("component", fn.pid_path_text(F.col("clique"), ",").alias("clique"))


@query(_REPAIR + "SELECT derived_id, survivor, derived_id = survivor AS survives FROM members")
def survivors(spark, d):
    _, _, plan = _plan(spark, d)
    return plan.members.select("derived_id", "survivor", (F.col("derived_id") == F.col("survivor")).alias("survives"))


@query(
    _REPAIR
    + f"""SELECT m.survivor, string_agg(DISTINCT m.derived_id, '+' ORDER BY m.derived_id) AS member_ids, string_agg(DISTINCT m.occ, ',' ORDER BY m.occ) AS provenance, count(*) - 1 AS duplicate_pairs,
    CASE WHEN any_value(k.kind) = 'reversed' THEN 'reversed_endpoint_match_within_tolerance.duplicate' ELSE 'exact_endpoint_match_within_tolerance.duplicate' END AS basis,
    'act-duplicate_edge.exact_remove-' || substr(sha256('duplicate_edge.exact_remove|snap|' || any_value(k.geometry_key) || '|' || string_agg(DISTINCT m.derived_id, '+' ORDER BY m.derived_id)), 1, 12) AS action_id
    FROM members m JOIN (SELECT s.derived_id AS survivor, arg_min(p.kind, o.derived_id) AS kind, any_value(s.geometry_key) AS geometry_key
      FROM (SELECT derived_id, edge_id, {KEY_SQL} AS geometry_key FROM derived JOIN edges USING (edge_id)) s
      JOIN (SELECT id_a AS x, id_b AS y, kind FROM good UNION ALL SELECT id_b, id_a, kind FROM good) p ON p.x = s.edge_id JOIN derived o ON o.edge_id = p.y GROUP BY s.derived_id) k USING (survivor)
    GROUP BY m.survivor"""
)
def repair_actions(spark, d):
    _, _, plan = _plan(spark, d)
    ids = F.array_sort(F.concat("affected_derived_ids", F.array("survivor")))
    return plan.actions.select("survivor", F.array_join(ids, "+").alias("member_ids"), F.array_join("source_occurrence_ids", ",").alias("provenance"), "duplicate_pairs", F.col("confidence_basis").alias("basis"), "action_id")


@query(
    _REPAIR
    + """SELECT id_a || '+' || id_b AS component, 'incomplete_nested_provenance' AS reason, '' AS detail FROM pairs WHERE NOT complete
    UNION ALL SELECT DISTINCT CAST(component AS VARCHAR), 'non_transitive_duplicate_component', 'members=' || members || ' direct=' || pairs || ' required=' || required || ' missing=' || (required - pairs) FROM nodes WHERE NOT repairable"""
)
def repair_skipped(spark, d):
    _, _, plan = _plan(spark, d)
    return plan.skipped.select("component", "reason", "detail")


@query(
    _REPAIR
    + """SELECT d.derived_id, coalesce(u.provenance, d.occ) AS provenance FROM derived d LEFT JOIN (SELECT survivor, string_agg(DISTINCT occ, ',' ORDER BY occ) AS provenance FROM members GROUP BY survivor) u ON u.survivor = d.derived_id
    WHERE d.derived_id NOT IN (SELECT derived_id FROM members WHERE derived_id <> survivor)"""
)
def post_inventory(spark, d):
    _, derived, plan = _plan(spark, d)
    gone, rows = repair.delta(derived, stored(plan.actions))  # read as a stored version is: base, deletes, replacements
    return repair.merged(derived, [(stored(gone), stored(rows))]).select("derived_id", F.array_join("source_occurrence_ids", ",").alias("provenance"))


@query("SELECT unnest(['A_inventory_is_partitioned', 'B_removed_are_gone', 'C_survivors_remain', 'D_provenance_not_empty', 'E_provenance_keys_match', 'F_provenance_is_exact', 'G_one_survivor_an_action', 'H_survivor_never_removed', 'I_no_residual_pairs']) AS invariant, CAST(0 AS BIGINT) AS violations")
def post_state_invariants(spark, d):
    _, derived, plan = _plan(spark, d)
    actions = stored(plan.actions)
    return repair.invariants(derived, stored(repair.post_inventory(derived, actions)), actions, T.duplicate)


@query(
    _REPAIR
    + """SELECT (SELECT count(DISTINCT survivor) FROM members) AS applied, (SELECT count(*) FROM pairs WHERE NOT complete) + (SELECT count(DISTINCT component) FROM nodes WHERE NOT repairable) AS skipped,
    (SELECT count(*) FROM edges) AS edges_before, (SELECT count(*) FROM edges) - (SELECT count(*) FROM members WHERE derived_id <> survivor) AS edges_after, (SELECT count(*) FROM pairs) AS pairs_before,
    (SELECT count(*) FROM pairs WHERE id_a NOT IN (SELECT node FROM members WHERE derived_id <> survivor) AND id_b NOT IN (SELECT node FROM members WHERE derived_id <> survivor)) AS pairs_after,
    CAST(0 AS BIGINT) AS failed, 'captured' AS tolerance_status"""
)
def repair_summary(spark, d):
    _, derived, plan = _plan(spark, d)
    plan = repair.Plan(stored(plan.actions), plan.skipped, plan.members)
    return repair.summary(derived, stored(repair.post_inventory(derived, plan.actions)), plan, T.duplicate)


@query(
    with_(*_ALL, sql.ISSUES, sql.COMPONENTS, recursive=True)
    + """SELECT m.survivor AS survivor_derived_id, 'applied' AS status, CAST(count(*) - 1 AS BIGINT) AS removed_count, CAST(count(DISTINCT m.occ) AS BIGINT) AS source_occurrence_count, NULL AS reason,
    (SELECT string_agg(i.issue_id, ',' ORDER BY i.issue_id) FROM issues i JOIN nodes n ON n.node = i.edge_ids[1] WHERE i.issue_type = 'duplicate_edge_candidate' AND i.ca AND i.cb AND n.component = m.component) AS issue_ids,
    printf('""" + repair.EXPLANATION + """', any_value(k.kind) || ' exact', count(*), count(*) - 1, count(DISTINCT m.occ)) AS explanation
    FROM members m JOIN (SELECT s.derived_id AS survivor, arg_min(p.kind, o.derived_id) AS kind FROM derived s
      JOIN (SELECT id_a AS x, id_b AS y, kind FROM good UNION ALL SELECT id_b, id_a, kind FROM good) p ON p.x = s.edge_id JOIN derived o ON o.edge_id = p.y GROUP BY s.derived_id) k USING (survivor)
    GROUP BY m.survivor, m.component
    UNION ALL SELECT NULL, 'skipped', 0, 0, 'incomplete_nested_provenance', issue_id, '' FROM issues WHERE issue_type = 'duplicate_edge_candidate' AND NOT (ca AND cb)
    UNION ALL SELECT NULL, 'skipped', 0, 0, 'non_transitive_duplicate_component', (SELECT string_agg(i.issue_id, ',' ORDER BY i.issue_id) FROM issues i JOIN nodes x ON x.node = i.edge_ids[1] WHERE i.issue_type = 'duplicate_edge_candidate' AND i.ca AND i.cb AND x.component = n.component),
      'members=' || any_value(n.members) || ' direct=' || any_value(n.pairs) || ' required=' || any_value(n.required) || ' missing=' || (any_value(n.required) - any_value(n.pairs)) FROM nodes n WHERE NOT repairable GROUP BY component"""
)
def repair_audit(spark, d):
    analysis = _analysis(spark, d)
    plan = repair.propose(analysis.edges, repair.derive(analysis.edges), T.duplicate, "snap", repair.claims_of(analysis.duplicates))
    rows = repair.audit_rows(plan)
    return rows.select("survivor_derived_id", "status", "removed_count", "source_occurrence_count", "reason", F.array_join("issue_ids", ",").alias("issue_ids"), "explanation")


@query(
    with_(
        sql.EDGES, sql.PAIRS, "states AS (SELECT edge_id, edge_id % 3 = 0 AND edge_id % 4 = 0 AS gone, edge_id % 35 = 1 AS twice, edge_id % 41 = 2 AS missing, edge_id % 43 = 3 AS erased, edge_id % 5 = 4 AS alias FROM edges)",
        "counts AS (SELECT edge_id, CASE WHEN gone THEN 0 WHEN twice THEN 2 ELSE 1 END AS c FROM states)",
        "judged AS (SELECT p.*, CASE WHEN NOT p.complete THEN 'incomplete_nested_provenance' WHEN x.c + y.c = 0 OR (x.c > 0)::INT + (y.c > 0)::INT <> x.c + y.c THEN 'no_derived_records_resolve_to_issue_source_edges' WHEN x.c + y.c < 2 THEN 'incomplete_nested_provenance' END AS why FROM pairs p JOIN counts x ON x.edge_id = p.id_a JOIN counts y ON y.edge_id = p.id_b)",
        sql.COMPONENTS.replace("FROM pairs WHERE complete", "FROM judged WHERE why IS NULL"),
        "final AS (SELECT n.component, any_value(n.repairable) AS whole, bool_or(s.missing) AS missing, bool_or(s.erased) AS erased, count(DISTINCT CASE WHEN s.alias THEN -1 ELSE s.edge_id END) < count(*) AS alias FROM nodes n JOIN states s ON s.edge_id = n.node GROUP BY n.component)",
        recursive=True,
    )
    + """SELECT id_a || '+' || id_b AS component, why AS reason FROM judged WHERE why IS NOT NULL
    UNION ALL SELECT * FROM (SELECT CAST(component AS VARCHAR), CASE WHEN NOT whole THEN 'non_transitive_duplicate_component' WHEN missing THEN 'host_handle_missing' WHEN erased THEN 'host_handle_invalidated' WHEN alias THEN 'host_handle_aliasing' END AS reason FROM final) WHERE reason IS NOT NULL"""
)
def repair_reasons(spark, d):
    """A workspace that drifted: rows gone, doubled, without a handle, with a dead one, with one that others have, too."""
    edges = stored(_edges(spark, d))
    k = F.col("edge_id")
    rows = repair.derive(edges).where(~((k % 3 == 0) & (k % 4 == 0)))
    rows = rows.withColumn("handle_state", F.when(k % 41 == 2, F.lit(None)).when(k % 43 == 3, "erased").otherwise("live")).withColumn("handle_id", F.when(k % 5 == 4, "shared").otherwise(F.col("handle_id")))
    again = rows.where(k % 35 == 1).withColumn("derived_id", F.concat("derived_id", F.lit("-again")))
    plan = repair.propose(edges, stored(rows.unionByName(again)), T.duplicate, "snap")
    return plan.skipped.select("component", "reason")


# ---- snapshots


@query(
    with_(sql.EDGES, sql.VERTICES, sql.FACTS, sql.FACES)
    + """SELECT (SELECT count(*) FROM edges) AS edge_count, (SELECT CAST(sum(CAST(round(length * 1e9) AS BIGINT)) AS BIGINT) FROM edges) AS edge_length_sum_e9, (SELECT count(*) FROM faces) AS face_count,
    (SELECT CAST(sum(outer_loop_vertex_count) AS BIGINT) FROM faces) AS face_vertex_count_sum, (SELECT count(*) FROM layers) AS layer_count,
    (SELECT sha256(string_agg(name || '|' || CASE WHEN visible THEN 'true' ELSE 'false' END || '|' || edge_count || '|' || face_count, chr(10) ORDER BY name || '|' || CASE WHEN visible THEN 'true' ELSE 'false' END || '|' || edge_count || '|' || face_count)) FROM layers) AS layer_digest,
    CAST(round(max_x * 1e6) AS BIGINT) AS max_x_e6, CAST(round(min_x * 1e6) AS BIGINT) AS min_x_e6 FROM box"""
)
def source_fingerprint(spark, d):
    row = snapshot.source_fingerprint(_edges(spark, d), adapter.faces(spark, d), _layers(spark, d))
    return row.select("edge_count", "edge_length_sum_e9", "face_count", "face_vertex_count_sum", "layer_count", "layer_digest", "max_x_e6", "min_x_e6")


_E6 = lambda c: f"CAST(CAST(round({c} * CAST(1000000.0 AS DOUBLE)) AS BIGINT) AS VARCHAR)"
_CONFIG_DIGEST = ExecutionConfig.from_config(CONFIG).digest()


@query(
    with_(
        sql.EDGES,
        "d AS (SELECT sha256(concat_ws('|', 'der-edge-' || edge_id || '-' || array_to_string(pid_path, '-'), 'edge', CASE WHEN complete THEN 'occ-' ELSE 'transient-occ-' END || array_to_string(pid_path, '>'), "
        + ", ".join(_E6(f"{p}{c}") for p in "se" for c in "xyz")
        + ", layer, '')) AS h FROM edges)",
        "w AS (SELECT count(*) AS n, " + ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {1 + 8 * k}, 8))::UBIGINT AS HUGEINT)) AS VARCHAR) AS w{k}" for k in range(4)) + " FROM d)",
        "e AS (SELECT n, sha256(concat_ws(',', CAST(n AS VARCHAR), w0, w1, w2, w3)) AS g FROM w)",
    )
    + f"SELECT n AS entity_count, n AS edge_entities, g AS entities_digest, sha256(concat_ws('|', '{_CONFIG_DIGEST}', CAST(n AS VARCHAR), g)) AS fingerprint FROM e"
)
def workspace_fingerprint(spark, d):
    return snapshot.workspace_fingerprint(repair.derive(_edges(spark, d)), ExecutionConfig.from_config(CONFIG).digest())


@query(
    with_(
        sql.EDGES, "d AS (SELECT sha256('der-edge-' || edge_id || '-' || array_to_string(pid_path, '-') || '|der-layer-' || layer) AS h FROM edges)",
        "w AS (SELECT count(*) AS n, " + ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {1 + 8 * k}, 8))::UBIGINT AS HUGEINT)) AS VARCHAR) AS w{k}" for k in range(4)) + " FROM d)",
    )
    + "SELECT 'edge' AS kind, n AS entities, n AS with_parent, sha256(concat_ws(',', CAST(n AS VARCHAR), w0, w1, w2, w3)) AS parents_digest FROM w"
)
def workspace_relations(spark, d):
    derived = repair.derive(_edges(spark, d)).withColumn("parent_derived_id", F.concat(F.lit("der-layer-"), F.col("layer")))
    return snapshot.workspace_relations(derived)


@query("SELECT 'default' AS profile_id, 'tol-big_z-coordinate_epsilon-duplicate-gap_search-large_coordinate-short_edge' AS tolerance_schema_version, unnest(['big_z', 'coordinate_epsilon', 'duplicate', 'gap_search', 'large_coordinate', 'short_edge']) AS name, unnest([CAST(0.01 AS DOUBLE), CAST(1e-6 AS DOUBLE), CAST(1e-4 AS DOUBLE), CAST(0.1 AS DOUBLE), CAST(1e6 AS DOUBLE), CAST(0.5 AS DOUBLE)]) AS value")
def execution_config(spark, d):
    c = ExecutionConfig.from_config(CONFIG)
    rows = [(c.profile_id, c.schema_version, k, float(v)) for k, v in sorted(c.tolerances.items())]
    return spark.createDataFrame(rows, "profile_id string, tolerance_schema_version string, name string, value double")
