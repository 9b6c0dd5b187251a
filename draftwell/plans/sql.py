"""SQL twins: the geometry and its intermediate results as common table expressions for another engine."""

EDGES = """
base AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS c, CAST(cu.c_nationkey AS BIGINT) AS n, CAST(na.n_regionkey AS BIGINT) AS r,
    CAST(o.o_custkey AS DOUBLE) + CAST(o.o_orderkey % 7 AS DOUBLE) * CAST(0.00006 AS DOUBLE) + CASE WHEN o.o_orderkey % 1999 = 0 THEN CAST(2000000.0 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS x,
    CAST((o.o_custkey % 3) * 4 AS DOUBLE) AS y, CAST(o.o_orderkey % 5 + 1 AS DOUBLE) * CAST(0.25 AS DOUBLE) AS span,
    CASE WHEN o.o_orderkey % 499 = 0 THEN CAST(0.02 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS z2, (o.o_orderkey // 30) % 2 = 1 AS flip
  FROM orders o LEFT JOIN customer cu ON cu.c_custkey = o.o_custkey LEFT JOIN nation na ON na.n_nationkey = cu.c_nationkey),
edges0 AS (
  SELECT k AS edge_id, CASE WHEN flip THEN x + span ELSE x END AS sx, y AS sy, CASE WHEN flip THEN z2 ELSE CAST(0 AS DOUBLE) END AS sz,
    CASE WHEN flip THEN x ELSE x + span END AS ex, y AS ey, CASE WHEN flip THEN CAST(0 AS DOUBLE) ELSE z2 END AS ez,
    (['DIM-A', 'Layer0', 'TEXT-N', 'untagged', 'XLINE', 'WALL'])[CAST(k % 6 + 1 AS INTEGER)] AS layer,
    list_filter([r + 1, n + 100, c + 1000000, CASE WHEN k % 97 <> 0 THEN k END], lambda v: v IS NOT NULL) AS pid_path, k % 97 <> 0 AS complete FROM base),
edges AS (SELECT *, sqrt((sx-ex)*(sx-ex) + (sy-ey)*(sy-ey) + (sz-ez)*(sz-ez)) AS length, CASE WHEN lower(layer) IN ('layer0', 'default', 'untagged') THEN 'Layer0' ELSE layer END AS norm_layer FROM edges0)
"""
NEAR = lambda p, q: " AND ".join(f"abs(a.{x} - b.{y}) <= CAST(0.0001 AS DOUBLE)" for x, y in zip(p, q, strict=True))
_S, _E = ("sx", "sy", "sz"), ("ex", "ey", "ez")
PAIRS = f"""
pairs AS (
  SELECT a.edge_id AS id_a, b.edge_id AS id_b, CASE WHEN {NEAR(_S, _S)} AND {NEAR(_E, _E)} THEN 'forward' ELSE 'reversed' END AS kind,
    (a.sx + a.ex) / 2 AS lx, (a.sy + a.ey) / 2 AS ly, (a.sz + a.ez) / 2 AS lz, a.complete AND b.complete AS complete
  FROM edges a JOIN edges b ON a.norm_layer = b.norm_layer AND a.sy = b.sy AND a.edge_id < b.edge_id
  WHERE ({NEAR(_S, _S)} AND {NEAR(_E, _E)}) OR ({NEAR(_S, _E)} AND {NEAR(_E, _S)}))
"""
VERTICES = """
ends AS (SELECT edge_id, edge_id * 2 AS seq, sx AS x, sy AS y, sz AS z FROM edges UNION ALL SELECT edge_id, edge_id * 2 + 1, ex, ey, ez FROM edges),
vertices AS (
  SELECT row_number() OVER (ORDER BY min(seq)) - 1 AS vertex_id, min(seq) AS leader, arg_min(x, seq) AS x, arg_min(y, seq) AS y, arg_min(z, seq) AS z,
    count(DISTINCT edge_id) AS degree, min(edge_id) AS edge_id
  FROM ends GROUP BY CAST(round(x * 100000) AS BIGINT), CAST(round(y * 100000) AS BIGINT), CAST(round(z * 100000) AS BIGINT)),
opens AS (SELECT * FROM vertices WHERE degree = 1)
"""
GAPS = """
gaps0 AS (
  SELECT a.vertex_id AS v1, b.vertex_id AS v2, a.edge_id AS e1, b.edge_id AS e2, (a.x + b.x) / 2 AS lx, (a.y + b.y) / 2 AS ly, (a.z + b.z) / 2 AS lz,
    sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d
  FROM (SELECT *, unnest([-1, 0, 1]) AS step FROM opens) a JOIN opens b ON floor(b.x) = floor(a.x) + a.step AND b.y = a.y AND a.vertex_id < b.vertex_id),
gaps AS (SELECT * FROM gaps0 WHERE d <= CAST(0.1 AS DOUBLE) AND d >= CAST(1e-9 AS DOUBLE))
"""
FACTS = """
zv AS (SELECT count(*) FILTER (abs(z) > CAST(1e-6 AS DOUBLE)) AS nonzero_z_vertices, count(*) FILTER (abs(z) > CAST(0.01 AS DOUBLE)) AS significant_z_vertices FROM vertices),
box AS (SELECT min(least(sx, ex)) AS min_x, min(least(sy, ey)) AS min_y, min(least(sz, ez)) AS min_z, max(greatest(sx, ex)) AS max_x, max(greatest(sy, ey)) AS max_y, max(greatest(sz, ez)) AS max_z FROM edges),
large AS (SELECT CAST((abs(min_x) > 1e6)::INT + (abs(min_y) > 1e6)::INT + (abs(min_z) > 1e6)::INT + (abs(max_x) > 1e6)::INT + (abs(max_y) > 1e6)::INT + (abs(max_z) > 1e6)::INT AS BIGINT) AS large_coord_extrema FROM box),
containers AS (SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation WHERE n_nationkey <> 7) + (SELECT count(*) FROM customer WHERE c_nationkey <> 7 AND c_custkey % 2 = 0) AS group_count,
  (SELECT count(*) FROM customer WHERE c_nationkey <> 7 AND c_custkey % 2 = 1) AS component_count, CAST(3 AS BIGINT) AS deepest_nesting),
warnings AS (
  SELECT 'significant_non_zero_z' AS code, significant_z_vertices || ' distinct vertex(es) have |Z| > 0.01 inches; geometry is significantly off-plane.' AS message, 'medium' AS severity FROM zv WHERE significant_z_vertices > 0
  UNION ALL SELECT 'abnormal_large_coord', large_coord_extrema || ' bbox corner(s) exceed |coord| > 1000000.0 inches; check import scale.', 'high' FROM large WHERE large_coord_extrema > 0
  UNION ALL SELECT 'deep_nesting', 'Selection contains ' || deepest_nesting || ' levels of nested groups/components (warning threshold: 3).', 'low' FROM containers WHERE deepest_nesting >= 3)
"""
ISSUES = """
raw AS (
  SELECT 'duplicate_edge_candidate' AS issue_type, 'medium' AS severity, 'high' AS confidence, [id_a, id_b] AS edge_ids, lx, ly, lz, 'Duplicate edge candidate: two edges share both endpoints within duplicate_tolerance.' AS message, CAST(NULL AS DOUBLE) AS gap FROM pairs
  UNION ALL SELECT 'short_edge', 'low', 'high', [edge_id], (sx + ex) / 2, (sy + ey) / 2, (sz + ez) / 2, 'Short edge detected (length=' || printf('%.6f', length) || ' < threshold=0.5).', NULL FROM edges WHERE length < 0.5
  UNION ALL SELECT 'open_endpoint', 'medium', 'high', [edge_id], x, y, z, 'Open endpoint: vertex is shared by exactly one edge.', NULL FROM opens
  UNION ALL SELECT 'gap_candidate', 'medium', 'medium', [e1, e2], lx, ly, lz, 'Gap candidate: two open endpoints within gap_search_tolerance (' || printf('%.6f', d) || ' inch).', d FROM gaps
  UNION ALL SELECT code, severity, 'medium', CAST([] AS BIGINT[]), NULL, NULL, NULL, message, NULL FROM warnings),
keyed AS (
  SELECT r.*, CASE WHEN lx IS NULL THEN 'none' ELSE CAST(floor(lx / CAST(1e-6 AS DOUBLE)) AS BIGINT) || ',' || CAST(floor(ly / CAST(1e-6 AS DOUBLE)) AS BIGINT) || ',' || CAST(floor(lz / CAST(1e-6 AS DOUBLE)) AS BIGINT) END AS spot,
    a.pid_path AS pa, b.pid_path AS pb, a.complete AS ca, b.complete AS cb, a.layer AS la
  FROM raw r LEFT JOIN edges a ON a.edge_id = r.edge_ids[1] LEFT JOIN edges b ON b.edge_id = r.edge_ids[2]),
stable AS (
  SELECT *, array_to_string(list_sort(list_filter([array_to_string(pa, '.'), CASE WHEN edge_ids[2] <> edge_ids[1] THEN array_to_string(pb, '.') END], lambda v: v IS NOT NULL)), '+') AS source_keys,
    coalesce(la, 'Layer0') AS layer_name, coalesce(ca, false) OR coalesce(cb, false) AS locatable,
    array_to_string(list_transform(edge_ids, lambda v: CAST(v AS VARCHAR)), ',') AS edges_text
  FROM keyed),
issues AS (
  SELECT *, issue_type || '|' || source_keys || '|' || row_number() OVER (PARTITION BY issue_type ORDER BY source_keys || '|loc:' || spot || '|edges:' || array_to_string(list_sort(list_transform(edge_ids, lambda v: CAST(v AS VARCHAR))), ','), message) AS issue_id
  FROM stable)
"""
COMPONENTS = """
good AS (SELECT id_a, id_b, kind FROM pairs WHERE complete),
links AS (SELECT id_bb AS u, v FROM (SELECT id_a AS id_bb, id_b AS v FROM good UNION SELECT id_b, id_a FROM good)),
reach AS (SELECT u AS node, u AS seen FROM links UNION SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.seen),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
sizes AS (SELECT component, count(*) AS members FROM comp GROUP BY component),
counted AS (SELECT c.component, count(*) AS pairs FROM good g JOIN comp c ON c.node = g.id_a GROUP BY c.component),
nodes AS (SELECT c.node, c.component, s.members, p.pairs, CAST(s.members * (s.members - 1) / 2 AS BIGINT) AS required, p.pairs = s.members * (s.members - 1) / 2 AS repairable FROM comp c JOIN sizes s USING (component) JOIN counted p USING (component)),
derived AS (SELECT edge_id, 'der-edge-' || edge_id || '-' || array_to_string(pid_path, '-') AS derived_id, CASE WHEN complete THEN 'occ-' ELSE 'transient-occ-' END || array_to_string(pid_path, '>') AS occ FROM edges),
members AS (SELECT n.node, n.component, n.members, d.derived_id, d.occ, min(d.derived_id) OVER (PARTITION BY n.component) AS survivor FROM nodes n JOIN derived d ON d.edge_id = n.node WHERE n.repairable)
"""
FACES = """
faces AS (SELECT (['DIM-A', 'Layer0', 'TEXT-N', 'untagged', 'XLINE', 'WALL'])[CAST(l_orderkey % 6 + 1 AS INTEGER)] AS layer, CAST(l_linenumber % 4 + 3 AS INTEGER) AS outer_loop_vertex_count, CAST(l_linenumber % 3 AS INTEGER) AS inner_loop_count FROM lineitem),
layers AS (
  SELECT name, sum(e)::BIGINT AS edge_count, sum(f)::BIGINT AS face_count, sum(h)::BIGINT AS faces_with_holes_count,
    CASE name WHEN 'DIM-A' THEN 'dimension' WHEN 'TEXT-N' THEN 'annotation' WHEN 'XLINE' THEN 'guide' WHEN 'WALL' THEN 'unknown' ELSE 'construction' END AS role,
    CASE name WHEN 'DIM-A' THEN 'name_dimension' WHEN 'TEXT-N' THEN 'name_annotation' WHEN 'XLINE' THEN 'name_guide' WHEN 'WALL' THEN 'name_no_match' ELSE 'name_default_layer' END AS role_rule,
    CASE name WHEN 'DIM-A' THEN 1 WHEN 'TEXT-N' THEN 2 WHEN 'XLINE' THEN 3 WHEN 'WALL' THEN 5 ELSE 4 END AS role_rank, name <> 'WALL' AS visible, name = 'XLINE' AS visibility_unknown
  FROM (SELECT layer AS name, 1 AS e, 0 AS f, 0 AS h FROM edges UNION ALL SELECT layer, 0, 1, (inner_loop_count > 0)::INT FROM faces) GROUP BY name)
"""


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(p.strip() for p in parts) + "\n"
