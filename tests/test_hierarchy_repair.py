"""Cases for the container walk, issues, topology and repair."""

import math

import pytest
from pyspark.sql import functions as F

from draftwell.config import AnalysisConfig, ExecutionConfig
from draftwell.functions import scalars as fn
from draftwell.operators import issues as iss, locate, repair, snapshot, topology
from draftwell.sources import fixtures, hierarchy

NODE = "node_id bigint, parent_id bigint, kind string, def_id bigint, pid bigint, name string, layer string, visible boolean, valid boolean, m array<double>, sx double, sy double, sz double, ex double, ey double, ez double, outer_loop_vertex_count int, loop_count int"


def move(x, y, z):
    return [1.0, 0.0, 0.0, float(x), 0.0, 1.0, 0.0, float(y), 0.0, 0.0, 1.0, float(z), 0.0, 0.0, 0.0, 1.0]


def scale(a, b, c):
    return [float(a), 0.0, 0.0, 0.0, 0.0, float(b), 0.0, 0.0, 0.0, 0.0, float(c), 0.0, 0.0, 0.0, 0.0, 1.0]


def node(i, parent, kind, m=None, d=None, pid=True, valid=True, line=None, loops=None):
    return (i, parent, kind, d, i if pid else None, None, None, None, valid, m, *(map(float, line) if line else [None] * 6), 4 if loops else None, loops)


def walk(spark, rows):
    return hierarchy.flatten(spark.createDataFrame(rows, NODE))


def test_nested_moves(spark):
    rows = [node(1, None, "group", move(1000, 0, 0)), node(2, 1, "group", move(100, 0, 0)), node(3, 2, "group", move(10, 0, 0)), node(4, 3, "edge", line=(0, 0, 0, 1, 0, 0))]
    occ = walk(spark, rows)
    r = hierarchy.world_edges(occ).first()
    assert (r.sx, r.ex, r.pid_path, r.structural_depth, r.pid_path_complete) == (1110.0, 1111.0, [1, 2, 3, 4], 3, True)
    assert tuple(hierarchy.container_facts(occ).first()) == (3, 0, 3)


def test_shared_definition_and_bad_nodes(spark):
    rows = [
        node(1, None, "instance", move(100, 0, 0), d=9), node(2, None, "instance", scale(2, 2, 2), d=9), node(5, 9, "edge", line=(0, 0, 0, 10, 0, 0)),
        node(6, 9, "edge", line=(0, 0, 0, 1, 0, 0), valid=False), node(7, 9, "edge", line=(0, 0, 0, 1, 0, 0), valid=None), node(8, 9, "face", loops=3, pid=False), node(10, None, "edge"),
    ]
    occ = walk(spark, rows)
    assert sorted((r.sx, r.ex) for r in hierarchy.world_edges(occ).collect()) == [(0.0, 20.0), (100.0, 110.0)]
    f = hierarchy.faces(occ).collect()
    assert [(r.inner_loop_count, r.pid_path_complete) for r in f] == [(2, False)] * 2
    roots = occ.where("depth = 0")
    assert hierarchy.selection_type(roots).first()[0] == "mixed"
    assert hierarchy.selection_type(roots.where("kind = 'instance'")).first()[0] == "instance"
    assert hierarchy.selection_type(roots.limit(0)).first()[0] == "empty"


def test_rotation_and_cycle(spark):
    c, s = math.cos(math.pi / 6), math.sin(math.pi / 6)
    turn = [c, -s, 0.0, 0.0, s, c, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    rows = [node(1, None, "group", move(10, 20, 30)), node(2, 1, "group", scale(2, 3, 1)), node(3, 2, "group", turn), node(4, 3, "edge", line=(1, 0, 0, 2, 0, 0)), node(20, None, "instance", move(0, 0, 0), d=30), node(21, 30, "instance", move(0, 0, 0), d=30)]
    r = hierarchy.world_edges(walk(spark, rows)).first()
    assert r.sx == pytest.approx(2 * c + 10) and r.ey == pytest.approx(6 * s + 20) and r.sz == 30
    assert hierarchy.flatten(spark.createDataFrame([], NODE)).count() == 0


def test_active_edit_context(spark):
    rows = [node(1, None, "group", move(1, 0, 0)), node(2, 1, "edge", line=(0, 0, 0, 1, 0, 0)), node(3, None, "edge", line=(0, 0, 0, 1, 0, 0))]
    occ = hierarchy.flatten(spark.createDataFrame(rows, NODE), active_path=(7, None), active_transform=[[1, 0, 0, 100], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    got = {r.edge_id: (r.sx, r.pid_path, r.structural_depth, r.pid_path_complete) for r in hierarchy.world_edges(occ).collect()}
    assert got == {2: (101.0, [7, 1, 2], 3, False), 3: (100.0, [7, 3], 2, False)}
    occ = hierarchy.flatten(spark.createDataFrame(rows, NODE), active_path=(7,), active_transform=[float("nan")] * 16)
    assert {(r.sx, r.pid_path_complete) for r in hierarchy.world_edges(occ).collect()} == {(1.0, True), (0.0, True)}


def test_locate(spark):
    entities = spark.createDataFrame([(1, 11, [5, 6]), (2, 12, [7]), (3, 13, [])], "edge_id bigint, entity_id bigint, pid_path array<bigint>")
    token = "array<struct<pid_path:array<bigint>,entity_id:bigint,nested:boolean,pid_path_complete:boolean>>"
    rows = [
        ("a", [([5, 6], 11, True, True), ([7], 12, False, True)], True), ("b", [([], 13, False, False)], True), ("c", [([5], None, True, False), ([], None, True, False), ([], None, False, False)], True),
        ("d", [([9], 1, False, True)], True), ("e", [([7], 12, False, True)], False),
    ]
    issues = spark.createDataFrame(rows, f"issue_id string, sources {token}, locatable boolean")
    boxes = spark.createDataFrame([(50, [5]), (51, [5, 8]), (60, [7])], "entity bigint, pid_path array<bigint>")
    found, lost = locate.locate(issues, entities, boxes)
    # a nested path leads to the container that its first element names, not to the leaf
    assert sorted(map(tuple, found.collect())) == [("a", 2), ("a", 50), ("b", 3)]
    rows = [("r", [([5, 6], None, True, True), ([5, 6], 1, True, True)], True), ("s", [([5, 77], None, True, True)], True), ("t", [([7, 1], None, True, True)], True)]
    twice = entities.unionByName(spark.createDataFrame([(9, 12, [7]), (4, 40, [8, 1]), (6, 41, [7, 1])], entities.schema))
    found, lost2 = locate.locate(spark.createDataFrame(rows + [rows_[0] for rows_ in [[("u", [([7], 12, False, True)], True)]]], issues.schema), twice, boxes)
    # once for repeated tokens; no root if the path does not exist; the least of rows that share a path
    assert sorted(map(tuple, found.collect())) == [("r", 50), ("t", 60), ("u", 2)]
    assert sorted(map(tuple, lost2.collect())) == [("s", "unresolved:inst_path_root")]
    assert sorted(map(tuple, lost.collect())) == [("c", "fully-missing"), ("c", "incomplete-nested-partial-ancestry"), ("c", "incomplete-nested-partial-leaf"), ("d", "unresolved:inst_path_leaf")]
    assert {r.issue_id: r.selectable for r in locate.select_counts(issues).collect()} == {"a": 2, "b": 1, "c": 0, "d": 1}


def test_fixtures(spark):
    box = fixtures.edges(spark, [*fixtures.rectangle(0, 0, 10, 5), fixtures.horizontal(0, 0, 0.1)])
    assert [r.length for r in box.orderBy("edge_id").collect()] == pytest.approx([10.0, 5.0, 10.0, 5.0, 0.1])


def frame(spark, rows):
    data = [(i, *map(float, r[:6]), r[6] if len(r) > 6 else "L", i, i, [i], [], 0, r[7] if len(r) > 7 else True) for i, r in enumerate(rows, 1)]
    df = spark.createDataFrame(data, "edge_id bigint, sx double, sy double, sz double, ex double, ey double, ez double, layer string, entity_id bigint, persistent_id bigint, pid_path array<bigint>, instance_path array<string>, structural_depth int, pid_path_complete boolean")
    return df.withColumn("length", F.lit(1.0))


def plan(spark, rows, tol):
    e = frame(spark, rows)
    d = repair.derive(e)
    return e, d, repair.propose(e, d, tol)


def test_three_copies(spark):
    _, d, p = plan(spark, [(0, 0, 0, 1, 0, 0)] * 3, 0.0)
    a = p.actions.collect()
    assert len(a) == 1 and a[0].duplicate_pairs == 2 and a[0].survivor == "der-edge-1-1" and a[0].source_occurrence_ids == ["occ-1", "occ-2", "occ-3"]
    post = repair.post_inventory(d, p.actions)
    assert post.count() == 1
    assert {r.violations for r in repair.invariants(d, post, p.actions, 0.0).collect()} == {0}
    broken = lambda state, actions: {r.invariant for r in repair.invariants(d, state, actions, 0.0).where("violations > 0").collect()}
    assert broken(d, p.actions) == {"B_removed_are_gone"}
    assert broken(post.limit(0), p.actions) == {"A_inventory_is_partitioned", "C_survivors_remain"}
    forged = p.actions.withColumn("source_occurrence_ids", F.array(F.lit("occ-1")))
    assert broken(post, forged) == {"F_provenance_is_exact"}
    assert "D_provenance_not_empty" in broken(post, p.actions.withColumn("source_occurrence_ids", F.slice("source_occurrence_ids", 1, 0)))
    assert broken(post, p.actions.unionByName(p.actions)) >= {"G_one_survivor_an_action"}


def test_chain_is_not_transitive(spark):
    _, _, p = plan(spark, [(0, 0, 0, 10, 0, 0), (0.75, 0, 0, 10.75, 0, 0), (1.5, 0, 0, 11.5, 0, 0)], 1.0)
    assert p.actions.count() == 0
    assert [(r.reason, r.detail) for r in p.skipped.collect()] == [("non_transitive_duplicate_component", "members=3 direct=2 required=3 missing=1")]


def test_reversed_incomplete_and_no_tolerance(spark):
    _, _, p = plan(spark, [(0, 0, 0, 1, 0, 0), (1, 0, 0, 2e-6, 0, 0)], 1e-4)
    assert [r.confidence_basis for r in p.actions.collect()] == [repair.BASIS["reversed"]]
    _, _, p = plan(spark, [(0, 0, 0, 1, 0, 0), (0, 0, 0, 1, 0, 0, "L", False)], 1e-4)
    assert p.actions.count() == 0 and p.skipped.first().reason == "incomplete_nested_provenance"
    _, _, p = plan(spark, [(0, 0, 0, 1, 0, 0)] * 2, None)
    assert p.actions.count() == 0 and p.skipped.first().reason == "invalid_or_missing_captured_tolerance"
    assert repair.validate_plan(p.actions)["status"] == "failed"


def test_claims_are_checked(spark):
    e = frame(spark, [(0, 0, 0, 1, 0, 0), (0, 0, 0, 1, 0, 0, "M"), (0, 0, 2e-4, 1, 0, 0), (float("inf"), 0, 0, 1, 0, 0)])
    claims = spark.createDataFrame([(1, 1), (1, 9), (1, 2), (1, 3), (1, 4), (None, 1)], "id_a bigint, id_b bigint")
    got = {(r.id_a, r.id_b): r.reason for r in repair.pair_reasons(claims, e, 1e-4).collect()}
    assert got == {
        (1, 1): "duplicate_evidence_self_match", (None, 1): "duplicate_evidence_self_match", (1, 9): "no_edge_record_for_one_or_both_edge_ids", (1, 2): "semantic_conflict_layer_mismatch",
        (1, 3): "endpoints_outside_tolerance_duplicate", (1, 4): "non_finite_endpoint_coordinates",
    }


def test_session(spark, tmp_path):
    e = frame(spark, [(0, 0, 0, 1, 0, 0)] * 3 + [(5, 0, 0, 6, 0, 0)])
    layers = spark.createDataFrame([("L", 4, 0, True)], "name string, edge_count int, face_count int, visible boolean")
    faces = spark.createDataFrame([], "outer_loop_vertex_count int")
    src = snapshot.SourceSnapshot(e, faces, layers, ExecutionConfig.from_config(AnalysisConfig()))
    s = repair.WorkingSession(src, f"file://{tmp_path}/w")
    before = src.snapshot_id
    assert s.prepare().state == "ready" and s.rows().count() == 4
    first = s.workspace.fingerprint
    audit = s.repair()
    assert (audit["applied"], audit["edges_after"], audit["pairs_before"], audit["pairs_after"]) == (1, 2, 3, 0)
    assert s.verify().state == "ready"
    assert s.repair()["applied"] == 0 and s.rows().count() == 2  # again: nothing is left to do
    assert s.rebuild().fingerprint == first and src.snapshot_id == before
    with pytest.raises(RuntimeError):
        s.prepare()
    s.discard()
    with pytest.raises(RuntimeError):
        s.rows()


def test_components_equal_union_find(spark):
    import random

    rng = random.Random(1)
    pairs = {(a, b) for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(70)) if a < b}
    top = {x: x for p in pairs for x in p}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        ra, rb = sorted((root(a), root(b)))
        top[rb] = ra
    got = {r.node: r for r in topology.components(spark.createDataFrame(sorted(pairs), "a bigint, b bigint")).collect()}
    assert {n: r.component for n, r in got.items()} == {x: root(x) for x in top}
    for n, r in got.items():
        size = sum(root(x) == root(n) for x in top)
        direct = sum(root(a) == root(n) for a, b in pairs)
        assert (r.members, r.pairs, r.repairable) == (size, direct, direct == size * (size - 1) // 2)
    assert topology.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_issue_ids_do_not_hang_on_the_order(spark):
    e = frame(spark, [(0, 0, 0, 1, 0, 0), (2, 0, 0, 3, 0, 0)])
    raw = [("open_endpoint", "low", "high", [1], 0.0, 0.0, 0.0, "a\x01b", None), ("open_endpoint", "low", "high", [1], 1.0, 0.0, 0.0, "c", None), ("odd", "low", "?", [7], None, None, None, None, None)]
    schema = "issue_type string, severity string, confidence string, edge_ids array<bigint>, lx double, ly double, lz double, message string, metadata map<string,string>"
    results = []
    for rows in (raw, raw[::-1]):
        out = iss.with_ids(iss.with_sources(iss.normalized(spark.createDataFrame(rows, schema)), e, 1e-6)).collect()
        results.append(sorted((r.issue_id, r.severity, r.confidence, r.message, r.locatable, r.metadata.get("no_source_marker"), r.layer_name) for r in out))
    assert results[0] == results[1]
    assert results[0][0] == ("odd|no-source|1", "medium", "medium", "", False, "7", "Layer0")
    assert [r[0] for r in results[0][1:]] == ["open_endpoint|1|1", "open_endpoint|1|2"] and results[0][1][3] == "ab"


def test_scalars(spark):
    names = ["DIM-XX", "TEXT-NOTES", "LABEL", "GUIDE-LINES", "XLINE", "Layer0", "default", "Untagged", "WEIRD-LAYER", "", "DIM-ANNO"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(fn.layer_role(F.col("n"))).collect()] == ["dimension", "annotation", "annotation", "guide", "guide", "construction", "construction", "construction", "unknown", "unknown", "dimension"]
    with pytest.raises(Exception, match="null"):
        spark.createDataFrame([(None,)], "n string").select(fn.layer_role(F.col("n"))).collect()
    occ = spark.createDataFrame([("occ-1>2>x",), ("transient-occ-edge-3",), ("else",), (None,)], "o string")
    assert [r[0] for r in occ.select(fn.path_of_occurrence(F.col("o"))).collect()] == [[1, 2], None, None, None]
    v = spark.createDataFrame([("20.0.363",), ("x",)], "v string").select(fn.major_version(F.col("v"))).collect()
    assert [r[0] for r in v] == [20, None]


def session_of(spark, tmp_path, rows):
    e = frame(spark, rows)
    layers = spark.createDataFrame([("L", 4, 0, True)], "name string, edge_count int, face_count int, visible boolean")
    faces = spark.createDataFrame([], "outer_loop_vertex_count int")
    return repair.WorkingSession(snapshot.SourceSnapshot(e, faces, layers, ExecutionConfig.from_config(AnalysisConfig())), f"file://{tmp_path}/w")


def test_single_action_rollback_and_recovery(spark, tmp_path):
    s = session_of(spark, tmp_path, [(0, 0, 0, 1, 0, 0)] * 2 + [(5, 0, 0, 6, 0, 0)] * 2)
    s.prepare()
    first = s.workspace
    ids = sorted(r.action_id for r in repair.propose(s.source.edges, s.rows(), 1e-4, s.source.snapshot_id).actions.collect())
    assert len(ids) == 2 and s.repair_one("act-none")["status"] == "failed" and s.workspace == first
    audit = s.repair_one(ids[0])
    assert (audit["applied"], audit["failed"], audit["edges_after"], audit["tolerance_status"]) == (1, 0, 3, "captured")
    assert [(r.status, r.removed_count) for r in s.audits.collect()] == [("applied", 1)]
    other = repair.WorkingSession(s.source, s.root)  # another process finds what was published
    assert other.recover() == s.workspace and other.rows().count() == 3
    assert s.rollback("host_rejected").version == first.version and s.rows().count() == 4
    assert other.recover().version == first.version
    assert [r.state for r in s.history().collect()] == ["ready", "ready", "failed", "ready"]
    assert s.rollback("again").version != first.version


def test_failures_leave_the_former_version(spark, tmp_path, monkeypatch):
    s = session_of(spark, tmp_path, [(0, 0, 0, 1, 0, 0)] * 2)
    s.prepare()
    before = s.workspace

    def fail(*_):
        raise OSError("disk full")

    with monkeypatch.context() as m:  # the version is written, but never published
        m.setattr(s, "_record", fail)
        with pytest.raises(OSError):
            s.repair()
    assert s.workspace == before and s.rows().count() == 2
    # the stored rows drift: nothing is applied
    s.source.edges.sparkSession.read.parquet(before.path).limit(1).write.mode("append").parquet(before.path)
    assert s.repair()["errors"] == ["host_state_changed"] and s.workspace.state == "failed"
    with pytest.raises(RuntimeError):
        s.rows()


def test_reasons_of_derived_rows(spark):
    """Pairs of copies, each with a fault of its own in the derived rows; edges 2i + 1 and 2i + 2 are pair i."""
    e = frame(spark, [(10 * (i // 2), 0, 0, 10 * (i // 2) + 1, 0, 0) for i in range(23)])
    k = F.col("edge_id")
    e = e.withColumn("pid_path", F.when(k == 8, F.array(F.lit(7).cast("bigint"))).when(k == 23, F.array(F.lit(10).cast("bigint"))).otherwise(F.col("pid_path")))
    d = repair.derive(e).where(~k.isin(2, 3, 4))
    d = d.unionByName(d.where(k == 6).withColumn("derived_id", F.lit("x")))
    d = d.withColumn("derived_id", F.when(k.isin(11, 12), "one").otherwise(F.col("derived_id"))).withColumn("sx", F.when(k == 14, 99.0).otherwise(F.col("sx")))
    d = d.withColumn("handle_state", F.when(k == 18, "erased").when(k != 16, "live")).withColumn("handle_id", F.when(k.isin(19, 20), "h").otherwise(F.col("handle_id")))
    p = repair.propose(e, d, 1e-4)
    got = {r.component: r.reason for r in p.skipped.collect()}
    assert got == {
        "1+2": "incomplete_nested_provenance", "3+4": "no_derived_records_resolve_to_issue_source_edges", "5+6": "no_derived_records_resolve_to_issue_source_edges",
        "7+8": "no_derived_records_resolve_to_issue_source_edges", "9+10": "ambiguous_source_edge_resolution", "11+12": "no_derived_record_for_source_edge", "13+14": "incomplete_nested_provenance",
        "15": "host_handle_missing", "17": "host_handle_invalidated", "19": "host_handle_aliasing",
    }
    assert [r.survivor for r in p.actions.collect()] == ["der-edge-21-21"]


def test_plan_order_status_and_readiness(spark):
    _, _, p = plan(spark, [(0, 0, 0, 1, 0, 0)] * 2 + [(5, 0, 0, 6, 0, 0)] * 2 + [(8, 0, 0, 9, 0, 0), (8, 0, 0, 9, 0, 0, "L", False)], 1e-4)
    rows = [(r.bucket, r.key) for r in repair.ordered(p).collect()]
    assert rows == sorted(rows) and [b for b, _ in rows] == [0, 0, 1]
    assert not repair.ready(p.actions, True)
    done = repair.transition(p.actions, "applied")
    assert repair.ready(done, True) and not repair.ready(done, False) and not repair.ready(p.actions.limit(0), True)
    assert {r.reason for r in repair.transition(p.actions, "rejected", "by hand").collect()} == {"by hand"}
    with pytest.raises(ValueError):
        repair.transition(p.actions, "gone")
    a = p.actions.orderBy("action_id").first()
    assert a.explanation == "Exact duplicate edge (forward exact); 2 source occurrences converge on one canonical derived segment; survivor keeps the lex-smallest derived_id; 1 derived record(s) to remove; provenance union size = 2."
    assert snapshot.same_rows(p.actions.select("survivor"), p.actions.select("survivor")) and not snapshot.same_rows(p.actions.select("survivor"), p.actions.limit(1).select("survivor"))


def test_cliques_equal_brute_force(spark):
    import itertools
    import random

    rng = random.Random(4)
    pairs = sorted({tuple(sorted(rng.sample(range(14), 2))) for _ in range(40)})
    near = {frozenset(p) for p in pairs}
    full = lambda c: all(frozenset(x) in near for x in itertools.combinations(c, 2))
    cliques = [c for n in range(2, 15) for c in itertools.combinations(range(14), n) if full(c)]
    want = sorted(list(c) for c in cliques if not any(set(c) < set(o) for o in cliques))
    frame_ = spark.createDataFrame(pairs, "a bigint, b bigint")
    assert sorted(r.clique for r in topology.maximal_cliques(frame_, topology.components(frame_)).collect()) == want


def test_registry_names_missing_keys(spark):
    rows = spark.createDataFrame([("short_edge", "low", "high")], "issue_type string, severity string, confidence string")
    assert iss.registry(rows)[1].first().reason == "missing key :issue_id" and iss.registry(rows)[0].count() == 0


def test_snapshot_is_read_as_it_was_written(spark, tmp_path):
    source = session_of(spark, tmp_path, [(0, 0, 0, 1, 0, 0)] * 2).source
    path = f"file://{tmp_path}/snap"
    source.write(path)
    again = snapshot.SourceSnapshot.read(spark, path)
    assert again.snapshot_id == source.snapshot_id and again.config == source.config and again.unit == "inches"
    assert snapshot.same_rows(again.edges, source.edges)
    source.edges.limit(1).write.mode("append").parquet(f"{path}/edges")
    with pytest.raises(ValueError):
        snapshot.SourceSnapshot.read(spark, path)
