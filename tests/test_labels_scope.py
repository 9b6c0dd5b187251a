"""Labels of containers, selections, open containers and parents in snapshots and workspaces."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from draftwell.config import AnalysisConfig, ExecutionConfig
from draftwell.operators import snapshot
from draftwell.sources import hierarchy

from .test_container_counts import SCHEMA

MATRIX = [1.0, 0.0, 0.0, 5.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def boxes(spark, rows):
    return spark.createDataFrame([(i, p, k, d, i, name, None, True, True, None, *[None] * 6, None, None) for i, p, k, d, name in rows], SCHEMA)


TREE = [(1, None, "group", None, "Hall"), (255, 1, "instance", 100, "mine"), (256, 1, "instance", 100, None), (257, 1, "instance", 200, "own"), (258, 1, "instance", 300, None), (4, 100, "group", None, ""), (9, 4, "edge", None, "line")]


def test_labels_tell_instances_apart(spark):
    names = spark.createDataFrame([(100, "Door"), (200, "")], "def_id bigint, def_name string")
    walk = hierarchy.flatten(hierarchy.labelled(boxes(spark, TREE), names))
    got = {tuple(r.path): " > ".join(r.labels) for r in walk.collect()}
    assert got[(1, 255, 4, 9)] == "Group:Hall > ComponentInstance:Door#0xff > Group:0x4 > line"
    assert got[(1, 256, 4)] == "Group:Hall > ComponentInstance:Door#0x100 > Group:0x4"
    assert got[(1, 257)].endswith("ComponentInstance:own#0x101") and got[(1, 258)].endswith("ComponentInstance:0x102#0x102")
    plain = {r.node_id: r.name for r in hierarchy.labelled(boxes(spark, TREE)).collect()}
    assert plain[255] == "ComponentInstance:mine#0xff" and plain[9] == "line" and len(plain) == len(TREE)


@pytest.mark.parametrize("rows, want", [([], "selection"), ([(3, None, "edge", None, "x")], "selection"), ([(3, None, "group", None, None)], "selection"), ([(4, None, "group", None, "B"), (3, None, "instance", None, "A")], "ComponentInstance: A")])
def test_selection_label(spark, rows, want):
    assert hierarchy.selection_label(boxes(spark, rows) if rows else boxes(spark, TREE).limit(0)).first().selection_label == want


def words(lines):
    sums = [sum(int(hashlib.sha256(x.encode()).hexdigest()[8 * k : 8 * k + 8], 16) for x in lines) for k in range(4)]
    return hashlib.sha256(",".join(map(str, [len(lines), *sums])).encode()).hexdigest()


def test_selection_digest_equals_a_plain_one(spark):
    rows = [("group", [1, 2], ["a", "b"], "L"), ("edge", [], [], None), (None, None, None, None), ("edge", [], [], None)]
    df = spark.createDataFrame(rows, snapshot.SELECTION)
    want = words([f"{k or ''}|{'/'.join(map(str, p or []))}|{'>'.join(i or [])}|{layer or ''}" for k, p, i, layer in rows])
    assert tuple(snapshot.selection_digest(df).first()) == (4, want)
    assert snapshot.selection_digest(df.orderBy(F.rand(1)).repartition(3)).first().digest == want
    assert tuple(snapshot.selection_digest(df.limit(0)).first()) == (0, "")


def test_material_digest(spark):
    df = spark.createDataFrame([("wood",), ("steel",), (None,)], "name string")
    assert snapshot.material_digest(df).first().digest == hashlib.sha256(b"\nsteel\nwood").hexdigest()
    assert snapshot.material_digest(df.limit(0)).first().digest == ""


MARK = {"active_edit_seed": "identity"}


@pytest.mark.parametrize(
    "facts, kept",
    [
        (None, False), ({}, False), ([1], False), ({"active_edit_seed": "real"}, True), ({"active_edit_transform": MATRIX, "active_edit_inverse": MATRIX, "pid_path_complete": False, "active_edit_path": [7, "x", None]}, True),
        ({"active_edit_transform": MATRIX[:15]}, False), ({"active_edit_transform": [*MATRIX[:15], 1]}, False), ({"active_edit_inverse": [*MATRIX[:15], math.nan]}, False), ({"active_edit_transform": None}, False),
        ({"pid_path_complete": 1}, False), ({"pid_path_complete": None}, True), ({"active_edit_path": "7"}, False), ({"active_edit_path": [1.5]}, False), ({"active_edit_path": [True]}, False),
    ],
)
def test_transform_context(facts, kept):
    assert snapshot.transform_context(facts) == (facts if kept else MARK)


def test_a_snapshot_keeps_selection_and_context(spark, tmp_path):
    e = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, "L", 1.0)], "edge_id bigint, sx double, sy double, sz double, ex double, ey double, ez double, layer string, length double")
    layers = spark.createDataFrame([("L", 1, 0, True)], "name string, edge_count int, face_count int, visible boolean")
    faces = spark.createDataFrame([], "outer_loop_vertex_count int")
    config = ExecutionConfig.from_config(AnalysisConfig())
    scope = snapshot.selection_scope(hierarchy.flatten(boxes(spark, TREE)))
    bare = snapshot.SourceSnapshot(e, faces, layers, config)
    opened = snapshot.SourceSnapshot(e, faces, layers, config, context=snapshot.transform_context({"active_edit_transform": MATRIX, "active_edit_path": [1, None]}))
    whole = snapshot.SourceSnapshot(e, faces, layers, config, selection=scope, context=opened.context)
    assert len({s.snapshot_id for s in (bare, opened, whole)}) == 3 and opened.snapshot_id.startswith(bare.snapshot_id)
    for k, s in enumerate((bare, opened, whole)):
        s.write(f"file://{tmp_path}/{k}")
        again = snapshot.SourceSnapshot.read(spark, f"file://{tmp_path}/{k}")
        assert (again.snapshot_id, again.context) == (s.snapshot_id, s.context) and (again.selection is None) == (s.selection is None)
    assert again.selection.schema.simpleString() == scope.schema.simpleString() and snapshot.same_rows(again.selection, scope)
    scope.limit(1).write.mode("append").parquet(f"file://{tmp_path}/2/selection")
    with pytest.raises(ValueError):
        snapshot.SourceSnapshot.read(spark, f"file://{tmp_path}/2")


def test_parents_take_part(spark):
    rows = [("a", "edge", None), ("b", "edge", "g"), ("g", "group", None)]
    df = spark.createDataFrame(rows, "derived_id string, kind string, parent_derived_id string")
    got = {r.kind: (r.entities, r.with_parent, r.parents_digest) for r in snapshot.workspace_relations(df).collect()}
    assert got == {"edge": (2, 1, words(["a|", "b|g"])), "group": (1, 0, words(["g|"]))}
    assert snapshot.workspace_relations(df.limit(0)).count() == 0
