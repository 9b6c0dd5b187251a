"""Commits under concurrency, recorded failures, rows without rewriting, handles that die, heaps without pairs."""

import os

import pytest
from pyspark.sql import functions as F

from draftwell.operators import grid, repair, topology
from draftwell.operators.versions import CommitLog, Conflict

from .test_hierarchy_repair import frame, session_of

PAIRS = [(0, 0, 0, 1, 0, 0)] * 2 + [(5, 0, 0, 6, 0, 0)] * 2 + [(9, 0, 0, 8, 0, 0)]


def test_a_number_is_claimed_once(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    assert log.head() == 0 and log.entries() == []
    log.append(0, "ready", version="a")
    with pytest.raises(Conflict):
        log.append(0, "ready", version="b")
    log.append(1, "failed", version="a", reason="why")
    assert [(e.number, e.parent, e.state, e.version) for e in log.entries()] == [(1, 0, "ready", "a"), (2, 1, "failed", "a")]


def test_two_sessions_and_two_rollbacks(spark, tmp_path):
    s = session_of(spark, tmp_path, PAIRS)
    first = s.prepare()
    other = repair.WorkingSession(s.source, s.root)
    other.recover()
    ids = sorted(r.action_id for r in repair.propose(s.source.edges, s.rows(), 1e-4, s.source.snapshot_id).actions.collect())
    assert s.repair_one(ids[0])["applied"] == 1
    second = s.workspace
    with pytest.raises(Conflict):  # it planned on a head that is no longer the last
        other.repair_one(ids[1])
    assert other.workspace == first and other.recover() == second
    assert other.repair_one(ids[1])["applied"] == 1
    third = other.workspace
    s.recover()
    assert s.rollback("bad").version == second.version and s.rollback("bad, too").version == first.version
    last = s.rollback("all")
    assert last.state == "failed" and last.version is None
    assert repair.WorkingSession(s.source, s.root).recover() == last
    assert third.version in {r.version for r in s.history().where("state = 'failed'").collect()}
    assert s.rebuild().state == "ready" and s.rows().count() == 5


def test_failures_are_on_record(spark, tmp_path):
    s = session_of(spark, tmp_path, PAIRS)
    s.prepare()
    spark.read.parquet(s.workspace.path).limit(1).write.mode("append").parquet(s.workspace.path)
    assert s.verify().state == "failed"
    again = repair.WorkingSession(s.source, s.root).recover()
    assert (again.state, again.reason) == ("failed", "host_state_changed")


@pytest.mark.parametrize("which", ["removed", "survivor"])
@pytest.mark.parametrize("state", ["erased", None])
def test_a_handle_dies_between_plan_and_commit(spark, tmp_path, monkeypatch, which, state):
    s = session_of(spark, tmp_path, PAIRS[:2])
    s.prepare()
    before, summary = s.workspace, repair.summary

    def dies(derived, post, plan, tol):
        row = plan.actions.first()
        gone = row.survivor if which == "survivor" else row.affected_derived_ids[0]
        handle = derived.where(F.col("derived_id") == gone).select("handle_id").first()[0]
        host = repair.WorkingSession(s.source, s.root)
        host.recover()
        host.handles_changed(spark.createDataFrame([(handle, state)], "handle_id string, handle_state string"))
        return summary(derived, post, plan, tol)

    with monkeypatch.context() as m:
        m.setattr(repair, "summary", dies)
        audit = s.repair()
    assert (audit["applied"], audit["failed"], audit["errors"]) == (0, 1, ["host_handle_invalidated" if state else "host_handle_missing"])
    assert s.workspace == before and s.rows().count() == 2 and {r.status for r in s.audits.collect()} == {"failed"}
    assert s.repair()["applied"] == 0  # the next plan sees the handle
    # another handle's change doesn't stand in the way
    s.handles_changed(spark.createDataFrame([("h-0", "live"), ("h-1", "live"), ("h-2", "live"), ("h-9", "erased")], "handle_id string, handle_state string"))
    assert s.repair()["applied"] == 1


def test_repair_writes_what_changes(spark, tmp_path):
    n = 20_000
    lines = spark.range(n).select(
        F.col("id").alias("edge_id"), *[F.when(F.col("id") < 20, F.floor(F.col("id") / 2)).otherwise(F.col("id") * 3.0).cast("double").alias(c) for c in ("sx", "sy", "sz")], *[(F.when(F.col("id") < 20, F.floor(F.col("id") / 2)).otherwise(F.col("id") * 3.0) + 1.0).cast("double").alias(c) for c in ("ex", "ey", "ez")],
        F.lit("L").alias("layer"), F.col("id").alias("entity_id"), F.col("id").alias("persistent_id"), F.array("id").alias("pid_path"), F.array().cast("array<string>").alias("instance_path"), F.lit(0).alias("structural_depth"), F.lit(True).alias("pid_path_complete"),
    ).withColumn("length", F.lit(1.732))
    s = session_of(spark, tmp_path, PAIRS)
    object.__setattr__(s.source, "edges", lines)
    s.prepare()
    assert s.repair()["applied"] == 10 and s.rows().count() == n - 10
    size = lambda p: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(p.removeprefix("file://")) for f in fs if f.endswith(".parquet"))
    assert size(s.workspace.path) < 0.05 * size(s.workspace.base) and s.workspace.base != s.workspace.path
    assert repair.WorkingSession(s.source, s.root).recover() == s.workspace and s.verify().state == "ready"
    assert {len(r.source_occurrence_ids) for r in s.rows().collect()} == {1, 2}


def test_compaction(spark, tmp_path):
    s = session_of(spark, tmp_path, PAIRS)
    s.COMPACT = 1
    s.prepare()
    ids = sorted(r.action_id for r in repair.propose(s.source.edges, s.rows(), 1e-4, s.source.snapshot_id).actions.collect())
    s.repair_one(ids[0])
    assert len(s.workspace.deltas) == 1
    s.repair_one(ids[1])
    assert s.workspace.deltas == () and s.workspace.base == s.workspace.path and s.rows().count() == 3


def test_failed_actions_are_counted(spark):
    e = frame(spark, PAIRS)
    d = repair.derive(e)
    p = repair.propose(e, d, 1e-4)
    first = p.actions.orderBy("action_id").limit(1)
    row = repair.summary(d, repair.post_inventory(d, first), p, 1e-4).first()
    assert (row.applied, row.failed) == (1, 1)


def test_a_violated_invariant_is_told(spark):
    e = frame(spark, PAIRS)
    d = repair.derive(e)
    actions = repair.propose(e, d, 1e-4).actions
    told = {r.invariant[0] for r in repair.invariants(d, d, actions, 1e-4).where("violations > 0").collect()}
    assert told == {"B"}  # what was to go is still there
    lost = actions.withColumn("source_occurrence_ids", F.slice("source_occurrence_ids", 1, 1))
    told = {r.invariant[0] for r in repair.invariants(d, repair.post_inventory(d, lost), lost, 1e-4).where("violations > 0").collect()}
    assert told == {"F"}


def test_a_heap_of_equal_edges_is_counted_and_repaired(spark):
    """100,000 equal edges, some of them turned, and two that lie close to them: five billion pairs, none of them listed."""
    n = 100_000
    turn = F.col("id") % 2 == 0
    far = F.when(F.col("id") >= n, 0.00004).otherwise(0.0)
    lines = spark.range(n + 2).select(
        F.col("id").alias("edge_id"), F.when(turn, 1.0).otherwise(0.0).alias("sx"), far.alias("sy"), F.lit(0.0).alias("sz"), F.when(turn, 0.0).otherwise(1.0).alias("ex"), far.alias("ey"), F.lit(0.0).alias("ez"),
        F.lit("L").alias("layer"), F.col("id").alias("entity_id"), F.col("id").alias("persistent_id"), F.array(F.col("id") + 5).alias("pid_path"), F.array().cast("array<string>").alias("instance_path"), F.lit(0).alias("structural_depth"), F.lit(True).alias("pid_path_complete"),
    )
    m = n + 2
    assert topology.direct_pairs(lines, 1e-4).first()[0] == m * (m - 1) // 2
    assert tuple(topology.metrics(topology.edge_components(lines, 1e-4)).first()) == (m * (m - 1) // 2, m, 1, 0)
    d = repair.derive(lines)
    p = repair.propose(lines, d, 1e-4)
    assert [(r.before_edge_count, r.confidence_basis.split("_")[0]) for r in p.actions.collect()] == [(m, "reversed")] and p.skipped.count() == 0
    row = repair.summary(d, repair.post_inventory(d, p.actions), p, 1e-4).first()
    assert (row.edges_after, row.pairs_before, row.pairs_after) == (1, m * (m - 1) // 2, 0)


def test_heaps_equal_pairs(spark):
    import random

    rng = random.Random(6)
    rows = []
    for _ in range(150):
        x, y = rng.randrange(4) * 0.00006, rng.randrange(3) * 10
        a, b = (x, y, 0), (x + 1, y + rng.randrange(2) * 0.00006, 0)
        rows.append((*(a + b if rng.random() < 0.5 else b + a), rng.choice("AB"), rng.random() > 0.1))
    e = frame(spark, rows)
    pairs = grid.duplicate_pairs(e, 1e-4).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    assert topology.direct_pairs(e, 1e-4).first()[0] == pairs.count()
    listed = sorted(map(tuple, topology.components(pairs).select("node", "component", "members", "pairs", "required", "repairable").collect()))
    assert sorted(map(tuple, topology.edge_components(e, 1e-4).collect())) == listed
    # the plan is that of all listed pairs
    d = repair.derive(e)
    by_pairs = repair.propose(e, d, 1e-4, "", grid.duplicate_pairs(e, 1e-4).select("id_a", "id_b"))
    by_heaps = repair.propose(e, d, 1e-4)
    for part in ("actions", "skipped"):
        assert sorted(map(str, getattr(by_heaps, part).collect())) == sorted(map(str, getattr(by_pairs, part).collect()))
