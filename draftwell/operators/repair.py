"""Duplicate repair: a plan over derived edges, the state expected after it, its proof, and its application as a version.

The source is never touched. A component of duplicates is repaired only if it is complete and every member resolves to
one source edge by a complete path; everything else becomes a skipped action with its reason.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import DEFAULT_LAYER, derived_id, finite, geometry_key, normalized_layer, occurrence_id, path_of_occurrence, pid_path_text
from ..session import stored
from .grid import END, START, duplicate_pairs, match_kind
from .sift import sifted
from .snapshot import SourceSnapshot, workspace_fingerprint
from .topology import components, direct_pairs, heap_links, heap_of, heaps, weighted_components
from .versions import DISCARDED, FAILED, HANDLES, READY, CommitLog, Conflict, Entry, delta, merged, read

# Fixed values of the action catalogue.
RULE = "duplicate_edge.exact_remove"
ACTION = "remove_duplicate_edge"
BASIS = {"forward": "exact_endpoint_match_within_tolerance.duplicate", "reversed": "reversed_endpoint_match_within_tolerance.duplicate"}
ACTION_TYPES = ["weld_two_edges", "remove_duplicate_edge", "close_gap", "remove_zero_length_edge", "heal_face_loop", "flatten_component", "no_op"]
STATUSES = ["proposed", "validated", "applied", "skipped", "rejected", "failed"]
# The explanation of an action, and what is said without a tolerance.
EXPLANATION = (
    "Exact duplicate edge (%s); %d source occurrences converge on one canonical derived segment; survivor keeps the lex-smallest derived_id; "
    "%d derived record(s) to remove; provenance union size = %d."
)
NO_TOLERANCE = "V1.5 auto-repair disabled: captured duplicate tolerance is missing or invalid"


def derive(edges: DataFrame) -> DataFrame:
    """One derived edge for each source edge. Faces are counted in the source but not derived.

    ``handle_id`` names what the host holds for the row, ``handle_state`` says whether it is ``live``; null is missing.
    """
    occ = occurrence_id(F.col("pid_path"), F.col("instance_path"), F.col("pid_path_complete"), F.col("edge_id"))
    return edges.select(
        derived_id(F.col("edge_id"), F.col("pid_path"), F.col("persistent_id")).alias("derived_id"), F.lit("edge").alias("kind"), F.array(occ).alias("source_occurrence_ids"),
                *START, *END, F.coalesce("layer", F.lit(DEFAULT_LAYER)).alias("layer"), F.lit(None).cast("string").alias("parent_derived_id"), F.lit("live").alias("handle_state"), F.concat(F.lit("h-"), F.col("edge_id").cast("string")).alias("handle_id"),
        "edge_id", "pid_path", "pid_path_complete",
    )


def pair_reasons(pairs: DataFrame, edges: DataFrame, tol: float) -> DataFrame:
    """``id_a, id_b, reason`` for claimed pairs: the first guard that a pair fails, null if it passes all.

    Claims can name edges that don't exist or lie apart, so nothing about them is taken for granted.
    """
    side = lambda p, key: edges.select(F.col("edge_id").alias(key), F.lit(True).alias(f"{p}_hit"), F.col("layer").alias(f"{p}_layer"), *[F.col(c).alias(f"{p}_{c}") for c in START + END], F.col("pid_path_complete").alias(f"{p}_complete"))
    met = pairs.join(side("a", "id_a"), "id_a", "left").join(side("b", "id_b"), "id_b", "left")
    coords = [F.col(f"{p}_{c}") for p in "ab" for c in START + END]
    reason = (
        F.when(F.col("id_a").isNull() | F.col("id_b").isNull() | (F.col("id_a") == F.col("id_b")), "duplicate_evidence_self_match")
        .when(F.col("a_hit").isNull() | F.col("b_hit").isNull(), "no_edge_record_for_one_or_both_edge_ids")
        .when(~finite(*coords), "non_finite_endpoint_coordinates")
        .when(normalized_layer(F.col("a_layer")) != normalized_layer(F.col("b_layer")), "semantic_conflict_layer_mismatch")
        .when(match_kind(tol).isNull(), "endpoints_outside_tolerance_duplicate")
        .when(~F.coalesce("a_complete", F.lit(False)) | ~F.coalesce("b_complete", F.lit(False)), "incomplete_nested_provenance")
    )
    return met.select("id_a", "id_b", match_kind(tol).alias("kind"), reason.alias("reason"))


@dataclass(frozen=True)
class Plan:
    actions: DataFrame
    skipped: DataFrame
    members: DataFrame


def propose(edges: DataFrame, derived: DataFrame, tol: float | None, snapshot_id: str = "", claims: DataFrame | None = None) -> Plan:
    """Actions for complete components, skipped rows for the rest.

    ``tol`` is the captured tolerance; without a usable one nothing is repaired and one skipped row says so. ``claims``
    (``id_a, id_b``) default to the detected pairs.
    """
    spark = edges.sparkSession
    nothing = "action_id string, component string, reason string, detail string, issue_ids array<string>"
    if tol is None:
        skipped = spark.createDataFrame([(f"skip-{RULE}-config", "config|invalid_captured_tolerance", "invalid_or_missing_captured_tolerance", NO_TOLERANCE, [])], nothing)
        empty = derived.limit(0).select("derived_id", F.lit("").alias("survivor"), F.lit("").alias("kind"), F.lit(0).cast("bigint").alias("members"), F.array().cast("array<string>").alias("issue_ids"))
        return Plan(_actions(empty, derived.limit(0), snapshot_id), skipped, empty)
    detected = claims is None
    if detected:
        sound = stored(_sound(edges, derived))
        odd = edges.join(sound, "edge_id", "left_anti")
        claims = duplicate_pairs(edges, tol, odd).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
    given = "issue_id" in claims.columns
    # what no claim names stays where it is
    sift = (lambda rows, key, few: rows) if detected else sifted
    asked = claims if detected else stored(claims.select("id_a", "id_b").distinct() if given else claims)
    placed = lambda of: stored(sifted(edges.select("edge_id", *START, *END, "layer", "pid_path", "pid_path_complete"), "edge_id", of))
    near = edges if detected else placed(stored(asked.select(F.explode(F.array("id_a", "id_b")).alias("edge_id")).distinct()))
    judged = stored(pair_reasons(asked, near, tol))
    judged = stored(judged.join(_resolution(judged.where("reason IS NULL"), near, edges, derived, tol, sift), ["id_a", "id_b"], "left").select("id_a", "id_b", "kind", F.coalesce("reason", "identity").alias("reason")))
    none = F.array().cast("array<string>")
    named = claims.where("issue_id IS NOT NULL").groupBy("id_a", "id_b").agg(F.array_sort(F.collect_set("issue_id")).alias("issue_ids")) if given else None
    good = judged.where("reason IS NULL")
    comp = stored(_detected_components(edges, sound, good, tol) if detected else components(good.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))))
    ids = derived.where("kind = 'edge'").select(F.col("edge_id").alias("node"), "derived_id", "handle_state", "handle_id", F.get("source_occurrence_ids", F.lit(0)).alias("occurrence"))
    rows = comp.join(sift(ids, "node", comp.select("node")), "node")
    rows = rows if detected else stored(rows)
    per = rows.groupBy("component").agg(
        F.min("derived_id").alias("survivor"), F.first("members").alias("n"), F.count(F.lit(1)).alias("found"), F.count_distinct("derived_id").alias("distinct_ids"), F.count_distinct("occurrence").alias("sources"),
        F.bool_or(F.col("handle_state").isNull()).alias("missing"), F.bool_and(F.coalesce("handle_state", F.lit("")) == "live").alias("live"), F.count_distinct("handle_id").alias("handles"),
        F.first("repairable").alias("repairable"), F.first("pairs").alias("pairs"), F.first("required").alias("required"),
    )
    why = (
        F.when(~F.col("repairable"), "non_transitive_duplicate_component")
        .when(F.col("distinct_ids") != F.col("found"), "no_derived_record_for_source_edge")
        .when(F.col("sources") != F.col("found"), "duplicate_evidence_repeated_source_edge")
        .when(F.col("found") != F.col("n"), "ambiguous_source_edge_resolution")
        .when(F.col("missing"), "host_handle_missing")
        .when(~F.col("live"), "host_handle_invalidated")
        .when(F.col("handles") < F.col("found"), "host_handle_aliasing")
    )
    per = per.withColumn("reason", why)
    if given:
        # only claims that passed speak for a component
        evidence = named.join(good.select("id_a", "id_b"), ["id_a", "id_b"], "left_semi").join(comp.select(F.col("node").alias("id_a"), "component"), "id_a").select("component", F.explode("issue_ids").alias("i")).groupBy("component").agg(F.array_sort(F.collect_set("i")).alias("issue_ids"))
        per = per.join(evidence, "component", "left").withColumn("issue_ids", F.coalesce("issue_ids", none))
    else:
        per = per.withColumn("issue_ids", none)
    per = stored(per)
    members = rows.join(per.where("reason IS NULL").select("component", "survivor", "issue_ids"), "component")
    # a complete component: the survivor matches every other member, so the kinds are read off their ends
    at = lambda p, key: near.select(F.col("edge_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in START + END])
    lives = members.where("derived_id = survivor").select("component", F.col("node").alias("x")).join(at("a", "x"), "x")
    others = members.where("derived_id <> survivor").select("component", "survivor", "node", F.col("derived_id").alias("other")).join(at("b", "node"), "node")
    basis = others.join(lives, "component").withColumn("kind", match_kind(tol)).groupBy("survivor").agg(F.min_by("kind", "other").alias("kind"))
    members = members.join(basis, "survivor").select("derived_id", "survivor", "kind", "members", "issue_ids")
    bad_pairs = judged.where("reason IS NOT NULL")
    bad_pairs = (bad_pairs.join(named, ["id_a", "id_b"], "left") if given else bad_pairs.withColumn("issue_ids", none)).select(
        F.concat_ws("+", F.col("id_a").cast("string"), F.col("id_b").cast("string")).alias("component"), "reason", F.lit("").alias("detail"), F.coalesce("issue_ids", none).alias("issue_ids")
    )
    bad_comps = per.where("reason IS NOT NULL").select(
        F.col("component").cast("string").alias("component"), "reason",
        F.concat(F.lit("members="), F.col("n").cast("string"), F.lit(" direct="), F.col("pairs").cast("string"), F.lit(" required="), F.col("required").cast("string"), F.lit(" missing="), (F.col("required") - F.col("pairs")).cast("string")).alias("detail"), "issue_ids",
    )
    skipped = bad_pairs.unionByName(bad_comps)
    skipped = skipped.select(F.concat(F.lit(f"skip-{RULE}-"), F.substring(F.sha2(F.concat_ws("|", "component", "reason"), 256), 1, 12)).alias("action_id"), "component", "reason", "detail", "issue_ids")
    return Plan(_actions(members, sift(derived, "derived_id", rows.select("derived_id")), snapshot_id), skipped, members)


def _sound(edges: DataFrame, derived: DataFrame) -> DataFrame:
    """``edge_id`` of edges about which no pair can raise a doubt: a complete path of their own, and exactly one derived row,
    of an id of its own, that spells this path and has the edge's place."""
    spelt = F.when(F.size("pid_path") > 0, pid_path_text(F.col("pid_path")))
    point = lambda cols: F.struct(*[(F.col(c) + F.lit(0.0)).alias(x) for c, x in zip(cols, "xyz", strict=True)])
    spot = [normalized_layer(F.col("layer")).alias("layer"), F.least(point(START), point(END)).alias("first"), F.greatest(point(START), point(END)).alias("second")]
    whole = finite(*map(F.col, START + END)) & F.coalesce("pid_path_complete", F.lit(False))
    src = edges.select(spelt.alias("path"), *spot, F.lit(1).alias("owners"), F.lit(0).alias("rows"), "edge_id", whole.cast("int").alias("whole"))
    made = derived.where("kind = 'edge'")
    twice = stored(made.groupBy("derived_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("derived_id", F.lit(True).alias("again")))
    held = made.where("size(source_occurrence_ids) > 0")
    held = held.join(twice, "derived_id", "left") if twice.limit(1).count() else held.withColumn("again", F.lit(None).cast("boolean"))
    rows = F.when(F.col("again") | F.col("derived_id").isNull(), 2).otherwise(1)  # an id that is not its own counts as a row too many
    named = held.select(pid_path_text(path_of_occurrence(F.get("source_occurrence_ids", F.lit(0)))).alias("path"), *spot, F.lit(0).alias("owners"), rows.alias("rows"), F.lit(None).cast("bigint").alias("edge_id"), F.lit(1).alias("whole"))
    # edges and rows travel once, by path; numbers are all that is gathered, so nothing is sorted
    every = src.unionByName(named).where("path IS NOT NULL").repartition(F.col("path"))
    facts = [F.sum("owners").alias("owners"), F.sum("rows").alias("rows"), F.min("edge_id").alias("edge_id"), F.min("whole").alias("whole")]
    placed = every.groupBy("path", "layer", "first", "second").agg(*facts)
    one = placed.groupBy("path").agg(F.count(F.lit(1)).alias("places"), *facts)
    return one.where("places = 1 AND owners = 1 AND rows = 1 AND whole = 1").select("edge_id")


def _detected_components(edges: DataFrame, sound: DataFrame, good: DataFrame, tol: float) -> DataFrame:
    """Components of all good pairs. Those of sound edges are counted by heaps; ``good`` has those of the others."""
    clean = edges.join(sound, "edge_id", "left_semi")
    of = stored(heaps(clean))
    ends = good.select(F.explode(F.array("id_a", "id_b")).alias("edge_id")).distinct().join(sound, "edge_id", "left_anti")
    place = stored(heap_of(clean, of).unionByName(ends.select("edge_id", F.col("edge_id").alias("rep"))))
    side = lambda key, name: place.select(F.col("edge_id").alias(key), F.col("rep").alias(name))
    few = good.join(side("id_a", "x"), "id_a").join(side("id_b", "y"), "id_b").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("pairs"))
    nodes = of.select(F.col("edge_id").alias("rep"), "weight").unionByName(ends.select(F.col("edge_id").alias("rep"), F.lit(1).cast("bigint").alias("weight")))
    comp = weighted_components(nodes, heap_links(of, tol).unionByName(few))
    return place.join(comp, "rep").select(F.col("edge_id").alias("node"), "component", "members", "pairs", "required", "repairable")


def claims_of(issues: DataFrame) -> DataFrame:
    """``id_a, id_b, issue_id`` of the duplicate issues of a registry."""
    return issues.where("issue_type = 'duplicate_edge_candidate'").select(F.get("edge_ids", F.lit(0)).alias("id_a"), F.get("edge_ids", F.lit(1)).alias("id_b"), "issue_id")


def _resolution(good: DataFrame, near: DataFrame, edges: DataFrame, derived: DataFrame, tol: float, sift: Callable[[DataFrame, str, DataFrame], DataFrame]) -> DataFrame:
    """``id_a, id_b, identity``: the first doubt about which derived rows stand for a pair, null if there is none. ``near`` are
    the edges that pairs name; of the others and of the derived rows only those travel that ``sift`` leaves, by path.

    A derived row stands for an edge of the pair if its first occurrence spells that edge's path and its own ends match the
    other edge. Each edge must have exactly one such row, and each path exactly one edge.
    """
    place = [*START, *END]
    # paths as they are spelt in identifiers; an edge without one is its own
    spelt = F.when(F.size("pid_path") > 0, pid_path_text(F.col("pid_path")))
    src = near.select("edge_id", spelt.alias("path"), normalized_layer(F.col("layer")).alias("b_layer"), *[F.col(c).alias(f"b_{c}") for c in place])
    ends = good.select(F.col("id_a").alias("edge_id")).unionByName(good.select(F.col("id_b").alias("edge_id"))).distinct()
    src = src.join(ends, "edge_id", "left_semi")
    src = src if sift is not sifted else stored(src)
    spelled = src.select("path")
    owners = sift(edges.select(spelt.alias("path")).where("path IS NOT NULL"), "path", spelled).groupBy("path").agg(F.count(F.lit(1)).alias("owners"))
    src = stored(src.join(owners, "path", "left"))
    rows = derived.where("kind = 'edge' AND size(source_occurrence_ids) > 0").select(
        "derived_id", F.explode(F.array(pid_path_text(path_of_occurrence(F.get("source_occurrence_ids", F.lit(0)))))).alias("path"), normalized_layer(F.col("layer")).alias("a_layer"), *[F.col(c).alias(f"a_{c}") for c in place]
    )  # by explode, as it is spelt once then for all that asks for it
    stands = src.select("edge_id", "path", "owners").join(sift(rows, "path", spelled), "path").select(F.col("edge_id").alias("x"), "path", "owners", "derived_id", "a_layer", *[f"a_{c}" for c in place])
    sides = good.select("id_a", "id_b", F.col("id_a").alias("x"), F.col("id_b").alias("y")).unionByName(good.select("id_a", "id_b", F.col("id_b").alias("x"), F.col("id_a").alias("y")))
    other = src.select(F.col("edge_id").alias("y"), F.col("path").alias("y_path"), "b_layer", *[f"b_{c}" for c in place])
    # rows of a path that both edges spell stand for the first one only
    once = (F.col("x") == F.col("id_a")) | ~F.col("path").eqNullSafe(F.col("y_path"))
    met = sides.join(stands, "x").join(other, "y").where(once & (F.col("a_layer") == F.col("b_layer")) & match_kind(tol).isNotNull())
    # a pair has few such rows: two, unless something is wrong
    met = met.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("x").alias("sources"), F.count_distinct("derived_id").alias("ids"), F.max("owners").alias("owners"))
    doubt = (
        F.when(F.col("n").isNull() | (F.col("sources") != F.col("n")), "no_derived_records_resolve_to_issue_source_edges")
        .when(F.col("n") < 2, "incomplete_nested_provenance")
        .when(F.col("ids") != F.col("n"), "no_derived_record_for_source_edge")
        .when(F.col("owners") != 1, "ambiguous_source_edge_resolution")
    )
    return good.select("id_a", "id_b").join(met, ["id_a", "id_b"], "left").select("id_a", "id_b", doubt.alias("identity"))


def _actions(members: DataFrame, derived: DataFrame, snapshot_id: str) -> DataFrame:
    full = members.join(derived.select("derived_id", "source_occurrence_ids", *START, *END, "layer"), "derived_id")
    key = geometry_key([F.col(c) for c in START], [F.col(c) for c in END], F.col("layer"))
    per = full.groupBy("survivor", "kind").agg(
        F.array_sort(F.collect_list("derived_id")).alias("member_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_occurrence_ids")))).alias("source_occurrence_ids"),
        F.min_by(key, "derived_id").alias("geometry_key"), F.first("issue_ids").alias("issue_ids"),
    )
    n = F.size("member_ids")
    basis = F.when(F.col("kind") == "reversed", BASIS["reversed"]).otherwise(BASIS["forward"])
    act = F.concat(F.lit(f"act-{RULE}-"), F.substring(F.sha2(F.concat_ws("|", F.lit(RULE), F.lit(snapshot_id), "geometry_key", F.array_join("member_ids", "+")), 256), 1, 12))
    return per.select(
        act.alias("action_id"), F.lit(ACTION).alias("type"), F.lit(RULE).alias("rule_id"), F.lit(1.0).alias("confidence"), basis.alias("confidence_basis"),
        F.format_string(EXPLANATION, F.when(F.col("kind") == "reversed", "reversed exact").otherwise("forward exact"), n, n - 1, F.size("source_occurrence_ids")).alias("explanation"),
        "survivor", F.filter("member_ids", lambda m: m != F.col("survivor")).alias("affected_derived_ids"), "source_occurrence_ids", "geometry_key",
        n.cast("bigint").alias("before_edge_count"), (n - 1).cast("bigint").alias("duplicate_pairs"), F.lit("removes_duplicate_edge").alias("topology_impact"), F.lit(True).alias("auto_applicable"), F.lit("proposed").alias("status"), "issue_ids",
    )


def validate_plan(actions: DataFrame) -> dict:
    """``{"status", "errors"}``: an empty plan fails, and so does one with a type, status, confidence or basis that is off."""
    bad = ~F.col("type").isin(ACTION_TYPES) | ~F.col("status").isin(STATUSES) | ~F.col("confidence").between(0, 1) | ((F.col("confidence") > 0.5) & F.coalesce(F.col("confidence_basis") == "", F.lit(True)))
    row = actions.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), (F.count(F.lit(1)) - F.count_distinct("action_id")).alias("twice")).first()
    errors = [text for text, on in (("empty plan", row.n == 0), (f"{row.bad} malformed actions", row.bad > 0), (f"{row.twice} repeated action ids", row.twice > 0)) if on]
    return {"status": "failed" if errors else "validated", "errors": errors}


def transition(actions: DataFrame, status: str, reason: str | None = None) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    out = actions.withColumn("status", F.lit(status))
    return out.withColumn("reason", F.lit(reason)) if reason else out


def ordered(plan: Plan) -> DataFrame:
    """All rows of a plan as they are listed: applied ones by action, then skipped ones by component."""
    done = plan.actions.select(F.lit(0).alias("bucket"), F.col("action_id").alias("key"), "action_id", F.lit(None).cast("string").alias("reason"))
    left = plan.skipped.select(F.lit(1).alias("bucket"), F.col("component").alias("key"), "action_id", "reason")
    return done.unionByName(left).orderBy("bucket", "key", "reason")


def audit_rows(plan: Plan, status: str = "applied") -> DataFrame:
    """One row an action: what it did, to which rows and on what evidence; skipped ones with their reason."""
    none = F.array().cast("array<string>")
    done = plan.actions.select(
        "action_id", F.lit(status).alias("status"), "rule_id", "explanation", "confidence_basis", "source_occurrence_ids", F.size("source_occurrence_ids").cast("bigint").alias("source_occurrence_count"),
        "affected_derived_ids", F.size("affected_derived_ids").cast("bigint").alias("removed_count"), F.col("survivor").alias("survivor_derived_id"), "issue_ids", F.lit(None).cast("string").alias("reason"),
    )
    left = plan.skipped.select(
        "action_id", F.lit("skipped").alias("status"), F.lit(RULE).alias("rule_id"), F.col("detail").alias("explanation"), F.lit("").alias("confidence_basis"), none.alias("source_occurrence_ids"),
        F.lit(0).cast("bigint").alias("source_occurrence_count"), none.alias("affected_derived_ids"), F.lit(0).cast("bigint").alias("removed_count"), F.lit(None).cast("string").alias("survivor_derived_id"), "issue_ids", "reason",
    )
    return done.unionByName(left)


def removed_with(actions: DataFrame) -> DataFrame:
    return actions.select("action_id", F.explode("affected_derived_ids").alias("derived_id"))


def removed_ids(actions: DataFrame) -> DataFrame:
    return actions.select(F.explode("affected_derived_ids").alias("derived_id"))


def post_inventory(derived: DataFrame, actions: DataFrame) -> DataFrame:
    """Derived rows after the actions: the removed ones gone, survivors with the provenance of all they stand for."""
    return merged(derived, [delta(derived, actions)])


def invariants(derived: DataFrame, post: DataFrame, actions: DataFrame, tol: float) -> DataFrame:
    """``invariant, violations`` for the nine statements that must hold between the states before and after."""
    pre, gone = derived.select("derived_id"), removed_ids(actions)
    after = post.select("derived_id")
    lives = actions.select(F.col("survivor").alias("derived_id"))
    claimed = actions.select(F.col("survivor").alias("derived_id"), "source_occurrence_ids")
    owned = actions.select(F.col("survivor"), F.explode(F.concat("affected_derived_ids", F.array("survivor"))).alias("derived_id")).join(derived.select("derived_id", "source_occurrence_ids"), "derived_id")
    true_unions = owned.groupBy("survivor").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_occurrence_ids")))).alias("expected"))
    provenance = claimed.join(true_unions, claimed["derived_id"] == true_unions["survivor"], "full_outer")
    count = lambda df: df.agg(F.count(F.lit(1)).alias("violations"))
    touched = lives.join(post.select("derived_id", "edge_id", *START, *END, "layer"), "derived_id")
    checks = {
        "A_inventory_is_partitioned": count(pre.join(after.unionByName(gone), "derived_id", "left_anti").unionByName(after.unionByName(gone).join(pre, "derived_id", "left_anti"))),
        "B_removed_are_gone": count(after.join(gone, "derived_id", "left_semi")),
        "C_survivors_remain": count(lives.join(after, "derived_id", "left_anti")),
        "D_provenance_not_empty": count(claimed.where(F.size("source_occurrence_ids") < 1)),
        "E_provenance_keys_match": count(provenance.where("derived_id IS NULL OR survivor IS NULL")),
        "F_provenance_is_exact": count(provenance.where("derived_id IS NOT NULL AND survivor IS NOT NULL").where(F.array_sort("source_occurrence_ids") != F.col("expected"))),
        "G_one_survivor_an_action": count(actions.groupBy("survivor").count().where("count > 1").select("survivor")),
        "H_survivor_never_removed": count(lives.join(gone, "derived_id", "left_semi")),
        "I_no_residual_pairs": direct_pairs(touched, tol, "violations"),
    }
    out = None
    for name, frame in checks.items():
        row = frame.select(F.lit(name).alias("invariant"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def summary(derived: DataFrame, post: DataFrame, plan: Plan, tol: float) -> DataFrame:
    """One row of the audit: actions by status, pairs and edges before and after. An action has failed that was planned and
    whose removals are not all gone, or whose survivor is."""
    here = post.select("derived_id")
    undone = removed_with(plan.actions).join(here, "derived_id", "left_semi").select("action_id").unionByName(plan.actions.join(here.withColumnRenamed("derived_id", "survivor"), "survivor", "left_anti").select("action_id")).distinct()
    as_edges = lambda d: d.select("edge_id", *START, *END, "layer")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    state = "invalid_or_missing" if tol is None else "captured"
    if tol is None:
        empty = F.lit(None).cast("bigint")
        return one(plan.actions, "applied").crossJoin(one(plan.skipped, "skipped")).crossJoin(one(derived, "edges_before")).crossJoin(one(post, "edges_after")).crossJoin(one(undone, "failed")).select("*", empty.alias("pairs_before"), empty.alias("pairs_after"), F.lit(state).alias("tolerance_status"))
    return (
        one(plan.actions, "applied").crossJoin(one(plan.skipped, "skipped")).crossJoin(one(derived, "edges_before")).crossJoin(one(post, "edges_after"))
        .crossJoin(direct_pairs(as_edges(derived), tol, "pairs_before")).crossJoin(direct_pairs(as_edges(post), tol, "pairs_after"))
        .crossJoin(one(undone, "failed")).select("*", F.lit(state).alias("tolerance_status")).withColumn("applied", F.col("applied") - F.col("failed"))
    )


@dataclass(frozen=True)
class Workspace:
    """A disposable version of derived rows: building, ready, discarded or failed."""

    state: str
    path: str | None = None
    version: str | None = None
    fingerprint: str | None = None
    reason: str | None = None
    base: str | None = None
    deltas: tuple[str, ...] = ()


def handle_faults(planned: DataFrame, now: DataFrame) -> DataFrame:
    """``derived_id, reason`` of planned rows (``derived_id, handle_id``) whose handle is not what it was: gone, no longer live, or
    shared with another row of the plan. ``now`` has the rows with their present handles."""
    rows = planned.select("derived_id", F.col("handle_id").alias("was")).join(now.select("derived_id", F.lit(True).alias("here"), "handle_id", "handle_state"), "derived_id", "left")
    shared = rows.where("handle_id IS NOT NULL").groupBy("handle_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    reason = (
        F.when(F.col("here").isNull() | F.col("handle_state").isNull(), "host_handle_missing")
        .when((F.col("handle_state") != "live") | ~F.col("handle_id").eqNullSafe(F.col("was")), "host_handle_invalidated")
        .when(F.col("n").isNotNull(), "host_handle_aliasing")
    )
    return rows.join(shared, "handle_id", "left").select("derived_id", reason.alias("reason")).where("reason IS NOT NULL")


class WorkingSession:
    """Prepare, repair, discard and rebuild derived versions of one source under a folder that all executors share.

    A version becomes current when an entry of the commit log names it; the entry's number can be claimed once, so of two
    sessions that start from the same head one raises :class:`~draftwell.operators.versions.Conflict` and leaves everything as
    it was. A repair writes the identifiers that go and the rows that change, beside the base; after ``COMPACT`` repairs the
    rows are written whole again. Failures are entries, too: :meth:`recover` finds the same state in any process, and
    :meth:`rollback` never goes back to a version that has failed.

    What becomes of the host's handles is told by :meth:`handles_changed` and is an entry of the same log. A plan is made
    on a head; before its version is published the handles of all rows that it touches are proven again as of the head
    that the entry follows.
    """

    COMPACT = 8

    def __init__(self, source: SourceSnapshot, root: str) -> None:
        self.source, self.root = source, root.rstrip("/")
        self.spark = source.edges.sparkSession
        self.log = CommitLog(self.spark, f"{self.root}/log")
        self.workspace = Workspace("discarded")
        self.head = 0
        self.audit: dict | None = None
        self.audits: DataFrame | None = None

    def _record(self, workspace: Workspace) -> None:
        facts = {k: getattr(workspace, k) for k in ("path", "version", "fingerprint", "reason", "base")}
        self.head = self.log.append(self.head, workspace.state, deltas=list(workspace.deltas), **facts).number

    def history(self) -> DataFrame:
        """Everything that was published, discarded or failed, in order."""
        return self.log.history()

    def recover(self) -> Workspace:
        """The state that the log tells, as any process finds it."""
        self.workspace, self.head = Workspace("discarded"), 0
        for e in self.log.entries():
            self.head = e.number
            if e.state != HANDLES:
                self.workspace = _workspace(e)
        return self.workspace

    def _publish(self, rows: DataFrame, changes: tuple[DataFrame, DataFrame] | None = None, proof: DataFrame | None = None) -> Workspace:
        """Writes a version, reads it back, and only then makes it current; on failure the former one stays so."""
        former, version = self.workspace, uuid.uuid4().hex[:12]
        path = f"{self.root}/{version}"
        whole = changes is None or len(former.deltas) + 1 > self.COMPACT
        self.workspace = Workspace("building", path, version)
        try:
            if whole:
                rows.write.parquet(path)
                made = Workspace("ready", path, version, base=path)
            else:
                for name, frame in zip(("gone", "rows"), changes, strict=True):
                    frame.coalesce(1 if name == "gone" else 8).write.parquet(f"{path}/{name}")
                made = Workspace("ready", path, version, base=former.base, deltas=(*former.deltas, path))
            mark = workspace_fingerprint(read(self.spark, made.base, list(made.deltas)), self.source.config.digest()).first()
            if not mark.entity_count:
                self.workspace = Workspace("failed", path, version, reason="no_edges_to_derive")
                self._record(self.workspace)
                return self.workspace
            done = replace(made, fingerprint=mark.fingerprint)
            if proof is not None and (fault := self._disproved(proof)):
                self.workspace = former
                return replace(done, state="failed", reason=fault)
            self._record(done)
        except Exception:
            self.workspace = former
            raise
        self.workspace = done
        return done

    def _disproved(self, proof: DataFrame) -> str | None:
        """Moves to the newest head if only handles have changed since ours, and proves the handles there."""
        newer = [e for e in self.log.entries() if e.number > self.head]
        if any(e.state != HANDLES for e in newer):
            raise Conflict("another session has published since this plan was made")
        fault = handle_faults(proof, self._with_handles(proof)).agg(F.min("reason").alias("r")).first()["r"]
        self.head = max([self.head, *(e.number for e in newer)])
        return fault

    def handles_changed(self, changes: DataFrame) -> int:
        """Records ``handle_id, handle_state`` as the host tells them now; a null state is a missing handle."""
        path = f"{self.root}/handles-{uuid.uuid4().hex[:12]}"
        changes.select("handle_id", "handle_state").write.parquet(path)
        self.head = self.log.append(self.log.head(), HANDLES, path=path).number
        return self.head

    def _with_handles(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their handles' present states, from the changes on record."""
        told = [(e.number, e.path) for e in self.log.entries() if e.state == HANDLES]
        if not told:
            return rows
        parts = [self.spark.read.parquet(path).withColumn("__at", F.lit(number)) for number, path in told]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        last = every.groupBy("handle_id").agg(F.max(F.struct("__at", "handle_state")).alias("__now"))
        return rows.join(last, "handle_id", "left").withColumn("handle_state", F.when(F.col("__now").isNotNull(), F.col("__now.handle_state")).otherwise(F.col("handle_state"))).select(*rows.columns)

    def _stored(self) -> DataFrame:
        if self.workspace.state != "ready":
            raise RuntimeError(f"the workspace is {self.workspace.state}")
        return read(self.spark, self.workspace.base, list(self.workspace.deltas))

    def rows(self) -> DataFrame:
        return self._with_handles(self._stored())

    def prepare(self) -> Workspace:
        if self.workspace.state == "ready":
            raise RuntimeError("a workspace is ready; discard it first")
        return self._publish(derive(self.source.edges))

    def verify(self) -> Workspace:
        """Fails the workspace, on record, if what is stored is no longer what was published."""
        mark = workspace_fingerprint(self._stored(), self.source.config.digest()).first().fingerprint
        if mark != self.workspace.fingerprint:
            self._fail("host_state_changed")
        return self.workspace

    def _fail(self, reason: str) -> None:
        self.workspace = replace(self.workspace, state="failed", reason=reason)
        self._record(self.workspace)

    def rollback(self, reason: str) -> Workspace:
        """Marks the current version as failed and goes back to the last ready one that never failed. If there is none, the
        workspace has failed and holds no version."""
        if self.workspace.version is not None and self.workspace.state != "failed":
            self._fail(reason)
        entries = self.log.entries()
        failed = {e.version for e in entries if e.state == FAILED}
        discarded = max((e.number for e in entries if e.state == DISCARDED), default=0)
        good = [e for e in entries if e.state == READY and e.version not in failed and e.number > discarded]
        self.workspace = _workspace(good[-1]) if good else Workspace("failed", reason=reason)
        self._record(self.workspace)
        return self.workspace

    def repair(self) -> dict:
        """All actions or none: the state after them is computed and proven before anything is published."""
        return self._apply(None)

    def repair_one(self, action_id: str) -> dict:
        """One action of the plan, proven like all of them. An action that isn't there, or a workspace that drifted, fails closed."""
        return self._apply(action_id)

    def _apply(self, action_id: str | None) -> dict:
        if self.verify().state != "ready":
            self.audit = {"applied": 0, "failed": 1, "status": "failed", "errors": [self.workspace.reason]}
            return self.audit
        derived, tol = self.rows(), self.source.config.value("duplicate")
        plan = propose(self.source.edges, derived, tol, self.source.snapshot_id)
        actions = stored(plan.actions if action_id is None else plan.actions.where(F.col("action_id") == action_id))
        verdict = validate_plan(actions)
        if verdict["status"] == "failed":
            self.audit = {"applied": 0, "failed": 0, "status": "failed", "errors": verdict["errors"], "skipped": plan.skipped.count()}
            return self.audit
        plan = replace(plan, actions=actions)
        changes = tuple(stored(x) for x in delta(self._stored(), actions))
        post = merged(derived, [changes])
        broken = [r.invariant for r in invariants(derived, post, actions, tol).where("violations > 0").collect()]
        if broken:
            self._fail(broken[0])
            self.audit = {"applied": 0, "failed": actions.count(), "status": "failed", "errors": broken}
            return self.audit
        row = summary(derived, post, plan, tol).first()
        touched = actions.select(F.explode(F.concat("affected_derived_ids", F.array("survivor"))).alias("derived_id"))
        proof = stored(derived.join(touched, "derived_id", "left_semi").select("derived_id", "handle_id", "handle_state"))
        done = self._publish(merged(self._stored(), [changes]), changes, proof)
        if done.state == "failed":
            self.audit = {"applied": 0, "failed": actions.count(), "status": "failed", "errors": [done.reason]}
            self.audits = audit_rows(plan, "failed")
            return self.audit
        self.audit = {**row.asDict(), "status": "applied"}
        self.audits = audit_rows(plan)
        return self.audit

    def discard(self) -> Workspace:
        self.workspace = Workspace("discarded")
        self.audit = self.audits = None
        self._record(self.workspace)
        return self.workspace

    def rebuild(self) -> Workspace:
        """From the source as it was captured."""
        self.discard()
        return self.prepare()


def _workspace(e: Entry) -> Workspace:
    return Workspace(e.state, e.path, e.version, e.fingerprint, e.reason, e.base, tuple(e.deltas))


def ready(actions: DataFrame, validation_ok: bool) -> Column | bool:
    """Whether a plan is done: valid, and every action applied."""
    return bool(validation_ok and actions.agg(F.bool_and(F.col("status") == "applied").alias("all")).first()["all"])
