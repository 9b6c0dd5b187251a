"""From issues to the entities they are about."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import locator_target, pid_path_text


def targets(issues: DataFrame) -> DataFrame:
    """``issue_id, kind, reason, target_path, target_id``: one row for each source token of a locatable issue."""
    rows = issues.where("locatable").select("issue_id", F.explode("sources").alias("t"))
    kind, reason = locator_target(F.col("t.pid_path"), F.col("t.entity_id"), F.col("t.nested"), F.col("t.pid_path_complete"))
    by_path = kind.isin("inst_path_leaf", "inst_path_root")
    return rows.select("issue_id", kind.alias("kind"), reason.alias("reason"), F.when(by_path, pid_path_text(F.col("t.pid_path"))).alias("target_path"), F.when(kind == "entity_id", F.col("t.entity_id")).alias("target_id"))


def select_counts(issues: DataFrame) -> DataFrame:
    """How many entities each locatable issue would select."""
    return targets(issues).groupBy("issue_id").agg(F.count_if(F.col("kind") != "skip").alias("selectable"))


def locate(issues: DataFrame, entities: DataFrame, containers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``issue_id, entity``, once each; ``issue_id, reason`` of tokens that lead nowhere).

    ``entities`` are rows ``edge_id, entity_id, pid_path``, ``containers`` rows ``entity, pid_path`` of container
    occurrences. A path outside containers leads to its leaf. A nested one leads to the occurrence that its first element
    names, if the whole path exists. A path or id that several rows share leads to the least of them. All lookups are
    equi-joins.
    """
    wanted = targets(issues)
    one = lambda df, key: df.groupBy(key).agg(F.min("entity").alias("entity"))
    paths = one(entities.select(pid_path_text(F.col("pid_path")).alias("target_path"), F.col("edge_id").alias("entity")), "target_path")
    ids = one(entities.where("entity_id IS NOT NULL").select(F.col("entity_id").alias("target_id"), F.col("edge_id").alias("entity")), "target_id")
    boxes = containers.select(pid_path_text(F.col("pid_path")).alias("target_path"), "entity")
    roots = one(boxes.select(F.col("target_path").alias("first"), "entity"), "first")
    leaf = wanted.where("kind = 'inst_path_leaf'").join(paths, "target_path", "left")
    known = paths.select("target_path").unionByName(boxes.select("target_path")).distinct().withColumn("hit", F.lit(True))
    root = wanted.where("kind = 'inst_path_root'").join(known, "target_path", "left").withColumn("first", F.when(F.col("hit"), F.substring_index("target_path", ".", 1))).join(roots, "first", "left")
    by_id = wanted.where("kind = 'entity_id'").join(ids, "target_id", "left")
    met = leaf.select("issue_id", "kind", "entity").unionByName(root.select("issue_id", "kind", "entity")).unionByName(by_id.select("issue_id", "kind", "entity"))
    lost = met.where("entity IS NULL").select("issue_id", F.concat(F.lit("unresolved:"), "kind").alias("reason"))
    skipped = wanted.where("kind = 'skip'").select("issue_id", "reason")
    return met.where("entity IS NOT NULL").select("issue_id", "entity").distinct(), lost.unionByName(skipped)
