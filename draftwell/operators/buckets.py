"""Buckets that hold their issues: each in the order of the identifiers, cut into numbered chunks of bounded size.

A bucket may hold a third of all issues, so it is never one row: the issues get global positions from range partitions, and
a chunk is ``size`` neighbours of a bucket. Chunk 0 of every bucket is what a user interface shows first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import DEFAULT_LAYER, ISSUE_TYPES
from ..session import stored
from .issues import groups, layer_groups
from .ordering import positions

SIZE = 1000


def known_groups(issues: DataFrame, group_order: list[str] | None = None) -> DataFrame:
    """``type, rank, issue_count, default_open`` of the types of ``group_order`` and, after them, the canonical ones.

    Issues of other types are in no bucket, but a high one among them still closes the buckets that hold none. Without a
    high issue the first bucket is open. Types that are not there have no row.
    """
    order = list(dict.fromkeys([*(group_order or []), *ISSUE_TYPES]))
    by = issues.groupBy(F.col("issue_type").alias("type")).agg(F.count(F.lit(1)).alias("issue_count"), F.coalesce(F.bool_or(F.col("severity") == "high"), F.lit(False)).alias("has_high"))
    any_high = by.agg(F.coalesce(F.bool_or("has_high"), F.lit(False)).alias("any_high"))
    known = by.withColumn("at", F.array_position(F.array(*map(F.lit, order)), F.col("type"))).where("at > 0").crossJoin(F.broadcast(any_high))  # a single row
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at"))  # one row a known type
    return known.select("type", rank.alias("rank"), "issue_count", F.when(F.col("any_high"), F.col("has_high")).otherwise(rank == 1).alias("default_open"))


def _chunked(issues: DataFrame, bucket: Column, heads: DataFrame, size: int) -> DataFrame:
    """``name, rank, issue_count, default_open, chunk, first_position, issues``; issues of no bucket in ``heads`` go."""
    if size < 1:
        raise ValueError("a chunk holds at least one issue")
    columns = issues.columns
    # rows of equal identifiers are told apart by everything that can be hashed
    content = [f.name for f in issues.schema.fields if "map<" not in f.dataType.simpleString()]
    starts = Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    heads = heads.withColumnRenamed(heads.columns[0], "__bucket").withColumn("__start", F.coalesce(F.sum("issue_count").over(starts), F.lit(0)))
    rows = issues.select(bucket.alias("__bucket"), F.struct(*columns).alias("__issue"), F.col("issue_id").alias("__id"), F.xxhash64(*content).alias("__tie"))
    heads = F.broadcast(stored(heads))  # one row a bucket; a shuffled join would gather each bucket in one task
    kept = rows.join(heads.select("__bucket"), "__bucket", "left_semi")
    placed = positions(kept, ["__bucket", "__id", "__tie"], "__pos").join(heads, "__bucket")
    at = F.col("__pos") - F.col("__start")
    entry = F.struct(at.alias("position"), F.col("__issue").alias("issue"))
    chunks = placed.groupBy("__bucket", "rank", "issue_count", "default_open", F.floor(at / size).cast("bigint").alias("chunk")).agg(F.collect_list(entry).alias("__rows"))
    by_position = lambda a, b: F.when(a["position"] < b["position"], -1).otherwise(1)
    return chunks.select(
        F.col("__bucket").alias("name"), "rank", "issue_count", "default_open", "chunk", (F.col("chunk") * size).alias("first_position"),
        F.transform(F.array_sort("__rows", by_position), lambda r: r["issue"]).alias("issues"),
    )


def type_buckets(issues: DataFrame, group_order: list[str] | None = None, unknown: bool = False, size: int = SIZE) -> DataFrame:
    """Chunks of the buckets by type: ``name, rank, issue_count, default_open, chunk, first_position, issues``.

    ``issues`` has at least ``issue_id, issue_type, severity``; whatever else it has travels in the structs. With ``unknown``
    types outside the canonical list follow by name, as a registry lists them (``group_order`` is not used then); else they
    are dropped. Rows without a type are in no bucket, an identifier that is null comes first, repeated rows stay
    repeated, and no issues give no rows.
    """
    heads = groups(issues) if unknown else known_groups(issues, group_order)
    return _chunked(issues, F.col("issue_type"), heads, size)


def layer_buckets(issues: DataFrame, layers: DataFrame, size: int = SIZE) -> DataFrame:
    """Chunks of the buckets by layer, in the order ``display_rank`` of ``layers``; the columns of :func:`type_buckets`.

    Issues without a layer (null or empty) belong to the default one; those of layers that are not listed go.
    """
    name = F.coalesce(F.nullif("layer_name", F.lit("")), F.lit(DEFAULT_LAYER))
    return _chunked(issues, name, layer_groups(issues, layers), size)
