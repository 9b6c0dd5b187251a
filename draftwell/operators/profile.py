"""Profile of a drawing: counts, extents and threshold warnings, in one pass of aggregates each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import AnalysisConfig
from .vertices import Spots, merged_points


# The message texts of the warnings.
OFF_PLANE = " distinct vertex(es) have |Z| > {limit} inches; geometry is significantly off-plane."
FAR_OUT = " bbox corner(s) exceed |coord| > {limit} inches; check import scale."
NESTED = ("Selection contains ", " levels of nested groups/components (warning threshold: {limit}).")


def _low(c: str) -> Column:
    return F.min(F.least(f"s{c}", f"e{c}"))


def _high(c: str) -> Column:
    return F.max(F.greatest(f"s{c}", f"e{c}"))


def bounding_box(edges: DataFrame) -> DataFrame:
    """One row; nulls without edges."""
    return edges.agg(*[_low(c).alias(f"min_{c}") for c in "xyz"], *[_high(c).alias(f"max_{c}") for c in "xyz"])


def z_range(edges: DataFrame) -> DataFrame:
    return edges.agg(F.coalesce(_low("z"), F.lit(0.0)).alias("z_min"), F.coalesce(_high("z"), F.lit(0.0)).alias("z_max"))


def layer_distribution(edges: DataFrame) -> DataFrame:
    return edges.groupBy("layer").agg(F.count(F.lit(1)).alias("edge_count"))


def nonzero_z(edges: DataFrame, eps: float) -> DataFrame:
    """Edges with an end off the plane, and ends off the plane (shared ones counted as often as they occur)."""
    off = lambda c: F.abs(F.col(c)) > eps
    return edges.agg(F.count_if(off("sz") | off("ez")).alias("nonzero_z_edges"), F.coalesce(F.sum(off("sz").cast("bigint") + off("ez").cast("bigint")), F.lit(0)).cast("bigint").alias("nonzero_z_endpoints"))


def z_vertices(edges: DataFrame, eps: float, big: float, found: Spots | None = None) -> DataFrame:
    """Distinct vertices (merged within ``eps``, inclusive) off the plane and significantly off it."""
    found = found or Spots.of(edges, eps)
    at = found.at if found.near(False) is None else merged_points(edges, eps, strict=False, found=found).where("seq = leader")
    return at.agg(F.count_if(F.abs("z") > eps).alias("nonzero_z_vertices"), F.count_if(F.abs("z") > big).alias("significant_z_vertices"))


def large_extrema(edges: DataFrame, limit: float) -> DataFrame:
    """How many of the six numbers of the bounding box exceed the limit."""
    box = bounding_box(edges)
    hits = sum((F.coalesce((F.abs(F.col(c)) > limit).cast("bigint"), F.lit(0)) for c in box.columns), F.lit(0).cast("bigint"))
    return box.select(hits.alias("large_coord_extrema"))


def warnings(z: DataFrame, large: DataFrame, depth: DataFrame, config: AnalysisConfig) -> DataFrame:
    """``code, message, severity``: the rules that fire. ``depth`` has one row, ``deepest_nesting``."""
    t = config.tolerance
    facts = z.crossJoin(large).crossJoin(depth)  # three single rows
    rules = F.array(
        F.when(
            F.col("significant_z_vertices") > 0,
            F.struct(F.lit("significant_non_zero_z").alias("code"), F.concat(F.col("significant_z_vertices").cast("string"), F.lit(OFF_PLANE.format(limit=t.big_z))).alias("message"), F.lit("medium").alias("severity")),
        ),
        F.when(
            F.col("large_coord_extrema") > 0,
            F.struct(F.lit("abnormal_large_coord").alias("code"), F.concat(F.col("large_coord_extrema").cast("string"), F.lit(FAR_OUT.format(limit=t.large_coordinate))).alias("message"), F.lit("high").alias("severity")),
        ),
        F.when(
            F.col("deepest_nesting") >= config.deepest_nesting_warning,
            F.struct(F.lit("deep_nesting").alias("code"), F.concat(F.lit(NESTED[0]), F.col("deepest_nesting").cast("string"), F.lit(NESTED[1].format(limit=config.deepest_nesting_warning))).alias("message"), F.lit("low").alias("severity")),
        ),
    )
    return facts.select(F.explode(F.array_compact(rules)).alias("w")).select("w.*")


def face_totals(faces: DataFrame) -> DataFrame:
    return faces.agg(F.count(F.lit(1)).alias("face_count"), F.count_if(F.col("inner_loop_count") > 0).alias("faces_with_holes_count"))
