"""The four detectors. Each takes edges (or vertices) and returns raw issues of one shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..config import AnalysisConfig
from .grid import duplicate_pairs, gap_pairs
from .vertices import vertices

# The message texts of the issues.
SHORT = "Short edge detected (length=%.6f < threshold={limit})."
DUPLICATE = "Duplicate edge candidate: two edges share both endpoints within duplicate_tolerance."
OPEN = "Open endpoint: vertex is shared by exactly one edge."
GAP = "Gap candidate: two open endpoints within gap_search_tolerance (%.6f inch)."

RAW = ["issue_type", "severity", "confidence", "edge_ids", "lx", "ly", "lz", "message", "metadata"]
SPARE = ["issue_type", "edge_ids", "lx", "ly", "lz", "measure", "v1", "v2", "text"]


def _mid(a: str, b: str) -> list[Column]:
    return [((F.col(f"{a}{c}") + F.col(f"{b}{c}")) / 2.0).alias(f"l{c}") for c in "xyz"]


def _meta(**items: Column) -> Column:
    return F.create_map(*[x for k, v in items.items() for x in (F.lit(k), v.cast("string"))])


def _spare(rows: DataFrame, issue_type: str, edge_ids: Column, place: list[Column], measure: Column | None = None, v1: Column | None = None, v2: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return rows.select(
        F.lit(issue_type).alias("issue_type"), edge_ids.alias("edge_ids"), *place, *[(none if x is None else x).cast(kind).alias(n) for n, kind, x in (("measure", "double", measure), ("v1", "bigint", v1), ("v2", "bigint", v2))],
        none.cast("string").alias("text"),
    )


def short(edges: DataFrame, limit: float) -> DataFrame:
    return _spare(edges.where(F.col("length") < F.lit(limit)), "short_edge", F.array("edge_id"), _mid("s", "e"), F.col("length"))


def duplicate(edges: DataFrame, tol: float) -> DataFrame:
    return _spare(duplicate_pairs(edges, tol), "duplicate_edge_candidate", F.array("id_a", "id_b"), _mid("a_s", "a_e"))


def open_ends(vs: DataFrame) -> DataFrame:
    return _spare(vs.where("degree = 1"), "open_endpoint", F.array("edge_id"), [F.col(c).alias(f"l{c}") for c in "xyz"], v1=F.col("vertex_id"))


def gaps(vs: DataFrame, tol: float) -> DataFrame:
    return _spare(gap_pairs(open_vertices(vs), tol), "gap_candidate", F.array("p_edge_id", "q_edge_id"), _mid("p_", "q_"), F.col("distance"), F.col("p_vertex_id"), F.col("q_vertex_id"))


def told(warnings: DataFrame) -> DataFrame:
    """Profile warnings of known codes as spare issues."""
    none = [F.lit(None).cast("double").alias(c) for c in ("lx", "ly", "lz")]
    known = warnings.where(F.col("code").isin("significant_non_zero_z", "abnormal_large_coord", "deep_nesting"))
    return known.select(F.col("code").alias("issue_type"), F.array().cast("array<bigint>").alias("edge_ids"), *none, *[F.lit(None).cast(k).alias(c) for c, k in (("measure", "double"), ("v1", "bigint"), ("v2", "bigint"))], F.col("message").alias("text"))


def message(short_edge: float | None = None) -> Column:
    """What a spare issue says; its own text if it has one."""
    kind = F.col("issue_type")
    return (
        F.when(kind == "short_edge", F.format_string(SHORT.format(limit=short_edge), "measure")).when(kind == "duplicate_edge_candidate", DUPLICATE)
        .when(kind == "open_endpoint", OPEN).when(kind == "gap_candidate", F.format_string(GAP, "measure")).otherwise(F.col("text"))
    )


def dressed(spare: DataFrame, short_edge: float | None = None, duplicate: float | None = None, gap_search: float | None = None) -> DataFrame:
    """Raw issues from spare ones: severity, message and metadata follow from type and numbers, so they need not travel. Other columns stay."""
    kind = F.col("issue_type")
    metadata = (
        F.when(kind == "short_edge", _meta(length=F.col("measure"), threshold=F.lit(short_edge))).when(kind == "duplicate_edge_candidate", _meta(duplicate_tolerance=F.lit(duplicate)))
        .when(kind == "open_endpoint", _meta(vertex_id=F.col("v1")))
        .when(kind == "gap_candidate", _meta(distance=F.col("measure"), gap_tolerance=F.lit(gap_search), vertex_id_1=F.col("v1"), vertex_id_2=F.col("v2"))).otherwise(_meta(code=kind))
    )
    levels = [F.when(kind == "duplicate_edge_candidate", "medium").otherwise("low").alias("severity"), F.when(kind.isin("short_edge", "duplicate_edge_candidate", "open_endpoint"), "high").otherwise("medium").alias("confidence")]
    more = [c for c in spare.columns if c not in SPARE]
    return spare.select("issue_type", *levels, "edge_ids", "lx", "ly", "lz", message(short_edge).alias("message"), metadata.alias("metadata"), *more)


def short_edges(edges: DataFrame, limit: float) -> DataFrame:
    """Edges shorter than ``limit`` (strictly)."""
    return dressed(short(edges, limit), short_edge=limit)


def duplicate_edges(edges: DataFrame, tol: float) -> DataFrame:
    """Pairs of coinciding edges, located at the middle of the one with the smaller id."""
    return dressed(duplicate(edges, tol), duplicate=tol)


def open_endpoints(vs: DataFrame) -> DataFrame:
    """Vertices that exactly one edge uses."""
    return dressed(open_ends(vs))


def open_vertices(vs: DataFrame) -> DataFrame:
    return vs.where("degree = 1").select("vertex_id", "x", "y", "z", "edge_id")


def gap_candidates(vs: DataFrame, tol: float) -> DataFrame:
    """Pairs of open vertices at most ``tol`` apart; the two can belong to one short edge."""
    return dressed(gaps(vs, tol), gap_search=tol)


def default_detectors(config: AnalysisConfig) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Registry of detectors by name; callers add their own functions of the edges."""
    t = config.tolerance
    return {
        "duplicate": lambda edges: duplicate_edges(edges, t.duplicate),
        "short": lambda edges: short_edges(edges, t.short_edge),
        "open": lambda edges: open_endpoints(vertices(edges, t.coordinate_epsilon)),
        "gap": lambda edges: gap_candidates(vertices(edges, t.coordinate_epsilon), t.gap_search),
    }


def detect(edges: DataFrame, detectors: dict[str, Callable[[DataFrame], DataFrame]]) -> tuple[list[DataFrame], list[dict]]:
    """Results of the detectors that work, and a diagnostic for each that doesn't.

    A detector fails when its rows are computed, not when it is called, so each is written out (checkpointed) by itself.
    """
    from ..session import cut

    found, diagnostics = [], []
    for name, run in detectors.items():
        try:
            found.append(cut(run(edges).select(*RAW)))
        except Exception as e:  # noqa: BLE001  a broken detector must not take the others with it
            diagnostics.append({"stage": f"detector.{name}", "error": type(e).__name__, "message": str(e)[:500]})
    return found, diagnostics
