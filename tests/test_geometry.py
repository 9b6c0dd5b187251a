"""Cases for detectors, vertices and profile, on small frames."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from draftwell.config import AnalysisConfig, ExecutionConfig, Tolerance, tolerance_category
from draftwell.operators import detectors, grid, profile
from draftwell.operators.vertices import replay, vertices

SCHEMA = "edge_id bigint, sx double, sy double, sz double, ex double, ey double, ez double, layer string"


def edges(spark, rows):
    rows = [(i, *map(float, r[:6]), r[6] if len(r) > 6 else "L") for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("length", F.sqrt((F.col("sx") - F.col("ex")) ** 2 + (F.col("sy") - F.col("ey")) ** 2 + (F.col("sz") - F.col("ez")) ** 2))


RECT = [(0, 0, 0, 10, 0, 0), (10, 0, 0, 10, 5, 0), (10, 5, 0, 0, 5, 0), (0, 5, 0, 0, 0, 0)]


@pytest.mark.parametrize(
    "rows, pairs",
    [
        ([(0, 0, 0, 10, 0, 0)] * 2, 1),
        ([(0, 0, 0, 10, 0, 0), (10, 0, 0, 0, 0, 0)], 1),
        ([(0, 0, 0, 10, 0, 0, "A"), (0, 0, 0, 10, 0, 0, "B")], 0),
        ([(0, 0, 0, 10, 0, 0, "Layer0"), (0, 0, 0, 10, 0, 0, "untagged")], 1),
        ([(0, 0, 0, 10, 0, 0), (float("nan"), 0, 0, 10, 0, 0)], 0),
        ([(0, 0, 0, 0, 0, 0)] * 3, 3),
        ([], 0),
    ],
)
def test_duplicates(spark, rows, pairs):
    for tol in (1e-4, 0.0):
        assert grid.duplicate_pairs(edges(spark, rows), tol).count() == pairs


def test_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [tuple(rng.choice([0, 1, 2]) + rng.randrange(4) * 0.00006 for _ in range(6)) + (rng.choice("AB"),) for _ in range(400)]
    close = lambda p, q: all(abs(a - b) <= 1e-4 for a, b in zip(p, q))
    want = {
        (i, j)
        for i, j in itertools.combinations(range(len(rows)), 2)
        if rows[i][6] == rows[j][6] and (close(rows[i][:3], rows[j][:3]) and close(rows[i][3:6], rows[j][3:6]) or close(rows[i][:3], rows[j][3:6]) and close(rows[i][3:6], rows[j][:3]))
    }
    got = [(r.id_a, r.id_b) for r in grid.duplicate_pairs(edges(spark, rows), 1e-4).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_fan_of_edges_makes_few_candidates(spark):
    """1,500 edges share one end: each meets only edges whose other end is near, too."""
    fan = edges(spark, [(0, 0, 0, 10 + i, i, 0) for i in range(1500)] + [(11, 1, 0, 0, 0, 0)])
    a, b = grid._sides(fan)
    found = grid.duplicate_pairs(fan, 1e-4)
    found.collect()
    metrics = found._jdf.queryExecution().executedPlan()
    assert [(r.id_a, r.id_b, r.kind) for r in found.collect()] == [(1, 1500, "reversed")]
    rows = []

    def walk(plan):
        if "Join" in plan.nodeName():
            rows.append(plan.metrics().get("numOutputRows").get().value())
        kids = plan.children()
        for k in range(kids.size()):
            walk(kids.apply(k))

    walk(metrics.finalPhysicalPlan() if "Adaptive" in metrics.nodeName() else metrics)
    assert not rows or max(rows) < 10_000


def test_short_and_length(spark):
    assert detectors.short_edges(edges(spark, [(0, 0, 0, 10, 0, 0)]), 0.5).count() == 0
    assert detectors.short_edges(edges(spark, [(0, 0, 0, 0.1, 0, 0)]), 0.5).count() == 1
    assert edges(spark, [(0, 0, 0, 3, 4, 0)]).first().length == 5.0


def opens(spark, rows):
    return vertices(edges(spark, rows), 1e-6)


def test_open_endpoints(spark):
    assert detectors.open_endpoints(opens(spark, [(0, 0, 0, 5, 0, 0)])).count() == 2
    assert detectors.open_endpoints(opens(spark, RECT)).count() == 0
    assert detectors.open_endpoints(opens(spark, [(1, 1, 1, 1, 1, 1)])).count() == 1  # a degenerate edge
    assert detectors.open_endpoints(opens(spark, [])).count() == 0


def test_gaps(spark):
    found = detectors.gap_candidates(opens(spark, [(0, 0, 0, 5, 0, 0), (5.05, 0, 0, 10, 0, 0)]), 0.1).collect()
    assert len(found) == 1 and abs(float(found[0].metadata["distance"]) - 0.05) < 1e-9
    assert detectors.gap_candidates(opens(spark, [(0, 0, 0, 5, 0, 0), (5.5, 0, 0, 10, 0, 0)]), 0.1).count() == 0
    own = detectors.gap_candidates(opens(spark, [(0, 0, 0, 0.05, 0, 0)]), 0.1).collect()
    assert [r.edge_ids for r in own] == [[0, 0]]


@pytest.mark.parametrize("strict", [True, False])
def test_vertices_replay_the_greedy_rule(spark, strict):
    rng = random.Random(5)
    for tol in (1e-6, 0.3):
        rows = [tuple(rng.randrange(12) * tol * 0.6 for _ in range(3)) + tuple(rng.randrange(12) * tol * 0.6 for _ in range(3)) for _ in range(60)]
        points = [(2 * i + k, *map(float, r[3 * k : 3 * k + 3])) for i, r in enumerate(rows) for k in (0, 1)]
        cell, reach = (max(tol, 1.0), 2) if strict else (tol, 1)
        want = replay(points, tol, cell, reach, strict)
        got = vertices(edges(spark, rows), tol, strict).orderBy("vertex_id").collect()
        assert [r.leader for r in got] == sorted(set(want))
        degree = {lead: len({points[i][0] // 2 for i, w in enumerate(want) if w == lead}) for lead in want}
        assert {r.leader: r.degree for r in got} == degree


def test_profile(spark):
    z = lambda rows, eps=1e-6: profile.z_vertices(edges(spark, rows), eps, 0.01).first()
    lifted = [(a, b, 0.005, c, d, 0.005) for a, b, _, c, d, _ in RECT]
    assert tuple(z(lifted)) == (4, 0)
    assert tuple(z([(0, 0, 0, 5, 5, 5)])) == (1, 1)
    assert profile.bounding_box(edges(spark, [])).first().min_x is None
    assert tuple(profile.z_range(edges(spark, [])).first()) == (0.0, 0.0)
    assert profile.large_extrema(edges(spark, [(0, 0, 0, 1.5e6, 1, 0)]), 1e6).first()[0] == 1
    assert profile.nonzero_z(edges(spark, [(0, 0, 0, 1, 0, 0.1)]), 1e-6).first().nonzero_z_edges == 1
    assert vertices(edges(spark, RECT), 1e-6).count() == 4


def test_a_failing_detector_is_isolated(spark):
    def broken(_):
        raise ValueError("no")

    found, diagnostics = detectors.detect(edges(spark, [(0, 0, 0, 0.1, 0, 0)]), {"bad": broken, "lazy": lambda e: e.select(F.raise_error(F.lit("late")).alias("issue_type")), "short": lambda e: detectors.short_edges(e, 0.5)})
    assert len(found) == 1 and [d["stage"] for d in diagnostics] == ["detector.bad", "detector.lazy"]


def test_tolerances():
    for text in ("abc", "", "  ", "1foo", "-1.0", True, [], None, float("nan")):
        assert tolerance_category(text) == "invalid"
    assert tolerance_category("0.0") == tolerance_category(0) == "zero"
    assert tolerance_category("1.0") == tolerance_category(5) == "positive"
    with pytest.raises(ValueError):
        Tolerance(duplicate=0)
    c = ExecutionConfig.from_config(AnalysisConfig())
    assert c.value("duplicate") == 1e-4 and ExecutionConfig({}).value("duplicate") is None
    assert c.digest() != ExecutionConfig.from_config(AnalysisConfig(Tolerance(duplicate=2e-4))).digest()
