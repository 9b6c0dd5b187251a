"""Leaders of loose groups, found in parallel, against the sequential rule."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftwell.operators import grid
from draftwell.operators.vertices import merged_points, replay

SCHEMA = "edge_id bigint, sx double, sy double, sz double, ex double, ey double, ez double, layer string"


def ends(rows):
    return [(2 * i + k, *map(float, r[3 * k : 3 * k + 3])) for i, r in enumerate(rows) for k in (0, 1)]


def shapes():
    rng = random.Random(7)
    step = lambda k: (k * 0.4, 0.0, 0.0)
    yield "sorted chain", [(*step(2 * i), *step(2 * i + 1)) for i in range(120)]
    order = list(range(240))
    rng.shuffle(order)
    yield "shuffled chain", [(*step(order[2 * i]), *step(order[2 * i + 1])) for i in range(120)]
    yield "repeated points", [tuple(rng.randrange(10) * 0.4 for _ in range(6)) for _ in range(200)]
    yield "signs", [tuple(rng.randrange(-6, 6) * 0.3 for _ in range(6)) for _ in range(200)]


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("at_once", [70, 50_000])
def test_leaders_follow_the_sequential_rule(spark, strict, at_once):
    for name, rows in shapes():
        for tol in (0.7, 1.3) if at_once > 100 else (0.7,):
            size, reach = (max(tol, 1.0), 2) if strict else (tol, 1)
            want = replay(ends(rows), tol, size, reach, strict)
            frame = spark.createDataFrame([(i, *r, "L") for i, r in enumerate(rows)], SCHEMA)
            got = {r.seq: r.leader for r in merged_points(frame, tol, strict, at_once).collect()}
            assert [got[i] for i in range(len(want))] == want, (name, tol)
        if at_once == 70 and name == "shuffled chain":
            break  # many rounds: two shapes are enough


def test_one_group_of_very_many_points(spark):
    """A random sheet that hangs together: rounds settle most of it, and the result is that of the sequential rule."""
    rng = np.random.default_rng(0)
    n = 25_000
    xy = np.round(rng.uniform(0, np.sqrt(2 * n) * 0.45, size=(2 * n, 2)), 6)
    rows = [(i, float(xy[2 * i][0]), float(xy[2 * i][1]), 0.0, float(xy[2 * i + 1][0]), float(xy[2 * i + 1][1]), 0.0, "L") for i in range(n)]
    want = replay(ends([r[1:7] for r in rows]), 0.5, 1.0, 2, True)
    got = merged_points(spark.createDataFrame(rows, SCHEMA), 0.5, True, at_once=10_000).select("seq", "leader").toPandas().sort_values("seq")["leader"]
    assert got.tolist() == want


def test_heaps_and_boxes_over_cell_borders(spark):
    rng = random.Random(2)
    border = grid.WIDE * 1e-4
    pts = [tuple(rng.choice([-2, -1, 0, 1, 5]) * border + rng.choice([-1, 0, 1]) * 0.00005 for _ in range(3)) for _ in range(500)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "i bigint, x double, y double, z double")
    left, right = (frame.select(F.col("i").alias(f"{s}i"), *[F.col(c).alias(f"{s}{c}") for c in "xyz"]) for s in "pq")
    met = grid.grid_join(left, right, ["px", "py", "pz"], ["qx", "qy", "qz"], 1e-4, [])
    close = met.where("abs(px - qx) <= 1e-4 AND abs(py - qy) <= 1e-4 AND abs(pz - qz) <= 1e-4 AND pi < qi").select("pi", "qi").collect()
    want = {(i, j) for i in range(500) for j in range(i + 1, 500) if all(abs(a - b) <= 1e-4 for a, b in zip(pts[i], pts[j], strict=True))}
    assert len(close) == len(set(close)) and {tuple(r) for r in close} == want
