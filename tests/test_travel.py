"""What travels and what is written: rows once, without the copies that round coordinates or second passes made."""

import itertools
import os
import random

from pyspark.sql import functions as F

from draftwell.operators import grid, ordering
from draftwell.operators.vertices import Spots, vertices
from draftwell.session import stored

POINT = ["x", "y", "z"]


def plane(spark, n):
    """A plane drawing on round coordinates, as drawings are."""
    rows = [(k, 0.25 * (k % 97), 4.0 * (k % 3), 0.0) for k in range(n)]
    return spark.createDataFrame(rows, "k bigint, x double, y double, z double")


def test_round_coordinates_lie_in_one_cell(spark):
    rows = plane(spark, 2000)
    for tol, size, most in ((1e-4, None, 2000), (1e-6, None, 2000), (0.1, 0.4, 3500)):
        assert grid.filed(rows, [POINT], tol, [], size).count() <= most
        right = rows.select("k", *[F.col(c).alias(f"q{c}") for c in POINT]).withColumnRenamed("k", "q")
        met = grid.grid_join(rows.dropDuplicates(POINT), right.dropDuplicates(["qx", "qy", "qz"]), POINT, ["qx", "qy", "qz"], tol, [], size)
        assert met.where("k = q").count() == rows.dropDuplicates(POINT).count()
    ends = rows.select("k", *POINT, *[(F.col(c) + 1.0).alias(f"{c}2") for c in POINT])
    assert grid.filed(ends, [POINT, ["x2", "y2", "z2"]], 1e-4, []).count() == 2000


def test_pairs_equal_all_pairs(spark):
    rng = random.Random(7)
    tol = 0.01
    rows = [(k, "ab"[k % 2], *[round(rng.choice([0.0, 0.64, -0.64, 1.28]) + rng.uniform(-1, 1) * 0.011, 6) for _ in range(6)]) for k in range(250)]
    names = ["sx", "sy", "sz", "ex", "ey", "ez"]
    df = spark.createDataFrame(rows, "k bigint, layer string, " + ", ".join(f"{c} double" for c in names))
    near = lambda p, q: all(abs(a - b) <= tol for a, b in zip(p, q, strict=True))
    one = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if near(a[2:5], b[2:5])}
    got = grid.grid_pairs(df, "k", [names[:3]], tol, []).where(" AND ".join(f"abs(p_{c} - q_{c}) <= {tol}" for c in names[:3])).select("p_k", "q_k").collect()
    assert len(got) == len(one) > 100 and {tuple(r) for r in got} == one
    copies = [(1000 + r[0], r[1], *r[5:], *r[2:5]) for r in rows]  # turned, so that pairs meet in either order
    all_rows = rows + copies
    two = {(a[0], b[0]) for a, b in itertools.combinations(all_rows, 2) if a[1] == b[1] and (near(a[2:], b[2:]) or near(a[2:], b[5:] + b[2:5]))}
    both = spark.createDataFrame(all_rows, df.schema)
    got = [tuple(r) for r in grid.duplicate_pairs(both.withColumnRenamed("k", "edge_id"), tol).select("id_a", "id_b").collect()]
    assert len(got) == len(two) >= 250 and set(got) == two


def test_positions_send_and_store_the_rows_once(spark):
    rows = spark.range(5000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(700)))
    got = ordering.positions(rows, ["v", -F.col("id")])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__pid" not in plan.split("BroadcastExchange")[0] and "parquet" in plan
    want = [r.id for r in rows.orderBy("v", F.desc("id")).collect()]
    assert [r.id for r in got.orderBy("position").collect()] == want
    assert [r.position for r in got.orderBy("position").collect()] == list(range(5000))


def test_stored_tables_are_small_and_exact(spark):
    df = spark.range(20000).select("id", F.lit("Open endpoint: vertex is shared by exactly one edge.").alias("m"), F.create_map(F.lit("a"), F.col("id").cast("string")).alias("map"), F.array(F.lit(-0.0), F.lit(float("nan"))).alias("a"))
    held = stored(df)
    path = held.inputFiles()[0].removeprefix("file:")
    folder = os.path.dirname(path)
    assert sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder)) < 20000 * 60
    assert held.columns == df.columns
    assert [str(r) for r in held.orderBy("id").collect()] == [str(r) for r in df.orderBy("id").collect()]


def test_spots_count_an_edge_once(spark):
    """A closed edge ends twice in one spot, -0.0 is 0.0, an edge that is not finite has no spot."""
    rows = [(1, 0.0, 0.0, 0.0, -0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (3, 1.0, 0.0, 0.0, 2.0, 0.0, 0.0), (4, float("nan"), 0.0, 0.0, 1.0, 0.0, 0.0)]
    edges = spark.createDataFrame(rows, "edge_id bigint, sx double, sy double, sz double, ex double, ey double, ez double")
    found = Spots.of(edges, 1e-6)
    assert sorted((r.first, r.degree, r.edge_id) for r in found.at.selectExpr("first", "degree", "edge_id").collect()) == [(2, 2, 1), (5, 2, 2), (7, 1, 3)]
    assert [(r.vertex_id, r.leader, r.degree, r.edge_id) for r in vertices(edges, 1e-6).orderBy("vertex_id").collect()] == [(0, 2, 2, 1), (1, 5, 2, 2), (2, 7, 1, 3)]
