"""Occurrences of containers, counted without expanding them."""

from pyspark.sql import functions as F

from draftwell.sources import hierarchy

SCHEMA = "node_id bigint, parent_id bigint, kind string, def_id bigint, pid bigint, name string, layer string, visible boolean, valid boolean, m array<double>, sx double, sy double, sz double, ex double, ey double, ez double, outer_loop_vertex_count int, loop_count int"


def nodes(spark, rows):
    return spark.createDataFrame([(i, p, k, d, i, None, None, True, v, None, *[None] * 6, None, None) for i, p, k, d, v in rows], SCHEMA)


def test_counts_equal_the_walk(spark):
    rows = [(1, None, "group", None, True), (2, 1, "instance", 100, True), (3, 1, "instance", 100, True), (4, 100, "group", None, True), (5, 4, "instance", 200, True), (6, 200, "group", None, True), (7, 200, "group", None, False), (8, 7, "group", None, True), (9, None, "instance", 200, None), (10, 6, "instance", None, True)]
    frame = nodes(spark, rows)
    walk = hierarchy.container_facts(hierarchy.flatten(frame)).first()
    assert hierarchy.container_counts(frame).first() == walk and walk.deepest_nesting == 6
    ring = nodes(spark, [*rows, (11, 200, "instance", 100, True)])  # 100 holds 200 and 200 holds 100
    assert hierarchy.container_counts(ring).first() == hierarchy.container_facts(hierarchy.flatten(ring)).first()
    assert tuple(hierarchy.container_counts(frame.limit(0)).first()) == (0, 0, 0)


def test_a_definition_placed_very_often(spark):
    """Three definitions of 1,000 instances each: 10^9 occurrences that are never made."""
    n = 1000
    more = lambda at, parent, definition: [(at + i, parent, "instance", definition, True) for i in range(n)]
    frame = nodes(spark, more(10_000, None, 1) + more(20_000, 1, 2) + more(30_000, 2, 3) + [(5, 3, "group", None, True)])
    row = hierarchy.container_counts(frame).first()
    assert tuple(row) == (n**3, n + n**2 + n**3, 4)
