"""Which edges are beyond doubt, told by numbers alone: no text or place is gathered, so nothing is sorted for it."""

from pyspark.sql import functions as F

from draftwell.operators import repair, topology

PLACE = "sx double, sy double, sz double, ex double, ey double, ez double"


def drawing(spark, rows):
    """``rows`` are (edge_id, pid_path, complete, layer, x)."""
    full = [(k, path, done, layer, x, 0.0, 0.0, x + 1.0, 0.0, 0.0, ["a"], k) for k, path, done, layer, x in rows]
    return spark.createDataFrame(full, f"edge_id bigint, pid_path array<bigint>, pid_path_complete boolean, layer string, {PLACE}, instance_path array<string>, persistent_id bigint")


def test_sound_edges(spark):
    rows = [(k, [7, k], True, "L", float(k)) for k in range(1, 13)]
    rows[1] = (2, [7, 2], False, "L", 2.0)  # incomplete
    rows[2] = (3, [7, 4], True, "L", 3.0)  # shares the path of 4
    rows[4] = (5, [], True, "L", 5.0)  # no path
    rows[5] = (6, [7, 6], True, "L", float("nan"))
    rows[10] = (11, [7, 11], True, None, -0.0)
    edges = drawing(spark, rows)
    k = F.col("edge_id")
    derived = repair.derive(edges).where(k != 7)  # 7 has no row
    derived = derived.withColumn("sx", F.when(k == 8, 99.0).otherwise(F.col("sx"))).withColumn("layer", F.when(k == 9, "M").otherwise(F.col("layer")))  # 8 moved, 9 on another layer
    derived = derived.withColumn("derived_id", F.when(k == 10, "twin").otherwise(F.col("derived_id")))
    again = derived.where("edge_id = 10").withColumn("source_occurrence_ids", F.array().cast("array<string>"))  # 10 shares its id with a row of no occurrence
    twice = derived.where("edge_id = 12").withColumn("derived_id", F.lit("other"))  # 12 has two rows
    got = repair._sound(edges, derived.unionByName(again).unionByName(twice))
    assert sorted(r.edge_id for r in got.collect()) == [1, 11]
    assert sorted(r.edge_id for r in repair._sound(edges, derived.withColumn("derived_id", F.when(k != 1, F.col("derived_id")))).collect()) == [10, 11, 12]
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_edges_alone_are_not_looked_up(spark):
    edges = drawing(spark, [(k, [k], True, "L", float(k // 2 if k < 10 else k)) for k in range(50)])
    of = topology.heaps(edges).cache()
    got = topology.heap_of(edges, of)
    assert sorted(map(tuple, got.collect())) == [(k, k - k % 2 if k < 10 else k) for k in range(50)]
    assert got.where("rep >= 10 AND rep = edge_id").count() == 40
