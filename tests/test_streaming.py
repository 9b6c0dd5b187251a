"""Stateless and per-batch operators on a file stream."""

from draftwell.operators import grid
from draftwell.streaming import for_each_batch, short_edge_stream


def test_streams(spark, tmp_path):
    rows = [(i, 0.0, 0.0, 0.0, float(i % 2) + 0.1, 0.0, 0.0, "L", 0.1 + i % 2) for i in range(6)]
    schema = "edge_id bigint, sx double, sy double, sz double, ex double, ey double, ez double, layer string, length double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = short_edge_stream(stream, 0.5).writeStream.format("memory").queryName("short_rows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("short_rows").count() == 3
    q = for_each_batch(stream, lambda b: grid.duplicate_pairs(b, 1e-4).select("id_a", "id_b"), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
