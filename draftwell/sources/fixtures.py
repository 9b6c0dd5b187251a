"""Small made-up drawings, for tests and trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = (
    "edge_id bigint, sx double, sy double, sz double, ex double, ey double, ez double, layer string, entity_id bigint, persistent_id bigint, pid_path array<bigint>, "
    "instance_path array<string>, structural_depth int, pid_path_complete boolean"
)


def edges(spark: SparkSession, lines: list[tuple], first_id: int = 1) -> DataFrame:
    """Root edges from (start, end) or (start, end, layer), points being three numbers."""
    rows = []
    for i, line in enumerate(lines, first_id):
        s, e = line[0], line[1]
        rows.append((i, *map(float, s), *map(float, e), line[2] if len(line) > 2 else "Layer0", i, i, [i], [], 0, True))
    df = spark.createDataFrame(rows, SCHEMA)
    dx, dy, dz = (F.col(f"s{a}") - F.col(f"e{a}") for a in "xyz")
    return df.withColumn("length", F.sqrt(dx * dx + dy * dy + dz * dz))


def horizontal(x: float, y: float, length: float, layer: str = "Layer0") -> tuple:
    return (x, y, 0), (x + length, y, 0), layer


def rectangle(x: float, y: float, width: float, height: float, z: float = 0.0, layer: str = "Layer0") -> list[tuple]:
    a, b, c, d = (x, y, z), (x + width, y, z), (x + width, y + height, z), (x, y + height, z)
    return [(a, b, layer), (b, c, layer), (c, d, layer), (d, a, layer)]
