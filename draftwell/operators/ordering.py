"""Global positions without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored


EACH = 200_000  # rows that a task sorts, about


def positions(df: DataFrame, order: list[str | Column], name: str = "position", rows: int | None = None) -> DataFrame:
    """``df`` with 0-based positions in the total order of ``order``, columns or expressions, which should be unique.

    Rows are range-partitioned, sorted and numbered within their partition as they are written out, so they travel once; the
    offsets come from one count a partition, which is as many rows as there are partitions and is broadcast. The sorted
    rows are stored with their numbers, so a partition lost with its executor cannot come back with other borders. With ``rows``, how many there are, no task sorts many more than ``EACH``, so sorting needs no spill.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // EACH))
    keys = {f"__o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    ranged = df.repartitionByRange(n, *keys.values()).withColumns(keys).sortWithinPartitions(*keys)  # keys are made anew, not sent
    dealt = stored(ranged.drop(*keys).withColumn("__at", F.monotonically_increasing_id()))
    pid = F.shiftright("__at", 33)  # the identifier holds the partition above 33 bits of the row's number in it
    sizes = dealt.groupBy(pid.alias("__pid")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__pid", (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__before"))
    at = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("__pid", pid).join(F.broadcast(before), "__pid").withColumn(name, (F.col("__before") + at).cast("bigint")).drop("__pid", "__at", "__before")
