"""Line-work that arrives in pieces.

The model itself is a batch model: vertices, pairs and ids depend on all edges of a drawing. What needs no other row
(validation, layer roles, short edges) runs on a stream as it is; everything else runs on each micro-batch by
:func:`for_each_batch`, which hands a finished frame to any function of this package.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.detectors import short_edges


def short_edge_stream(edges: DataFrame, limit: float) -> DataFrame:
    """Short edges of a streaming frame; stateless, so append mode needs no watermark."""
    return short_edges(edges, limit)


def for_each_batch(edges: DataFrame, run: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Applies ``run`` to every micro-batch and writes its rows as Parquet under ``target``, one folder a batch.

    A batch that is repeated after a failure overwrites its own folder, so rows come once. Takes what is there, then stops.
    """

    def one(batch: DataFrame, number: int) -> None:
        run(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return edges.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
