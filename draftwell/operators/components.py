"""Connected components over an edge list, with DataFrame operations only.

Labels start as the vertex itself. Each round hooks every vertex, and the root it points at, to the
smallest label seen across its edges, then follows one more pointer (label of the label). Both steps
are min-aggregations, which combine before they shuffle, so a hub with a third of all edges costs each
map task one row. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that occurs in ``edges``; component = smallest reachable node.

    Null end points and self loops are ignored; repeated edges count once. No edges: no rows.
    Raises if ``max_rounds`` rounds do not reach the fixed point, rather than return partial labels.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = stored(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("component")))
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("node").alias("v"), F.col("component").alias("cand")), "v")
        offered = seen.select(F.col("u").alias("node"), "cand")
        roots = labels.select("node", F.col("component").alias("root"))
        hooked = offered.join(roots, "node").select(F.explode(F.array("node", "root")).alias("node"), "cand")
        # written out, so that a component with very many nodes is a join side that can be split
        merged = stored(
            labels.select("node", F.col("component").alias("cand"), F.col("component").alias("was"))
            .unionByName(hooked.withColumn("was", F.lit(None).cast(labels.schema["component"].dataType)))
            .groupBy("node")
            .agg(F.min("cand").alias("component"), F.max("was").alias("was"))
        )
        parents = merged.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = stored(merged.join(parents, "component").select("node", F.col("up").alias("component"), "was"))
        changed = jumped.where("component <> was").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
