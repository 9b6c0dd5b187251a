"""Components of the duplicate graph: complete ones can be repaired, the others are only reported.

Edges that coincide exactly, either way round, form a heap: all pairs in it match, and each of them matches what any of
them matches. A heap is one node with a weight, so its n * (n - 1) / 2 pairs are counted without being listed; pairs are
listed only between different coordinates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import normalized_layer
from ..session import stored
from .components import connected_components
from .grid import END, START, finite_sql, duplicate_pairs

OUT = 10_000  # cliques that a task holds before it hands them on


def components(pairs: DataFrame) -> DataFrame:
    """``node, component, members, pairs, required, repairable`` for every node of the pairs ``a, b``.

    A component is complete exactly if all its nodes have the same closed neighbourhood, which needs grouping but no
    iteration: nodes are grouped by a digest of their neighbourhood and the group is complete if it is as large as the
    neighbourhood. Only what is left goes through connected components.
    """
    pairs = stored(pairs.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a neighbourhood is told by its size, its least node and two sums of hashes: no list of neighbours is ever built
    hashes = [F.xxhash64(F.lit(k), F.col("b")).cast("decimal(38,0)").alias(f"h{k}") for k in (1, 2)]
    near = both.unionByName(both.select("a", F.col("a").alias("b")).distinct()).select("a", "b", *hashes)
    keyed = stored(near.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("size"), F.min("b").alias("least"), F.concat_ws(",", F.sum("h1").cast("string"), F.sum("h2").cast("string")).alias("hood")))
    whole = keyed.groupBy("hood", "size", "least").agg(F.count(F.lit(1)).alias("members")).where("members = size")
    clique = keyed.join(whole.select("hood", "least", "members"), ["hood", "least"]).select(
        "node", F.col("least").alias("component"), "members", (F.col("members") * (F.col("members") - 1) / 2).cast("bigint").alias("pairs"), (F.col("members") * (F.col("members") - 1) / 2).cast("bigint").alias("required"), F.lit(True).alias("repairable"),
    )
    rest_nodes = keyed.join(whole.select("hood"), "hood", "left_anti").select(F.col("node").alias("a"))
    rest = stored(pairs.join(rest_nodes, "a", "left_semi"))
    comp = connected_components(rest, "a", "b")
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    links = rest.join(comp.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.count(F.lit(1)).alias("pairs"))
    loose = comp.join(size.join(links, "component"), "component").select("node", "component", "members", "pairs", (F.col("members") * (F.col("members") - 1) / 2).cast("bigint").alias("required"), F.lit(False).alias("repairable"))
    return clique.unionByName(loose)


def metrics(comp: DataFrame) -> DataFrame:
    """One row: direct pairs, nodes, and components of both kinds."""
    per = comp.groupBy("component").agg(F.first("members").alias("members"), F.first("pairs").alias("pairs"), F.first("repairable").alias("repairable"))
    return per.agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).cast("bigint").alias("direct_pairs"), F.coalesce(F.sum("members"), F.lit(0)).cast("bigint").alias("edges_in_pairs"),
        F.count_if("repairable").alias("repairable_components"), F.count_if(~F.col("repairable")).alias("non_transitive_components"),
    )


def _placed(edges: DataFrame) -> DataFrame:
    """``edge_id, layer, first, second``: finite edges with their two ends in a fixed order."""
    point = lambda cols: f"struct({', '.join(f'{c} + 0D AS {x}' for c, x in zip(cols, 'xyz', strict=True))})"
    good = edges.where(finite_sql(START + END)).withColumn("layer", normalized_layer(F.col("layer")))
    return good.selectExpr("edge_id", "layer", f"least({point(START)}, {point(END)}) AS first", f"greatest({point(START)}, {point(END)}) AS second")


def heaps(edges: DataFrame) -> DataFrame:
    """One edge for each set of coinciding ones: ``edge_id`` (the least), ``weight``, ends and layer."""
    one = _placed(edges).groupBy("layer", "first", "second").agg(F.min("edge_id").alias("edge_id"), F.count(F.lit(1)).alias("weight"))
    ends = [F.col(f"{p}.{x}").alias(c) for p, cols in (("first", START), ("second", END)) for x, c in zip("xyz", cols, strict=True)]
    return one.select("edge_id", "weight", "layer", *ends)


def heap_of(edges: DataFrame, of: DataFrame) -> DataFrame:
    """``edge_id, rep``: the heap that each edge lies in. An edge alone in its heap is looked up nowhere."""
    named = _placed(of.where("weight > 1")).select("layer", "first", "second", F.col("edge_id").alias("rep"))
    return of.where("weight = 1").select("edge_id", F.col("edge_id").alias("rep")).unionByName(_placed(edges).join(named, ["layer", "first", "second"]).select("edge_id", "rep"))


def _half(n: str) -> F.Column:
    wide = F.col(n).cast("decimal(18,0)")
    return (wide * (wide - F.lit(1).cast("decimal(18,0)")) / 2).cast("decimal(38,0)")


def heap_links(of: DataFrame, tol: float) -> DataFrame:
    """``a, b, pairs``: heaps of different coordinates that match, and how many pairs of edges that makes."""
    weight = lambda key, name: of.select(F.col("edge_id").alias(key), F.col("weight").cast("decimal(18,0)").alias(name))
    met = duplicate_pairs(of, tol).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return met.join(weight("a", "wa"), "a").join(weight("b", "wb"), "b").select("a", "b", (F.col("wa") * F.col("wb")).cast("decimal(38,0)").alias("pairs"))


def direct_pairs(edges: DataFrame, tol: float, name: str = "direct_pairs") -> DataFrame:
    """One row: how many pairs of edges coincide within ``tol``."""
    of = stored(heaps(edges))
    counts = of.select(_half("weight").alias("pairs")).unionByName(heap_links(of, tol).select("pairs"))
    return counts.agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast("bigint").alias(name))


def weighted_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``rep, component, members, pairs, required, repairable`` of nodes ``rep, weight`` whose own pairs all match, and links
    ``a, b, pairs`` between them. Components of a single edge are left out."""
    links = stored(links)
    named = stored(components(links.select("a", "b")).select(F.col("node").alias("rep"), "component"))
    of = nodes.join(named, "rep", "left").select("rep", "weight", F.coalesce("component", "rep").alias("component"))
    own = of.groupBy("component").agg(F.sum("weight").alias("members"), F.sum(_half("weight")).alias("inner"))
    across = links.join(named, links["a"] == named["rep"]).groupBy("component").agg(F.sum("pairs").alias("across"))
    total = own.where("members > 1").join(across, "component", "left").select(
        "component", "members", (F.col("inner") + F.coalesce("across", F.lit(0))).cast("bigint").alias("pairs"), _half("members").cast("bigint").alias("required")
    )
    return of.join(total, "component").select("rep", "component", "members", "pairs", "required", (F.col("pairs") == F.col("required")).alias("repairable"))


def edge_components(edges: DataFrame, tol: float) -> DataFrame:
    """As :func:`components` of all pairs of ``edges`` that coincide within ``tol``, by heaps: as many rows as edges."""
    of = stored(heaps(edges))
    comp = weighted_components(of.select(F.col("edge_id").alias("rep"), "weight"), heap_links(of, tol))
    return heap_of(edges, of).join(comp, "rep").select(F.col("edge_id").alias("node"), "component", "members", "pairs", "required", "repairable")


def _peeled(both: DataFrame) -> DataFrame:
    """``node, level``: nodes of at most twice the mean degree go first, then those of what is left, and so on. Each round
    takes at least half of the nodes, and no node has more than twice the densest part's mean degree of neighbours that go
    with it or later."""
    levels, level = None, 0
    left = both
    while True:
        degree = stored(left.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree")))
        mean = degree.agg(F.avg("degree").alias("mean")).first()["mean"]
        if mean is None:
            return levels if levels is not None else degree.select("node", F.lit(0).alias("level"))
        gone = degree.where(F.col("degree") <= 2 * mean).select("node", F.lit(level).alias("level"))
        levels = gone if levels is None else levels.unionByName(gone)
        keep = degree.where(F.col("degree") > 2 * mean).select("node")
        left = stored(left.join(keep.select(F.col("node").alias("a")), "a", "left_semi").join(keep.select(F.col("node").alias("b")), "b", "left_semi"))
        rest = keep.join(left.select(F.col("a").alias("node")), "node", "left_anti")  # without neighbours among what is left
        levels = stored(levels.unionByName(rest.select("node", F.lit(level + 1).alias("level"))))
        level += 1


def _cliques_of(first: int, pairs: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Cliques of ``first`` and its neighbours that no other of these neighbours extends; ``pairs`` lie among them."""
    near: dict[int, set[int]] = {}
    for p, q in pairs:
        near.setdefault(p, set()).add(q)
        near.setdefault(q, set()).add(p)
    near = {x: ys - {x} for x, ys in near.items()}
    stack = [((first,), set(near), set())]
    while stack:
        chosen, candidates, excluded = stack.pop()
        if not candidates:
            if not excluded:
                yield sorted(chosen)
            continue
        pivot = max(sorted(candidates | excluded), key=lambda v: len(near[v] & candidates))
        for v in sorted(candidates - near[pivot]):
            stack.append(((*chosen, v), candidates & near[v], excluded & near[v]))
            candidates = candidates - {v}
            excluded = excluded | {v}


def _first_cliques(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``v, clique`` from rows ``v, p, q`` in the order of ``v``; only one node's pairs are held, whatever the borders of batches."""
    rows = (row for pdf in batches for row in zip(pdf["v"].tolist(), pdf["p"].tolist(), pdf["q"].tolist(), strict=True))
    found = ((v, clique) for v, of in groupby(rows, lambda r: r[0]) for clique in _cliques_of(v, [(p, q) for _, p, q in of]))
    while some := list(islice(found, OUT)):
        yield pd.DataFrame(some, columns=["v", "clique"])


def maximal_cliques(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """``component, clique`` for the components that are not complete: a diagnosis, never the basis of a repair.

    Nodes are ordered by peeling, and each is the first of its cliques: a task sees the pairs among the later
    neighbours of one node, never a component. What an earlier node could still extend is no maximal clique; that is
    found by counting the common earlier neighbours of each candidate's members in a join.
    """
    loose = comp.where(~F.col("repairable")).select(F.col("node").alias("a"), "component")
    one = pairs.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(loose, "a")
    one = stored(one)
    both = stored(one.select("a", "b").unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    rank = stored(_peeled(both).select("node", F.struct("level", "node").alias("place")))
    place = lambda key, name: rank.select(F.col("node").alias(key), F.col("place").alias(name))
    later = stored(both.join(place("a", "pa"), "a").join(place("b", "pb"), "b").where("pa < pb").select("a", "b"))
    # v, and pairs among its later neighbours; the neighbours themselves as pairs with themselves
    own = later.select(F.col("a").alias("v"), F.col("b").alias("p"))
    wedge = own.join(later.select(F.col("a").alias("p"), F.col("b").alias("q")), "p").join(own.select("v", F.col("p").alias("q")), ["v", "q"])
    problem = own.select("v", "p", F.col("p").alias("q")).unionByName(wedge.select("v", "p", "q"))

    # very many nodes have few pairs each, so a batch holds many of them; the number of tasks is given, as rows this small would be merged into one
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(problem.repartition(n, "v").sortWithinPartitions("v").mapInPandas(_first_cliques, "v bigint, clique array<bigint>"))
    earlier = later.select(F.col("b").alias("member"), F.col("a").alias("u"))
    member = found.select("clique", F.size("clique").alias("n"), F.explode("clique").alias("member"))
    extended = member.join(earlier, "member").groupBy("clique", "n", "u").agg(F.count(F.lit(1)).alias("c")).where("c = n").select("clique").distinct()
    kept = found.join(extended, "clique", "left_anti")
    return kept.join(comp.select(F.col("node").alias("v"), "component"), "v").select("component", "clique")
