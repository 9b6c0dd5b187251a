"""Flattening of nested containers to occurrences in world coordinates.

Nodes are rows ``node_id, parent_id, kind, def_id, pid, name, layer, visible, valid, m (16 numbers, row-major), sx..ez,
outer_loop_vertex_count, loop_count``. A group's children name it as their parent; an instance shows the children of its
definition, each time it is placed. The walk is a loop of joins, one a level, bounded by the depth of the data: all
occurrences of a level move at once, and a container that recurs on its own path ends there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import DEFAULT_LAYER, container_label, finite, role_rank, layer_role, layer_role_rule, visibility
from ..session import cut

IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
CONTAINERS = ("group", "instance")


def identity() -> Column:
    return F.array(*[F.lit(v) for v in IDENTITY])


def usable_transform(m: Column) -> Column:
    """Sixteen finite numbers, or the identity."""
    good = (F.size(m) == 16) & F.forall(m, lambda v: finite(v))
    return F.when(F.coalesce(good, F.lit(False)), m).otherwise(identity())


def usable_transform_of(m: list[float] | None) -> Column:
    """A literal of sixteen finite numbers (flat or as four rows of four), or the identity."""
    flat = [v for row in m for v in (row if isinstance(row, (list, tuple)) else [row])] if m else []
    good = len(flat) == 16 and all(isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) for v in flat)
    return F.array(*[F.lit(float(v)) for v in flat]) if good else identity()


def combined(parent: Column, own: Column) -> Column:
    """world = parent x own. One lambda over the sixteen places: written out, the products exceed what one method can hold."""
    at = lambda a, i: F.get(a, i.cast("int"))

    def place(i: Column) -> Column:
        row, col = F.floor(i / 4) * 4, i % 4
        return sum((at(parent, row + k) * at(own, col + 4 * k) for k in range(1, 4)), at(parent, row) * at(own, col))

    return F.transform(F.sequence(F.lit(0), F.lit(15)), place)


def applied(m: Column, x: Column, y: Column, z: Column) -> list[Column]:
    at = lambda i: F.get(m, F.lit(i))
    return [at(4 * r) * x + at(4 * r + 1) * y + at(4 * r + 2) * z + at(4 * r + 3) for r in range(3)]


def flatten(
    nodes: DataFrame, roots: DataFrame | None = None, max_depth: int = 64, active_path: tuple[int | None, ...] = (), active_transform: list[float] | None = None
) -> DataFrame:
    """All occurrences below the roots (``parent_id`` null by default): nodes with ``depth, path, labels, complete, world``.

    ``depth`` counts the containers above; ``path`` has the pids that exist, the node's own last; ``complete`` says that
    none was missing. Invalid, erased and unknown-validity nodes are dropped with all below them. Raises when the tree is
    deeper than ``max_depth``.
    """
    live = cut(nodes.where(F.coalesce("valid", F.lit(False))).withColumn("m", usable_transform(F.col("m"))))
    start = roots if roots is not None else live.where("parent_id IS NULL AND kind IN ('group', 'instance', 'edge', 'face')")
    pid = lambda: F.when(F.col("pid").isNotNull(), F.array("pid")).otherwise(F.array().cast("array<bigint>"))
    known = [p for p in active_path if p is not None]
    above = F.array(*[F.lit(p).cast("bigint") for p in known]).cast("array<bigint>")
    seed = usable_transform_of(active_transform)
    level = start.select(
        "*", F.lit(len(active_path)).alias("depth"), F.concat(above, pid()).alias("path"), F.array(F.coalesce("name", F.col("kind"))).alias("labels"), (F.col("pid").isNotNull() & F.lit(len(known) == len(active_path))).alias("complete"),
        F.when(F.col("kind").isin(*CONTAINERS), combined(seed, F.col("m"))).otherwise(seed).alias("world"), F.array("node_id").alias("seen"),
    )
    out = level
    for depth in range(1, max_depth + 1):
        hosts = level.where(F.col("kind").isin(*CONTAINERS)).select(
            F.coalesce(F.when(F.col("kind") == "instance", F.col("def_id")), F.col("node_id")).alias("parent_id"),
            F.col("path").alias("up_path"), F.col("labels").alias("up_labels"), F.col("complete").alias("up_complete"), F.col("world").alias("up_world"), F.col("seen").alias("up_seen"),
        )
        if not hosts.limit(1).count():
            return out
        below = live.join(hosts, "parent_id").where(~F.array_contains("up_seen", F.col("node_id")))
        below = below.where(F.col("kind").isin("group", "instance", "edge", "face"))
        level = below.select(
            *nodes.columns, F.lit(depth + len(active_path)).alias("depth"), F.concat("up_path", pid()).alias("path"), F.concat("up_labels", F.array(F.coalesce("name", F.col("kind")))).alias("labels"),
            (F.col("up_complete") & F.col("pid").isNotNull()).alias("complete"),
            F.when(F.col("kind").isin(*CONTAINERS), combined(F.col("up_world"), F.col("m"))).otherwise(F.col("up_world")).alias("world"),
            F.concat("up_seen", F.array("node_id")).alias("seen"),
        )
        level = cut(level)
        out = out.unionByName(level)
    raise RecursionError(f"containers nest deeper than {max_depth} levels")


def world_edges(occurrences: DataFrame) -> DataFrame:
    """Edges of the walk in world coordinates; one with a missing end is dropped whole."""
    rows = occurrences.where("kind = 'edge'")
    s, e = (applied(F.col("world"), F.col(f"{p}x"), F.col(f"{p}y"), F.col(f"{p}z")) for p in "se")
    ends = [c.alias(n) for c, n in zip([*s, *e], ["sx", "sy", "sz", "ex", "ey", "ez"], strict=True)]
    return rows.select(
        F.col("node_id").alias("edge_id"), *ends, F.coalesce(F.nullif("layer", F.lit("")), F.lit(DEFAULT_LAYER)).alias("layer"), F.col("node_id").alias("entity_id"), F.col("pid").alias("persistent_id"),
        F.col("path").alias("pid_path"), F.slice("labels", 1, F.greatest(F.size("labels") - 1, F.lit(0))).alias("instance_path"), F.col("depth").alias("structural_depth"), F.col("complete").alias("pid_path_complete"),
    ).where("sx IS NOT NULL AND sy IS NOT NULL AND sz IS NOT NULL AND ex IS NOT NULL AND ey IS NOT NULL AND ez IS NOT NULL")


def faces(occurrences: DataFrame) -> DataFrame:
    """Faces of the walk; inner loops are all loops but the outer one."""
    return occurrences.where("kind = 'face'").select(
        F.col("node_id").alias("face_id"), F.coalesce(F.nullif("layer", F.lit("")), F.lit(DEFAULT_LAYER)).alias("layer"), F.coalesce("outer_loop_vertex_count", F.lit(0)).alias("outer_loop_vertex_count"),
        F.greatest(F.coalesce("loop_count", F.lit(0)) - 1, F.lit(0)).alias("inner_loop_count"), F.col("path").alias("pid_path"), F.col("depth").alias("structural_depth"), F.col("complete").alias("pid_path_complete"),
    )


def container_facts(occurrences: DataFrame) -> DataFrame:
    """One row: occurrences of groups and instances, and the deepest nesting (a root container is level 1)."""
    return occurrences.agg(
        F.count_if(F.col("kind") == "group").alias("group_count"), F.count_if(F.col("kind") == "instance").alias("component_count"),
        F.coalesce(F.max(F.when(F.col("kind").isin(*CONTAINERS), F.col("depth") + 1)), F.lit(0)).cast("bigint").alias("deepest_nesting"),
    )


def container_counts(nodes: DataFrame, max_depth: int = 64) -> DataFrame:
    """As :func:`container_facts` of the whole walk, without expanding it: how often a container is placed at a depth is the sum
    over its hosts of how often they are placed one level above, so a level is one aggregate over distinct containers.

    A container that can hold itself recurs only as often as paths allow, which counts cannot tell: then the walk is made.
    """
    live = nodes.where(F.coalesce("valid", F.lit(False))).where(F.col("kind").isin(*CONTAINERS))
    boxes = cut(live.select("node_id", "parent_id", "kind", F.when(F.col("kind") == "instance", F.coalesce("def_id", "node_id")).otherwise(F.col("node_id")).alias("host")))
    number = F.lit(1).cast("decimal(38,0)")
    level = cut(boxes.where("parent_id IS NULL").select("kind", "host", number.alias("n")))
    levels, distinct = [], boxes.count()
    while level.limit(1).count():
        if len(levels) > min(distinct, max_depth):
            return container_facts(flatten(live, max_depth=max_depth))
        levels.append(level.groupBy("kind").agg(F.sum("n").alias("n"), F.lit(len(levels) + 1).cast("bigint").alias("depth")))
        placed = level.groupBy(F.col("host").alias("parent_id")).agg(F.sum("n").alias("n"))
        level = cut(boxes.join(placed, "parent_id").groupBy("kind", "host").agg(F.sum("n").alias("n")))
    if not levels:
        return container_facts(flatten(live.limit(0)))
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).cast("bigint")
    return every.agg(of("group").alias("group_count"), of("instance").alias("component_count"), F.coalesce(F.max("depth"), F.lit(0)).cast("bigint").alias("deepest_nesting"))


def labelled(nodes: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """Nodes whose containers are named by their labels, so that a walk over them has the labels as its paths.

    ``definitions`` has ``def_id, def_name``, one row a definition; containers of a definition without a name, or without a row,
    go by their own. Other nodes keep their names.
    """
    rows = nodes.withColumn("__def", F.lit(None).cast("string")) if definitions is None else nodes.join(definitions.select("def_id", F.col("def_name").alias("__def")), "def_id", "left")
    label = container_label(F.col("kind"), F.col("__def"), F.col("name"), F.col("node_id"))
    return rows.withColumn("name", F.when(F.col("kind").isin(*CONTAINERS), label).otherwise(F.col("name"))).select(*nodes.columns)


def selection_label(roots: DataFrame, order: str = "node_id") -> DataFrame:
    """One row with ``selection_label``: kind and name of the first thing selected (the least ``order``) if that has a name, else ``selection``."""
    kinds = F.create_map(*[F.lit(x) for x in ("group", "Group", "instance", "ComponentInstance")])
    first = roots.agg(F.min_by(F.struct(F.col("kind"), F.col("name")), F.col(order)).alias("f"))
    return first.select(F.coalesce(F.concat(F.try_element_at(kinds, F.col("f.kind")), F.lit(": "), F.col("f.name")), F.lit("selection")).alias("selection_label"))


def selection_type(roots: DataFrame) -> DataFrame:
    """``empty``, the single kind that is selected, or ``mixed``."""
    kinds = F.collect_set(F.when(F.col("kind").isin("group", "instance", "edge", "face"), F.col("kind")).otherwise("other"))
    return roots.agg(kinds.alias("k")).select(F.when(F.size("k") == 0, "empty").when(F.size("k") == 1, F.get("k", F.lit(0))).otherwise("mixed").alias("selection_type"))


def layer_records(edges: DataFrame, faces_: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """``name, edge_count, face_count, faces_with_holes_count, role, role_rule, visible, visibility_unknown, display_rank``."""
    e = edges.select(F.col("layer").alias("name"), F.lit(1).alias("e"), F.lit(0).alias("f"), F.lit(0).alias("h"))
    f = faces_.select(F.col("layer").alias("name"), F.lit(0).alias("e"), F.lit(1).alias("f"), (F.col("inner_loop_count") > 0).cast("int").alias("h"))
    rows = e.unionByName(f).groupBy("name").agg(F.sum("e").alias("edge_count"), F.sum("f").alias("face_count"), F.sum("h").alias("faces_with_holes_count"))
    rows = rows.join(visible, "name", "left") if visible is not None else rows.withColumn("shown", F.lit(None).cast("boolean"))
    shown, unknown = visibility(F.col("shown"))
    role = layer_role(F.col("name"))
    return rows.select("name", "edge_count", "face_count", "faces_with_holes_count", role.alias("role"), layer_role_rule(F.col("name")).alias("role_rule"), shown.alias("visible"), unknown.alias("visibility_unknown"), role_rank(role).alias("role_rank"))
