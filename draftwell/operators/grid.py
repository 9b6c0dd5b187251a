"""Tolerance joins through a grid.

Catalyst plans a band predicate as a nested loop. Here every point on the build side is filed under its one cell, and a
point on the probe side asks the cells that its tolerance box touches. Cells are ``WIDE`` tolerances wide, so nearly
every box lies in one cell on all axes (1.03 cells on average an axis) and is filed without a list; the join is an
equi-join that shuffles, splits under skew and spills like any other. Drawings are full of round coordinates, so borders of
cells stand off them: with a border at zero every point of a plane drawing would ask both sides of it, on each such axis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import distance, normalized_layer

WIDE = 64.0
OFF = 13 / 32  # share of a cell by which borders are moved: between the sixteenths, two tolerances from either
START, END = ["sx", "sy", "sz"], ["ex", "ey", "ez"]


def grid_join(probe: DataFrame, build: DataFrame, probe_point: list[str], build_point: list[str], tol: float, keys: list[str], size: float | None = None) -> DataFrame:
    """Candidate pairs: equal ``keys`` and neighbouring points. The exact predicate is the caller's.

    Columns of the two sides must differ, but for ``keys``. Points that are not finite find nothing. The join key is one
    long, a chained hash of keys and cells; keys are compared on what meets, nearness is the caller's to test.
    """
    size = size or tol * WIDE
    n = range(len(probe_point))
    at = lambda x, shift: f"CAST(floor((({x} {shift}) + {_number(size * OFF)}) / {_number(size)}) AS BIGINT)"
    low = [f"{at(c, f'- {_number(tol)}')} AS __l{i}" for i, c in enumerate(probe_point)]
    high = [f"{at(c, f'+ {_number(tol)}')} AS __h{i}" for i, c in enumerate(probe_point)]
    seed = one = f"xxhash64({', '.join(['0', *keys])})"
    many = f"array({seed})"
    for i in n:
        one, many = f"xxhash64({one}, __l{i})", f"flatten(transform({many}, h{i} -> transform(sequence(__l{i}, __h{i}), c{i} -> xxhash64(h{i}, c{i}))))"
    alone = " AND ".join(f"__l{i} = __h{i}" for i in n)
    left = probe.where(finite_sql(probe_point)).selectExpr("*", *low, *high).selectExpr(*probe.columns, f"explode(CASE WHEN {alone} THEN array({one}) ELSE {many} END) AS __h")
    right = build.where(finite_sql(build_point)).selectExpr(*[f"{c} AS __r_{c}" if c in keys else c for c in build.columns])
    filed = f"xxhash64({', '.join(['0', *[f'__r_{k}' for k in keys]])})"
    for c in build_point:
        filed = f"xxhash64({filed}, {at(c, '+ 0D')})"
    met = left.join(right.selectExpr("*", f"{filed} AS __h"), "__h")
    if keys:
        met = met.where(" AND ".join(f"{k} = __r_{k}" for k in keys))
    return met.drop("__h", *[f"__r_{k}" for k in keys])


def filed(rows: DataFrame, points: list[list[str]], tol: float, keys: list[str], size: float | None = None) -> DataFrame:
    """``rows`` with the cells that their boxes touch: ``__h``, once each, and whether it is the row's own cell, ``__home``.

    With two ``points`` a cell is the unordered pair of theirs, so rows that hold the same points in the other order share it.
    """
    size = size or tol * WIDE
    at = lambda x: f"CAST(floor((({x}) + {_number(size * OFF)}) / {_number(size)}) AS BIGINT)"
    seed = f"xxhash64({', '.join(['0', *keys])})"
    low = [f"{at(f'{c} - {_number(tol)}')} AS __l{j}_{i}" for j, p in enumerate(points) for i, c in enumerate(p)]
    high = [f"{at(f'{c} + {_number(tol)}')} AS __h{j}_{i}" for j, p in enumerate(points) for i, c in enumerate(p)]
    homes, alls = [], []
    for j, p in enumerate(points):
        one, many = seed, f"array({seed})"
        for i, c in enumerate(p):
            one = f"xxhash64({one}, {at(f'{c} + 0D')})"
            many = f"flatten(transform({many}, h{i} -> transform(sequence(__l{j}_{i}, __h{j}_{i}), c{i} -> xxhash64(h{i}, c{i}))))"
        homes.append(f"{one} AS __own{j}")
        alls.append(many)
    alone = " AND ".join(f"__l{j}_{i} = __h{j}_{i}" for j, p in enumerate(points) for i in range(len(p)))
    if len(points) == 1:
        home, touched = "__own0", alls[0]
    else:
        both = lambda a, b: f"xxhash64(least({a}, {b}), greatest({a}, {b}))"
        home = both("__own0", "__own1")
        touched = f"array_distinct(flatten(transform({alls[0]}, a -> transform({alls[1]}, b -> {both('a', 'b')}))))"
    at_home = rows.where(finite_sql([c for p in points for c in p])).selectExpr("*", *low, *high, *homes).selectExpr("*", f"{home} AS __own")
    return at_home.selectExpr(*rows.columns, "__own", f"explode(CASE WHEN {alone} THEN array(__own) ELSE {touched} END) AS __h").selectExpr(*rows.columns, "__h", "__h = __own AS __home")


def grid_pairs(rows: DataFrame, name: str, points: list[list[str]], tol: float, keys: list[str], size: float | None = None) -> DataFrame:
    """Candidate pairs within ``rows``, columns ``p_*`` and ``q_*``, ``p_name < q_name``, each pair once.

    Rows are filed once, and both sides of the join read that one exchange; a pair is met in the home of its later row. The
    exact predicate is the caller's.
    """
    once = filed(rows, points, tol, keys, size)
    side = lambda x: once.selectExpr(*[f"{c} AS {x}_{c}" for c in rows.columns], f"__home AS __{x}", "__h")
    same = " AND ".join([f"p_{name} < q_{name}", *[f"p_{k} = q_{k}" for k in keys]])
    # both homes are read by either side, so that the two exchanges are one
    return side("p").join(side("q"), "__h").where(same).where(f"CASE WHEN p_{name} < q_{name} THEN __q ELSE __p END").drop("__h", "__p", "__q")


def _number(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def finite_sql(names: list[str]) -> str:
    return " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('Infinity')" for c in names)


def _sides(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = edges.where(finite_sql(START + END)).select("edge_id", *START, *END, normalized_layer(F.col("layer")).alias("norm_layer"))
    return tuple(good.selectExpr(f"edge_id AS id_{p}", "norm_layer", *[f"{c} AS {p}_{c}" for c in START + END]) for p in "ab")


def match_kind(tol: float) -> Column:
    """``forward`` before ``reversed``, null if the ends do not meet."""
    near = lambda p, q: " AND ".join(f"abs(a_{x} - b_{y}) <= {_number(tol)}" for x, y in zip(p, q, strict=True))
    return F.expr(f"CASE WHEN {near(START, START)} AND {near(END, END)} THEN 'forward' WHEN {near(START, END)} AND {near(END, START)} THEN 'reversed' END")


def duplicate_pairs(edges: DataFrame, tol: float, of: DataFrame | None = None) -> DataFrame:
    """``id_a < id_b, kind, norm_layer`` and both edges' ends, once for each pair of edges that coincide within ``tol``.

    Edges on different normalized layers never match, nor do edges with an end that is not finite. ``tol`` 0 means
    exact equality (0.0 equals -0.0). The cells of both ends are the key, so edges that share one end only never meet. The
    other edge is filed in both orientations; a pair is met once in each that it matches in and needs no deduplication.
    With ``of``, some of the edges, only their pairs are listed: ``id_a`` is one of them and ``id_b`` any other edge.
    """
    a, b = _sides(edges)
    order = "id_a < id_b"
    if of is not None:
        a, order = _sides(of)[0], "id_a <> id_b"
    if tol == 0:
        return _exact_pairs(a, b, order)
    if of is None:
        good = edges.where(finite_sql(START + END)).select("edge_id", *START, *END, normalized_layer(F.col("layer")).alias("norm_layer"))
        met = grid_pairs(good, "edge_id", [START, END], tol, ["norm_layer"])
        met = met.selectExpr("p_edge_id AS id_a", "p_norm_layer AS norm_layer", "q_edge_id AS id_b", *[f"{x}_{c} AS {y}_{c}" for x, y in (("p", "a"), ("q", "b")) for c in START + END])
        return met.withColumn("kind", match_kind(tol)).where("kind IS NOT NULL")
    both = ", ".join(f"struct({k} AS k, {', '.join(f'b_{c} AS p{i}' for i, c in enumerate(p))})" for k, p in ((0, START + END), (1, END + START)))
    turned = b.selectExpr("id_b", "norm_layer", f"explode(array({both})) AS t").selectExpr("id_b", "norm_layer", "t.k AS __k", *[f"t.p{i} AS __p{i}" for i in range(6)])
    met = grid_join(a, turned, [f"a_{c}" for c in START + END], [f"__p{i}" for i in range(6)], tol, ["norm_layer"]).where(order)
    met = met.selectExpr("*", *[f"CASE WHEN __k = 0 THEN __p{i} ELSE __p{(i + 3) % 6} END AS b_{c}" for i, c in enumerate(START + END)]).withColumn("kind", match_kind(tol))
    return met.where("(kind = 'forward' AND __k = 0) OR (kind = 'reversed' AND __k = 1)").drop("__k", *[f"__p{i}" for i in range(6)])


def _exact_pairs(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    point = lambda side, cols: F.struct(*[(F.col(f"{side}_{c}") + F.lit(0.0)).alias(x) for c, x in zip(cols, "xyz", strict=True)])
    key = lambda side: [F.least(point(side, START), point(side, END)).alias("__k1"), F.greatest(point(side, START), point(side, END)).alias("__k2")]
    met = a.select("*", *key("a")).join(b.select("*", *key("b")), ["norm_layer", "__k1", "__k2"])
    return met.where(order).withColumn("kind", match_kind(0.0)).drop("__k1", "__k2")


def gap_pairs(open_vertices: DataFrame, tol: float) -> DataFrame:
    """Pairs of open vertices (``vertex_id, x, y, z, edge_id``) whose distance is at most ``tol`` and at least 1e-9.

    ``v1 < v2``. Both ends of one edge can be a pair.
    """
    rows = open_vertices.select("vertex_id", "x", "y", "z", "edge_id")
    met = grid_pairs(rows, "vertex_id", [["x", "y", "z"]], tol, [], size=max(tol * 4, 0.4))
    d = distance(*[F.col(f"p_{c}") for c in "xyz"], *[F.col(f"q_{c}") for c in "xyz"])
    return met.withColumn("distance", d).where((F.col("distance") <= tol) & (F.col("distance") >= 1e-9))

