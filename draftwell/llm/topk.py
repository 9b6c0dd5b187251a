"""Exact top-k search by integer inner product with pivot-table elimination.

The inner product of q and x is (|q|^2 + |x|^2 - d(q, x)^2) / 2, and by the triangle inequality d(q, x) is at least
|d(q, p) - d(x, p)| for every pivot p. The table of distances to the pivots therefore gives each candidate an upper
bound, the best over many pivots (the origin among them). Candidates are evaluated in the order of their bounds until
the bound is under the worst of the best k: nothing behind it can enter, ties included.

Equal vectors are searched once: of each different vector only the k + 1 least identifiers can appear in a result, which
a window finds, limited before the shuffle. Different vectors are sorted by nearest pivot and cut into blocks of at most
``BLOCK`` vectors. A query first sees the block that it lies in, which gives its least acceptable score; then the
ranges of pivot distances of all blocks, in chunks, tell which blocks it must visit; it visits those. Blocks stand still
in groups of at most ``GROUP`` bytes (a block at least) while queries stream past them: a query goes once to each group, with
the blocks that it must visit there, best bound first, and each block raises the score that the next must reach. A task
holds one group, and batches of rows are taken and given in pieces of bounded size.

Pivots are chosen from at most ``SAMPLE`` vectors (farthest first); every vector is indexed and the search is exact
whatever the pivots are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut, table
from .batches import slices

PIVOTS, SAMPLE = 16, 2000
BLOCK, VALUES = 1024, 1 << 20
CHUNK = 4096
GROUP, GROUPS, GIVEN, TAKEN = 16 << 20, 24, 2048, 256
STEP = 64
EVERY, TOP, SCALE = 50, 5, 256
_EXACT = 2.0**53
_LONG = 2**63 - 1


def _padded(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: min(len(v), width)] = v[:width]
    return out


def _distances(x: np.ndarray, pivots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the rows to all pivots, and the rows' squared lengths; missing components count as zero."""
    square = np.einsum("ij,ij->i", x, x)
    p = _padded(pivots, x.shape[1])
    to = square[:, None] + np.array([v @ v for v in pivots])[None, :] - 2 * (x @ p.T)
    return np.sqrt(np.maximum(to, 0)), square


def _bound(square_q: float, square_x: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Upper bound of the inner product if the distance is at least ``least``, with room for rounding."""
    size = square_q + square_x
    return (size - least * least) / 2 + np.where(size < _EXACT / 2, 1e-9, 1e-5) * size + 1


def _products(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Exact inner products, kept within the range of a long."""
    w = min(x.shape[1], len(q))
    x, q = x[:, :w], q[:w]
    if np.sqrt((x * x).sum(axis=1).max(initial=0.0)) * np.sqrt(q @ q) < _EXACT / 2:
        return (x @ q).astype(np.int64).tolist()
    whole = [int(v) for v in q]
    return [max(-_LONG, min(_LONG, sum(int(a) * b for a, b in zip(row, whole, strict=True)))) for row in x]


class _Block:
    def __init__(self, gids: np.ndarray, least: np.ndarray, x: np.ndarray, far: np.ndarray, square: np.ndarray) -> None:
        self.gids, self.least, self.x, self.far, self.square = gids, least, x, far, square

    def best(self, q: np.ndarray, far: np.ndarray, square: float, k: int, floor: int | None) -> list[tuple[int, int, int]]:
        """(-score, least id, gid) of the best ``k``, or those of ``floor`` and more among them, by elimination in bound order."""
        bound = _bound(square, self.square, np.abs(self.far - far).max(axis=1))
        order = np.argsort(-bound, kind="stable")
        found: list[tuple[int, int, int]] = []
        for at in range(0, len(order), STEP):
            worst = max(x for x in (-found[-1][0] if len(found) == k else None, floor, -(1 << 80)) if x is not None)
            few = order[at : at + STEP]
            few = few[bound[few] >= worst]
            if not len(few):
                break
            found += [(-s, int(self.least[i]), int(self.gids[i])) for i, s in zip(few, _products(self.x[few], q), strict=True) if s >= worst]
            found = sorted(found)[:k]
        return found


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of a few rows: rows of vectors are large as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, TAKEN):
            yield batch.slice(at, TAKEN)


def _measured(pivots: list[np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pivot table: nearest pivot, distance to it."""
    for batch in _pieces(batches):
        cells, near = [], []
        for v in batch.column("vec").to_pylist():
            far, _ = _distances(np.array([v], dtype=float).reshape(1, -1), pivots)
            cells.append(int(far[0].argmin()))
            near.append(float(far[0].min()))
        yield pa.record_batch([*batch.columns, pa.array(cells, pa.int32()), pa.array(near, pa.float64())], [*batch.schema.names, "cell", "near"])


_BUILT = "block bigint, gid bigint, floor bigint, gids array<bigint>, least array<bigint>, data binary, width int, far binary, square binary, low binary, high binary, most double"
_NAMES = [c.split()[0] for c in _BUILT.split(", ")]


def _built(pivots: list[np.ndarray], k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the sorted vectors, and a row for each query in them with the score that it already has ``k`` times."""
    held: list[tuple[int, int, bool, np.ndarray]] = []

    def done() -> pa.RecordBatch:
        width = max(len(h[3]) for h in held)
        x = _padded([h[3] for h in held], width)
        far, square = _distances(x, pivots)
        block = _Block(np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64), x, far, square)
        name = held[0][0]
        rows = [[name, None, None, block.gids.tolist(), block.least.tolist(), x.tobytes(), width, far.tobytes(), square.tobytes(), far.min(axis=0).tobytes(), far.max(axis=0).tobytes(), float(square.max())]]
        for i, (gid, _, asks, v) in enumerate(held):
            if asks:
                own = block.best(x[i], far[i], square[i], k, None)
                rows.append([name, gid, -own[-1][0] if len(own) == k else None, None, None, v.tobytes(), len(v), far[i].tobytes(), square[i : i + 1].tobytes(), None, None, None])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)

    width = 0
    for batch in _pieces(batches):
        for gid, least, asks, vec in zip(*(batch.column(c).to_pylist() for c in ("gid", "least", "asks", "vec")), strict=True):
            if held and (len(held) >= BLOCK or (len(held) + 1) * max(width, len(vec)) > VALUES):
                yield done()
                held, width = [], 0
            held.append((gid, least, asks, np.array(vec, dtype=float)))
            width = max(width, len(vec))
    if held:
        yield done()


def _routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by chunk and piece, ranges of blocks before queries; each query names, a group at a time, the blocks that it must visit."""
    own, blocks, ranges = None, [], None
    names = ["chunk", "piece", "gid", "floor", "block", "far", "square", "low", "high", "most", "kin"]
    for batch in _pieces(batches):
        to: list[tuple[int, list[int], list[float]]] = []
        took: list[int] = []

        def given() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
            visits = [pa.array([t[k] for t in to], kind) for k, kind in enumerate(kinds)]  # noqa: B023
            columns = [batch.column(c).take(pa.array(took, pa.int64())) for c in ("gid", "floor", "data", "far", "square")]  # noqa: B023
            return pa.record_batch([*visits, *columns], ["kin", "must", "bounds", "gid", "floor", "data", "far", "square"])

        for i, (chunk, piece, gid, floor, block, far, square, low, high, most, kin) in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
            if own != (chunk, piece):
                own, blocks, ranges = (chunk, piece), [], None
            if gid is None:
                blocks.append((block, np.frombuffer(low), np.frombuffer(high), most, kin))
                continue
            if ranges is None:
                ranges = [np.array([b[j] for b in sorted(blocks, key=lambda b: b[4])]) for j in range(5)]
            if not len(ranges[0]):
                continue
            f, s = np.frombuffer(far), np.frombuffer(square)[0]
            gap = np.maximum(0, np.maximum(ranges[1] - f, f - ranges[2])).max(axis=1)
            bound = _bound(s, ranges[3], gap)
            must = np.arange(len(bound)) if floor is None else np.flatnonzero(bound >= floor)
            must = must[np.lexsort((-bound[must], ranges[4][must]))]
            for part in np.split(must, np.flatnonzero(np.diff(ranges[4][must])) + 1):
                if len(part):
                    to.append((int(ranges[4][part[0]]), ranges[0][part].tolist(), bound[part].tolist()))
                    took.append(i)
                    if len(took) >= GIVEN:
                        yield given()
                        to, took = [], []
        if took:
            yield given()


def _visited(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by group, its blocks before the queries; each query leaves its best of the group."""
    kin, group = None, {}
    names = ["kin", "gid", "floor", "must", "bounds", "block", "gids", "least", "data", "width", "far", "square"]
    for batch in slices(batches, names.index("data"), GROUP):
        out: list[tuple[int, int, int, int]] = []
        for batch_ in _pieces([batch]):
            for own, gid, floor, must, bounds, block, gids, least, data, width, far, square in zip(*(batch_.column(c).to_pylist() for c in names), strict=True):
                if own != kin:
                    kin, group = own, {}
                if gid is None:
                    n = len(gids)
                    group[block] = _Block(np.array(gids), np.array(least), np.frombuffer(data).reshape(n, width), np.frombuffer(far).reshape(n, -1), np.frombuffer(square))
                    continue
                q, f, s = np.frombuffer(data), np.frombuffer(far), np.frombuffer(square)[0]
                found: list[tuple[int, int, int]] = []
                for name, bound in zip(must, bounds, strict=True):
                    if floor is not None and bound < floor:
                        break  # the others' bounds are no better
                    found = sorted(found + group[name].best(q, f, s, k, floor))[:k]
                    if len(found) == k:
                        floor = max(-found[-1][0], floor if floor is not None else -found[-1][0])
                out += [(gid, at, first, -score) for score, first, at in found]
        if out:
            yield pa.record_batch([pa.array([r[j] for r in out], pa.int64()) for j in range(4)], ["gid", "at", "first", "score"])


def _pivots(vectors: DataFrame, many: int) -> list[np.ndarray]:
    """The origin and vectors of a sample, each the farthest from those before."""
    drawn = [np.array(r[0], dtype=float) for r in vectors.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()]
    chosen = [np.zeros(1)]
    if drawn:
        x = _padded(drawn, max(map(len, drawn)))
        away = _distances(x, chosen)[0][:, 0]
        for _ in range(min(many - 1, len(drawn))):
            i = int(away.argmax())
            chosen.append(drawn[i])
            away = np.minimum(away, _distances(x, [drawn[i]])[0][:, 0])
    return chosen


def whole(vec: Column, scale: int = SCALE) -> Column:
    """Each component as a whole double, floor(``scale`` * x); null for vectors with a component that is null or not finite."""
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = lambda x: x.cast("double") * scale
    floor = lambda x: F.when(F.abs(scaled(x)) < _EXACT, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)) + F.lit(0.0)
    return F.when(vec.isNotNull() & good, F.transform(vec, floor))


def top_k(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = TOP, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``queries`` holds its ``k`` highest integer inner products with other rows.

    Ties go to the smaller identifier, a null identifier last. Rows are told apart even if they share an identifier or a
    vector: each is a query of its own and can be found by the others. Vectors that are null or hold a null or non-finite
    component take no part. Missing components of shorter vectors count as zero. Scores beyond a long stop at its
    ends. Other columns are not read. No rows: no rows.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), whole(F.col(vec_col)).alias("vec")).where(F.col("vec").isNotNull())
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    spark, n = vectors.sparkSession, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.row_number().over(Window.partitionBy("vec").orderBy(F.asc_nulls_last("id"), "row"))
    few = rows.select("vec", "id", "row").withColumn("place", place).where(F.col("place") <= k + 1)
    groups = few.groupBy("vec").agg(F.sort_array(F.collect_list(F.struct("place", "id", "row"))).alias("ids"))  # at most k + 1
    groups = groups.join(rows.where("asks").select("vec").distinct().withColumn("asks", F.lit(True)), "vec", "left")
    groups = cut(groups.select(F.monotonically_increasing_id().alias("gid"), "vec", "ids", F.coalesce("asks", F.lit(False)).alias("asks")))
    chosen = _pivots(groups, pivots)
    at = groups.select("gid", F.coalesce(F.col("ids")[0]["id"].cast("bigint"), F.lit(_LONG)).alias("least"), "asks", "vec")
    at = at.mapInArrow(partial(_measured, chosen), "gid bigint, least bigint, asks boolean, vec array<double>, cell int, near double")
    sorted_ = at.repartitionByRange(n, "cell", "near", "gid").sortWithinPartitions("cell", "near", "gid")
    built = cut(sorted_.mapInArrow(partial(_built, chosen, k + 1), _BUILT))
    asked = built.where(F.col("gid").isNotNull())
    blocks = built.where(F.col("gid").isNull())
    counts = built.agg(F.count_if(F.col("gid").isNull()).alias("blocks"), F.count("gid").alias("asks"), F.sum(F.when(F.col("gid").isNull(), F.length("data") + F.length("far"))).alias("bytes")).first()
    chunks, pieces = max(1, -(-counts.blocks // CHUNK)), max(1, -(-counts.asks // (4 * CHUNK)), min(GROUPS, counts.asks // TAKEN))
    kins = max(1, -(-(counts.bytes or 0) // GROUP), min(counts.blocks, GROUPS))
    spread = lambda col, most: F.pmod(F.xxhash64(col), F.lit(most)).cast("int")
    every = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    blocks = blocks.withColumn("kin", spread("block", kins).cast("bigint"))
    ranges = blocks.withColumn("data", F.lit(None).cast("binary")).withColumn("far", F.lit(None).cast("binary")).withColumn("chunk", spread("block", chunks)).withColumn("piece", every(pieces))
    routed = ranges.unionByName(asked.withColumn("chunk", every(chunks)).withColumn("piece", spread("gid", pieces)), allowMissingColumns=True)
    routed = routed.drop("gids", "least").repartition(n, "chunk", "piece").sortWithinPartitions("chunk", "piece", F.asc_nulls_first("gid"))
    visits = routed.mapInArrow(_routed, "kin bigint, must array<bigint>, bounds array<double>, gid bigint, floor bigint, data binary, far binary, square binary")
    met = blocks.select("kin", "block", "gid", "floor", "gids", "least", "data", "width", "far", "square").unionByName(visits, allowMissingColumns=True)
    met = met.select("kin", "gid", "floor", "must", "bounds", "block", "gids", "least", "data", "width", "far", "square")
    met = met.repartition(n, "kin").sortWithinPartitions("kin", F.asc_nulls_first("gid"))
    hits = met.mapInArrow(partial(_visited, k + 1), "gid bigint, at bigint, first bigint, score bigint")
    order = Window.partitionBy("gid").orderBy(F.desc("score"), "first", "at")
    hits = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).select("gid", "at", "score")
    named = hits.join(groups.select(F.col("gid").alias("at"), F.explode("ids").alias("x")), "at").select("gid", "score", F.col("x.id").alias("vec_id"), F.col("x.row").alias("other"))
    per_row = rows.where("asks").select(F.col("id").alias("query_id"), "row", "vec").join(groups.select("vec", "gid"), "vec").drop("vec")
    found = per_row.join(named, "gid").where(F.col("row") != F.col("other"))
    last = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")
    return found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.w, v.w)::BIGINT AS score FROM v q, v WHERE q.vec_id % {EVERY} = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
