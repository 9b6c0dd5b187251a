"""SimHash near-duplicates linked through BK-trees.

Fingerprints are computed in Arrow batches, then reduced to the distinct ones. Two fingerprints at three or
fewer differing bits agree in one of four 16-bit blocks and, of what is left, in one of four 12-bit blocks;
each fingerprint therefore joins shards keyed by the first bits of these, and every link lies inside a shard.
As many bits are taken as leave about ``FILL`` fingerprints a shard: up to 16 bits there are four shards for each fingerprint,
keyed within one block, beyond that 16, keyed by a block and up to 12 bits of the rest.
A shard is a BK-tree: children hang by their integer Hamming distance to the parent, and a search follows only
edges within the radius. Trees are shuffled to where they are searched, not broadcast: together they are all fingerprints.
Shards of more than ``SHARD`` fingerprints are split into tree parts, and each part is
sent to every query part of that shard, so no task ever holds more than two parts. A task joins its
links into groups and returns, for each member, a pair with the group's least node; the pairs are joined into components.

``similar_groups`` asks for a measured similarity instead: the share of common shingles. Candidates are the links of one
fingerprint and the texts that agree in one of ``BANDS`` bands of ``ROWS`` least hashes (MinHash): two texts at 0.8 share
none in 0.4 % of cases. Only verified pairs are joined, in two rounds that never list the pairs of a group:

1. In a band every text is compared, by its sketch of all least hashes, with the texts that lead it, and offers itself
   to the best of them: one pair a text and band. A large band is dealt to parts; only texts that found no leader in their part
   travel on, are dealt anew and so on, until they fit in one part or hardly get fewer. The pairs are verified on the texts and joined.
2. Bands that still hold several groups are looked at again. Texts whose sketches allow a link to a text of another group
   come together once more, with their texts, and every such pair is measured, unless a link found meanwhile has joined it.
   Bands of many or of long texts are split into parts. A group of more than a part has parts of its own, which meet the parts
   of others but not each other, so a band of one large group and some strangers makes rows in proportion to its texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.components import connected_components
from ..session import cut, table
from .batches import slices
from .exact_dedup import fresh_name

SHARD = 2048
FILL = 64  # fingerprints that a shard holds on average, at most
RADIUS = 3
SEEDS = 12  # fingerprints a text in near_dedup; a pair at 5 bits on average is then found with 97 %
BANDS, ROWS = 18, 6  # a pair at 0.8 shares a band with 1 - (1 - 0.8 ** 6) ** 18 = 99.6 %
BLOCK, BLOCK_SHINGLES = 512, 4_000_000  # most texts, and about most shingles, of a part of a band
_CHUNK = 65_536


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64 bits; a bit is set if it is set in over half of the shingle hashes (XXH64, seed 42)."""
    return signature(text, shingle, 1)[0]


def signature(text: bytes | None, shingle: int, seeds: int) -> list[int]:
    """``seeds`` fingerprints; the first is that of the hashes themselves, the others of remixed hashes."""
    if not (text or b"").split():
        return [0] * seeds
    return _signature(shingles(text, shingle), seeds)


def shingles(text: bytes | None, shingle: int) -> np.ndarray:
    """Hashes of all shingles, in the order of the text; of all the words, if they are fewer than ``shingle``."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if len(words) < shingle:
        return np.array([xxh64_intdigest(b" ".join(words), 42)], dtype="<u8")
    whole = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(whole[s:e], 42) for s, e in spans), "<u8", len(words) - shingle + 1)


def _signature(hashes: np.ndarray, seeds: int) -> list[int]:
    ones = np.zeros((seeds, 64), np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        for k in range(seeds):
            mixed = _remixed(part, k) if k else part
            ones[k] += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), axis=1, bitorder="little").view("<u8").ravel().tolist()


def _remixed(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@cache
def _factors() -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(b"%d" % k) | 1 for k in range(BANDS * ROWS)], dtype=np.uint64)[:, None]


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Keys of the ``BANDS`` bands, and one byte of each of the BANDS * ROWS least hashes."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[at : at + 4096] * _factors()).min(axis=1))
    mixed = _remixed(least, 1)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in mixed.reshape(BANDS, ROWS).T:
        keys = _remixed(keys ^ row, 2)
    return keys.view(np.int64), (mixed >> np.uint64(56)).astype(np.uint8).tobytes()


def _fingerprints(shingle: int, seeds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            marks = np.array([signature(x, shingle, seeds) for x in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            more = pa.ListArray.from_arrays(pa.array(np.arange(len(marks) + 1, dtype=np.int32) * seeds), pa.array(marks.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks[:, 0], pa.int64()), more], names=["id", "fp", "fps"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seeds: int = 1) -> DataFrame:
    """``id, fp, fps`` for every row: the 64 bits as a signed long, and those of all seeds. Wordless texts have zeros."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))
    return rows.mapInArrow(_fingerprints(shingle, seeds), f"id {kind}, fp bigint, fps array<bigint>")


class BKTree:
    """Integers under Hamming distance; a search descends only edges within ``radius`` of the distance at the node."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        if self.values:
            at = 0
            while True:
                d = (x ^ self.values[at]).bit_count()
                if d == 0:
                    return
                nxt = self.edges[at].get(d)
                if nxt is None:
                    self.edges[at][d] = len(self.values)
                    break
                at = nxt
        self.values.append(x)
        self.edges.append({})

    def within(self, x: int, radius: int) -> list[int]:
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (x ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(self.values[at])
            for k, child in self.edges[at].items():
                if d - radius <= k <= d + radius:
                    stack.append(child)
        return found


def _forest(tree: list[tuple[int, int]], asked: list[tuple[int, int]], radius: int) -> list[tuple[int, int]]:
    """Links between the nodes of ``tree`` and of ``asked`` (the same list: within it), as stars around the least node.

    Both are lists of (fingerprint, node). Shards that see the same group give the same stars, which later collapse.
    """
    top: dict[int, int] = {}
    owner: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top.setdefault(up, up)
        return x

    def join(x: int, y: int) -> None:
        if (a := root(x)) != (b := root(y)):
            top[max(a, b)] = min(a, b)

    bk, same = BKTree(), tree is asked
    if not same:
        for x, node in tree:
            bk.add(x)
            join(node, owner.setdefault(x, node))
    for x, node in asked:
        for y in bk.within(x, radius):
            join(node, owner[y])
        if same:
            bk.add(x)
            join(node, owner.setdefault(x, node))
    return [(x, r) for x in list(top) if (r := root(x)) != x]


def _linked(radius: int):
    mask = (1 << 64) - 1
    names = ["a", "b"]

    def solve(rows: np.ndarray) -> pa.RecordBatch | None:
        """rows: shard key, part pair, side (0 tree, 1 query), fingerprint, node; sorted by the first two."""
        if not rows.shape[1]:
            return None
        fresh = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
        begin, end = np.r_[0, fresh], np.r_[fresh, rows.shape[1]]
        size = end - begin
        two = begin[size == 2]
        near = np.bitwise_count((rows[3][two] ^ rows[3][two + 1]).view(np.uint64)) <= radius  # a tree of one node
        out_a, out_b = [rows[4][two][near]], [rows[4][two + 1][near]]
        for s, e in zip(begin[size > 2].tolist(), end[size > 2].tolist(), strict=True):
            side, all_ = rows[2][s:e], [(v & mask, n) for v, n in zip(rows[3][s:e].tolist(), rows[4][s:e].tolist(), strict=True)]
            if side.any():
                pairs = _forest([v for v, k in zip(all_, side, strict=True) if not k], [v for v, k in zip(all_, side, strict=True) if k], radius)
            else:
                pairs = _forest(all_, all_, radius)
            if pairs:
                both = np.array(pairs, dtype=np.int64)
                out_a.append(both[:, 0])
                out_b.append(both[:, 1])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=names) if len(a) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((5, 0), np.int64)
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            rows = np.concatenate([kept, rows], axis=1)
            if not rows.shape[1]:
                continue
            before = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            last = int(before[-1]) + 1 if len(before) else 0
            kept = rows[:, last:]
            if (out := solve(rows[:, :last])) is not None:
                yield out
        if (out := solve(kept)) is not None:
            yield out

    return run


def _bits(n: int) -> int:
    """Bits of a shard's key that leave ``FILL / 2`` to ``FILL`` of ``n`` evenly spread fingerprints in a shard; 28 at most."""
    return min((n // FILL).bit_length(), 28)


def _keys(fp: Column, bits: int) -> Column:
    """Keys of a fingerprint's shards by ``bits`` bits each: fingerprints at three differing bits or fewer share one."""
    if not bits:
        return F.array(F.lit(0).cast("bigint"))
    keys = []
    for b in range(4):
        high = F.shiftrightunsigned(fp, 16 * b).bitwiseAND(F.lit((1 << min(bits, 16)) - 1))
        if bits <= 16:
            keys.append(F.lit(b << 28).cast("bigint").bitwiseOR(high))
            continue
        # the other three blocks, side by side
        rest = F.lit(0).cast("bigint")
        for place, o in enumerate(x for x in range(4) if x != b):
            rest = rest.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, 16 * o).bitwiseAND(F.lit(0xFFFF)), 16 * place))
        for s in range(4):
            low = F.shiftrightunsigned(rest, 12 * s).bitwiseAND(F.lit((1 << (bits - 16)) - 1))
            keys.append(F.lit((b * 4 + s) << 28).cast("bigint").bitwiseOR(F.shiftleft(high, 12)).bitwiseOR(low))
    return F.array(*keys)


def near_links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links ``a, b`` between nodes whose fingerprints ``fp`` differ in ``radius`` (3 at most) or fewer bits.

    Without a column ``node`` a fingerprint is its own node; with a column ``seed`` only fingerprints of one seed meet.
    Links span every group of nodes that they connect; a null fingerprint links to nothing.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the shards hold every link only up to a radius of 3")
    rows = fps.where("fp IS NOT NULL")
    rows = rows if "node" in fps.columns else rows.withColumn("node", F.col("fp"))
    rows = rows if "seed" in fps.columns else rows.withColumn("seed", F.lit(0))
    rows = cut(rows.select("fp", "node", "seed").distinct())
    most = rows.groupBy("seed").count().agg(F.max("count").alias("n")).first().n or 0
    rows = rows.select("fp", "node", F.explode(F.transform(_keys(F.col("fp"), _bits(most)), lambda k: k + F.shiftleft(F.col("seed").cast("bigint"), 40))).alias("key"))
    # small tables are written out before they are joined, so that a hot key is a join side that can be split
    sizes = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    rows = rows.join(sizes, "key").withColumn("parts", F.ceil(F.col("size") / shard).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    # part pair (i, j), i <= j: part i is the tree and part j asks; a part meets itself once, as a tree that grows
    own = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct((F.least("part", o) * F.col("parts") + F.greatest("part", o)).cast("bigint").alias("pair"), (o < F.col("part")).cast("int").alias("side")),
    )
    dealt = rows.select("key", "fp", "node", F.explode(own).alias("x")).select("key", "x.pair", "x.side", "fp", "node")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(n, "key", "pair").sortWithinPartitions("key", "pair", "side", "fp")
    return sorted_.mapInArrow(_linked(radius), "a bigint, b bigint")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS, seeds: int = 1) -> DataFrame:
    """``id, fp, component_id`` for every row; ``component_id`` is the smallest identifier that links reach.

    With ``seeds`` above 1 two texts link if any of so many independent fingerprints are within the radius, which finds
    most pairs that one fingerprint misses by a few bits. Null text is empty and has fingerprint zero, which links like
    any other. Rows repeated with one identifier are all returned. A null identifier never becomes a component's name
    unless nothing else is in it. Empty input gives no rows; other columns are not read.
    """
    marks = cut(fingerprints(docs, id_col, text_col, shingle, seeds))
    heads = cut(marks.groupBy("fp").agg(F.min("id").alias("least")))
    if seeds > 1:  # texts of one first fingerprint are one node; the other fingerprints link nodes further
        asked = marks.select(F.col("fp").alias("node"), F.posexplode("fps").alias("seed", "fp"))
    else:
        asked = heads.select("fp")
    nodes = connected_components(near_links(asked, radius))
    named = nodes.join(heads.withColumnRenamed("fp", "node"), "node")
    names = cut(named.groupBy("component").agg(F.min("least").alias("name")))
    far = nodes.join(names, "component").select(F.col("node").alias("fp"), "name")
    of = cut(heads.join(far, "fp", "left").select("fp", F.coalesce("name", "least").alias("component_id")))
    return marks.select("id", "fp").join(of, "fp").select("id", "fp", "component_id")


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            fps, keys, sigs, sizes = [], [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingles(text, shingle)
                fps.append(_signature(hashes, 1)[0])
                own = np.unique(hashes)
                key, sig = sketch(own)
                keys.append(key)
                sigs.append(sig)
                sizes.append(len(own))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(keys)))
            columns = [batch.column(0), batch.column(1), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), bands, pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "node", "fp", "bands", "sig", "n"])

    return run


def _allowed(similarity: float) -> tuple[int, int]:
    """Equal least hashes that a pair at ``similarity`` has with near certainty at least, and those that speak for it clearly."""
    m = BANDS * ROWS
    error = (similarity * (1 - similarity) / m) ** 0.5
    return round(m * (similarity - 3.5 * error)), round(m * (similarity + 1.3 * error))


def _grouped(solve, schema: pa.Schema, least: int = 2):
    """Hands ``solve`` the rows of each (key, pair) of ``least`` rows or more; rows are sorted by these, the first two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(rows: pa.Table, key: np.ndarray, pair: np.ndarray) -> Iterator[pa.RecordBatch]:
            fresh = np.flatnonzero((np.diff(key) != 0) | (np.diff(pair) != 0)) + 1
            out = [solve(rows.slice(s, e - s)) for s, e in zip([0, *fresh.tolist()], [*fresh.tolist(), len(key)], strict=True) if e - s >= least]
            rows_out = [r for part in out for r in part]
            if rows_out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows_out], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch])
            key, pair = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            before = np.flatnonzero((key != key[-1]) | (pair != pair[-1]))
            last = int(before[-1]) + 1 if len(before) else 0
            if last:
                yield from groups(rows.slice(0, last), key[:last], pair[:last])
            held = rows.slice(last).to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            yield from groups(rows, rows.column(0).to_numpy(), rows.column(1).to_numpy())

    return run


def _sigs(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


_OPEN = pa.schema([("key", pa.int64()), ("pair", pa.int64()), ("side", pa.int32()), ("node", pa.int64()), ("sig", pa.binary()), ("band", pa.int32()), ("comp", pa.int64())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


_OFFER = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _offers(similarity: float):
    """For each text of a part a pair with the leader whose sketch agrees best, if it allows the similarity.

    A text that agrees clearly with no leader becomes one. In a band of ``many`` parts, texts without a pair come as pairs
    with themselves.
    """
    allows, same = _allowed(similarity)

    def solve(rows: pa.Table) -> list[tuple[int, int, int]]:
        key, many = rows.column("key")[0].as_py(), rows.column("many")[0].as_py()
        node, sig = rows.column("node").to_numpy(), _sigs(rows)
        led, at, n, out = np.empty_like(sig), np.empty_like(node), 0, []
        for x, row in zip(node.tolist(), sig, strict=True):
            agree = (led[:n] == row).sum(axis=1)
            best = int(agree.argmax()) if n else -1
            if n and agree[best] >= allows:
                y = int(at[best])
                out.append((key, max(x, y), min(x, y)))
            elif many:
                out.append((key, x, x))
            if not (n and agree[best] >= same):
                led[n], at[n], n = row, x, n + 1
        return out

    return _grouped(solve, _OFFER, least=1)


def _offered(keyed: DataFrame, sigs: DataFrame, similarity: float, block: int) -> DataFrame:
    """Offers ``a, b`` of the texts ``key, node`` of all bands, part by part; who finds no leader goes on to the next turn.

    A band ends when the rest fits in one part, or when a turn leaves more than half of it: what these texts may
    still be linked to is found by the second round.
    """
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, found, turn = keyed.select("key", "node"), [], 0
    sizes = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")))
    while True:
        dealt = rows.join(sizes, "key").withColumn("parts", F.ceil(F.col("size") / block))
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), "node"), F.col("parts")))
        dealt = dealt.join(sigs, "node").select("key", "part", (F.col("parts") > 1).alias("many"), "node", "sig")
        out = cut(dealt.repartition(n, "key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(_offers(similarity), "key bigint, a bigint, b bigint"))
        found.append(out.where("a <> b").select("a", "b"))
        alone = out.where("a = b").select("key", F.col("a").alias("node"))
        left = alone.groupBy("key").agg(F.count(F.lit(1)).alias("size")).join(sizes.withColumnRenamed("size", "before"), "key")
        sizes = cut(left.where(f"size > 1 AND (size * 2 <= before OR size <= {block})").select("key", "size"))
        if sizes.isEmpty():
            break
        rows, turn = alone, turn + 1
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def _open_pairs(rows: pa.Table, allows: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each text the later ones of another group whose sketches allow a link, and that share no earlier band with it."""
    side, comp, sig, band = rows.column("side").to_numpy(), rows.column("comp").to_numpy(), _sigs(rows), rows.column("band")[0].as_py()
    early, two = sig[:, : band * ROWS].reshape(len(sig), band, ROWS), side.any()
    for i in range(len(sig)):
        later = np.flatnonzero(side[i + 1 :]) + i + 1 if two else np.arange(i + 1, len(sig))
        if two and side[i] or not len(later):
            continue
        later = later[comp[later] != comp[i]]
        later = later[(sig[later] == sig[i]).sum(axis=1) >= allows]
        if band and len(later):
            later = later[~(early[later] == early[i]).all(axis=2).any(axis=1)]
        if len(later):
            yield i, later


def _open(similarity: float):
    """The texts of a band that have an open pair there."""
    allows, _ = _allowed(similarity)

    def solve(rows: pa.Table) -> list[tuple]:
        hit = np.zeros(rows.num_rows, bool)
        for i, later in _open_pairs(rows, allows):
            hit[i] = True
            hit[later] = True
        return [tuple(r[c] for c in _OPEN.names) for r in rows.filter(pa.array(hit)).to_pylist()] if hit.any() else []

    return _grouped(solve, _OPEN)


class _Union:
    """Disjoint sets named by their least member."""

    def __init__(self) -> None:
        self.top: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.top.setdefault(x, x)) != x:
            self.top[x] = x = self.top.setdefault(up, up)
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.top[max(x, y)] = min(x, y)

    def stars(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.top) if (r := self.root(x)) != x]


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common values of two arrays of distinct ones."""
    if min(len(a), len(b)) == 0:
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    return min(len(a), len(b)) >= similarity * max(len(a), len(b)) and similarity_of(a, b) >= similarity


def _measured(shingle: int, similarity: float):
    """The open pairs of a band, measured on the texts: stars of what is alike."""
    allows, _ = _allowed(similarity)

    def solve(rows: pa.Table) -> list[tuple[int, int]]:
        node, comp = rows.column("node").to_pylist(), rows.column("comp").to_pylist()
        own = [np.unique(shingles(t, shingle)) for t in rows.column("t").to_pylist()]
        found = _Union()
        for i, later in _open_pairs(rows, allows):
            for j in later.tolist():
                if found.root(comp[i]) != found.root(comp[j]) and _alike(own[i], own[j], similarity):
                    found.join(comp[i], comp[j])
        return found.stars()

    return _grouped(solve, _LINK)


def _verified(shingle: int, similarity: float):
    """Rows ``a, ta, b, tb`` to stars around the least node of what the task's pairs of enough similarity connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, known = _Union(), {}

        def of(x: int, text: bytes) -> np.ndarray:
            if x not in known:
                if len(known) >= 256:
                    known.pop(next(iter(known)))
                known[x] = np.unique(shingles(text, shingle))
            return known[x]

        for batch in batches:
            for a, ta, b, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if found.root(a) != found.root(b) and _alike(of(a, ta), of(b, tb), similarity):
                    found.join(a, b)
        if stars := found.stars():
            both = np.array(stars, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return run


def _parts(size: Column, n: Column, block: int) -> Column:
    return F.greatest(F.ceil(size / block), F.ceil(n / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _met(rows: DataFrame, block: int) -> DataFrame:
    """Texts ``key, node, n, band, comp`` of bands, dealt to pairs of parts: ``side`` 0 is the tree and 1 asks.

    Groups of more than a part have parts of their own, the others of a band share parts, whole groups by their hash. Parts
    meet in pairs and shared ones also meet themselves, but parts of one large group do not meet.
    """
    groups = cut(rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n")).withColumn("own", _parts(F.col("size"), F.col("n"), block)))
    large = groups.where("own > 1").select("key", "comp", "own")
    small = groups.where("own = 1").groupBy("key").agg(_parts(F.sum("size"), F.sum("n"), block).alias("shared"))
    numbered = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("i")
    name = lambda i: F.xxhash64("comp", i)
    parts = small.select("key", F.lit(None).cast("bigint").alias("comp"), numbered("shared")).unionByName(large.select("key", "comp", numbered("own")))
    parts = cut(parts.select("key", "comp", name("i").alias("part")))
    one, two = parts.select("key", F.col("comp").alias("c"), F.col("part").alias("lo")), parts.select("key", F.col("comp").alias("d"), F.col("part").alias("hi"))
    # written out, so that the numbers of the pairs stay as they are when a task is run again
    pairs = cut(one.join(two, "key").where("lo <= hi AND (c IS NULL OR d IS NULL OR c <> d)").select("key", "lo", "hi").withColumn("pair", F.monotonically_increasing_id()))
    sides = pairs.select("key", "pair", F.lit(0).alias("side"), F.col("lo").alias("part")).unionByName(pairs.where("lo < hi").select("key", "pair", F.lit(1).alias("side"), F.col("hi").alias("part")))
    placed = rows.join(large, ["key", "comp"], "left").join(small, "key", "left")
    mine = F.when(F.col("own").isNull(), F.xxhash64(F.lit(None).cast("bigint"), F.pmod(F.xxhash64("comp"), F.col("shared")).cast("int")))
    mine = mine.otherwise(name(F.pmod(F.xxhash64("node"), F.col("own")).cast("int")))
    return placed.select("key", "node", "band", "comp", mine.alias("part")).join(sides, ["key", "part"]).select("key", "pair", "side", "node", "band", "comp")


def similar_links(marks: DataFrame, texts: DataFrame, shingle: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` of nodes that verified pairs connect; ``marks`` has one row a node, ``texts`` may repeat ``node, t``."""
    bands = marks.select("node", "n", F.posexplode("bands").alias("band", "key"))
    shared = cut(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key"))
    # sketches are fetched for bands that several texts share, not for all
    keyed = cut(bands.select("key", "node", "band").join(shared, "key"))
    sigs = marks.select("node", "sig")
    offered = _offered(keyed, sigs, similarity, block)
    printed = near_links(marks.select("fp", "node")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # written out, so that a text which leads very many is a join side that can be split
    pairs = cut(offered.unionByName(printed).where("a <> b").distinct())
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(keyed.select("node")).distinct()
    held = cut(texts.join(asked, "node", "left_semi").dropDuplicates(["node"]))
    both = pairs.join(held.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b").join(held.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a")
    first = cut(both.select("a", "ta", "b", "tb").mapInArrow(_verified(shingle, similarity), "a bigint, b bigint"))
    # bands with several groups left
    groups = connected_components(first)
    named = cut(keyed.join(marks.select("node", "n"), "node").join(groups, "node", "left").select("key", "node", "n", "band", F.coalesce("component", "node").alias("comp")))
    mixed = cut(named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key"))
    n = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _met(named.join(mixed, "key", "left_semi"), block).join(sigs, "node").select("key", "pair", "side", "node", "sig", "band", "comp")
    left = met.repartition(n, "key", "pair").sortWithinPartitions("key", "pair", "side", "node").mapInArrow(_open(similarity), "key bigint, pair bigint, side int, node bigint, sig binary, band int, comp bigint")
    whole = left.join(held, "node").select("key", "pair", "side", "node", "sig", "band", "comp", "t")
    second = whole.repartition(n, "key", "pair").sortWithinPartitions("key", "pair", "side", "node").mapInArrow(_measured(shingle, similarity), "a bigint, b bigint")
    return first.unionByName(second)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """``id, component_id`` for every row; ``component_id`` is the smallest identifier that verified pairs reach.

    A pair counts if its texts share ``similarity`` of their distinct shingles or more; a text of fewer words is one
    shingle. Equal texts are one node. Null and wordless texts are alike.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("node"), text.cast("binary").alias("t"))
    marks = cut(rows.mapInArrow(_sketches(shingle), f"id {kind}, node bigint, fp bigint, bands array<bigint>, sig binary, n bigint"))
    links = similar_links(marks.drop("id").dropDuplicates(["node"]), rows.select("node", "t"), shingle, similarity, block)
    nodes = connected_components(links)
    heads = cut(marks.groupBy("node").agg(F.min("id").alias("least")))
    names = cut(nodes.join(heads, "node").groupBy("component").agg(F.min("least").alias("name")))
    far = nodes.join(names, "component").select("node", "name")
    of = cut(heads.join(far, "node", "left").select("node", F.coalesce("name", "least").alias("component_id")))
    return marks.select("id", "node").join(of, "node").select("id", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS, seeds: int = SEEDS, similarity: float | None = None) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest identifier; columns as they came.

    Groups are those of :func:`near_groups`; with a ``similarity``, those of :func:`similar_groups`, which verifies
    every pair by its share of common shingles.

    Of different texts under that identifier the one of the least hash stays; rows equal in identifier and text stand or
    fall together. A row without an identifier goes if its group has a named row, and stays otherwise.
    """
    key = fresh_name(docs, "__text_key")
    marked = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    # named rows come first in the order of the structs
    name = F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), F.col(key).alias("key"))
    rows = marked.select(name.alias("__name"), F.col(text_col).alias("__text"))
    if similarity is None:
        groups = near_groups(rows, "__name", "__text", shingle, radius, seeds)
    else:
        groups = similar_groups(rows, "__name", "__text", shingle, similarity)
    lost = groups.where("NOT component_id.nameless AND id <> component_id")
    gone = lost.select(F.col("id.id").alias("__id"), F.col("id.key").alias("__key")).distinct()
    return marked.join(gone, marked[id_col].eqNullSafe(gone["__id"]) & (marked[key] == gone["__key"]), "left_anti").drop(key)


def query(spark, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
