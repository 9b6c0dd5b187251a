"""Removal of repeated substrings by deep-shallow suffix sorting.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier: in a document of smaller identifier,
or in the same one further left. Suffixes matter only up to that length, and only where two can be equal:

1. Every window of ``LENGTH`` bytes is filed under the smallest hash of the ``GRAM``-byte strings inside it. Equal
   windows get equal keys; successive windows with one key form a record (key, digest of its bytes, place), about one
   for 35 bytes. Repeats within a slice of the input are settled before anything is sent.
2. Records meet by key. Of records with equal bytes all but the earliest are repeats. Keys with a single kind of
   bytes are done; only what is left, the edges of edited copies, has to be sorted.
3. These records fetch their bytes from the documents, and all their windows are sorted within their key: multikey
   quicksort, with eight bytes as one character, to the shallow depth of ``SHALLOW`` bytes; groups still equal there go to
   blind tries for the remaining depth. Of equal windows all but the earliest are repeats.
4. The repeats return to their documents, which are cut.

A key under which more than ``HOT`` different contents stand (a line that very many texts share) is not gathered in one
task: its windows travel singly, dealt by a digest of their own bytes, and are sorted there. Of equal ones a slice of
documents sends the earliest only, and a task keeps one of each while they stream by.

A place is one number: the start, the length of the run of window starts, and the kind, so that a record is four longs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut, table
from .batches import slices

LENGTH = 100
GRAM = 32
SHALLOW = 40
HOT = 1024
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
_RECORD, _REPEAT, _ASK, _ASK_HOT, _RECORD_AGAIN = 0, 1, 2, 3, 4


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram``-byte string (a power of two), by doubling."""
    h, n = _BYTE[data], 1
    while n < gram:
        h = (h[:-n] * _A) ^ (np.right_shift(h[n:], np.uint64(29)) + h[n:] * _B)
        n *= 2
    h ^= h >> np.uint64(31)
    h *= _B
    h ^= h >> np.uint64(33)
    return h


def _window_extremes(h: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` neighbours."""
    n = 1
    while 2 * n <= width:
        h = pick(h[:-n], h[n:])
        n *= 2
    return pick(h[: len(h) - (width - n)], h[width - n :]) if width > n else h


def records(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the records of a text, first and last window start of each, and whether its key's string occurs again
    inside (windows of such a record can equal each other). None for texts under ``LENGTH``."""
    if len(text) < LENGTH:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    width = LENGTH - GRAM + 1
    h = _gram_hashes(np.frombuffer(text, np.uint8), GRAM)
    key = _window_extremes(h, width, np.minimum)
    fresh = np.r_[True, key[1:] != key[:-1]]
    begin = np.flatnonzero(fresh)
    if np.diff(np.r_[begin, len(key)]).max() > 256:
        # in periodic text one key can run on; records are of bounded size
        run = np.repeat(begin, np.diff(np.r_[begin, len(key)]))
        begin = np.flatnonzero(fresh | ((np.arange(len(key)) - run) % 256 == 0))
    end = np.r_[begin[1:], len(key)] - 1
    again = np.zeros(len(begin), bool)
    # places whose hash is the smallest of some window: the largest key of the windows over a place is its own hash
    pad = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(_window_extremes(np.concatenate([pad, key, pad]), width, np.maximum) == h)
    order = chosen[np.argsort(h[chosen], kind="stable")]
    i, j = order[:-1], order[1:]
    near = (h[i] == h[j]) & (j - i < width + 256)
    if near.any():
        i, j = i[near], j[near]
        low = np.searchsorted(begin, np.maximum(i - width + 1, 0), side="right") - 1
        high = np.searchsorted(begin, j, side="right")
        for o in range(int((high - low).max())):
            r = low + o
            r = np.where(r < high, r, -1)
            hit = (r >= 0) & (key[begin[r]] == h[i])
            again[r[hit]] = True
    return key[begin], begin, end, again


def _merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window-start intervals, with those that touch joined, by document and place."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (a[1:] > b[:-1] + 1)]
    at = np.flatnonzero(fresh)
    return doc[at], a[at], np.maximum.reduceat(b, at)


_NAMES = ["key", "digest", "doc", "place"]
_SCHEMA = "key bigint, digest bigint, doc bigint, place bigint"
_LONGEST = 1 << 30


def _packed(a: np.ndarray, b: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    """Window starts from a to b and a kind in one number whose order is that of the starts."""
    return a.astype(np.int64) << 33 | (b - a).astype(np.int64) << 3 | kind


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = place >> 33
    return a, a + (place >> 3 & (_LONGEST - 1)), place & 7


def _batch(key, digest, doc, place) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(np.int64, copy=False)) for x in (key, digest, doc, place)], names=_NAMES)


def _repeats(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    doc, a, b = _merged(doc, a, b)
    return _batch(doc, np.zeros(len(doc)), doc, _packed(a, b, _REPEAT))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1: records of documents (doc, text as bytes); what repeats within a slice comes out as a repeat."""
    from xxhash import xxh3_64_intdigest

    for batch in slices(batches, 1):
        docs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts, digest = [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            if len(text) >= _LONGEST:
                raise ValueError("a text of a gigabyte or more has places that do not fit")
            key, a, b, again = records(text)
            digest += [xxh3_64_intdigest(text[x : y + LENGTH]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            parts.append((key, np.full(len(key), docs[i]), a, b, again))
        key, doc, a, b, again = (np.concatenate(x) for x in zip(*parts, strict=True))
        dig = np.array(digest, np.uint64)
        order = np.lexsort((a, doc, dig, key))
        key, dig, doc, a, b = key[order].view(np.int64), dig[order].view(np.int64), doc[order], a[order], b[order]
        kind = np.where(again[order], _RECORD_AGAIN, _RECORD)
        first = np.r_[True, (key[1:] != key[:-1]) | (dig[1:] != dig[:-1])][: len(key)]
        yield _batch(key[first], dig[first], doc[first], _packed(a[first], b[first], kind[first]))
        if not first.all():
            yield _repeats(doc[~first], a[~first], b[~first])


def _meet(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Step 2, over rows sorted by key, digest, doc, a, repeats last. Repeats pass through; records become repeats or questions.

    A key with more than ``limit`` kinds of bytes is not held whole: it is taken as hot while it streams by.
    """
    rest: list[np.ndarray] = [np.empty((4, 0), np.int64)]
    hot: dict[str, int | None] = {"key": None, "digest": None}

    def emit(rows: np.ndarray, ask: np.ndarray, dup: np.ndarray, kind: np.ndarray) -> Iterator[pa.RecordBatch]:
        if ask.any():
            yield _batch(*rows[:3, ask], rows[3, ask] & ~7 | kind[ask])
        if dup.any():
            yield _repeats(rows[2][dup], *_unpacked(rows[3][dup])[:2])

    def streamed(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, dig = rows[0], rows[1]
        known = hot["key"] is not None and key[0] == hot["key"]
        first = np.r_[not (known and dig[0] == hot["digest"]), dig[1:] != dig[:-1]]
        hot["key"], hot["digest"] = int(key[-1]), int(dig[-1])
        yield from emit(rows, first, ~first, np.full(len(first), _ASK_HOT))

    def whole(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not rows.shape[1]:
            return
        key, dig = rows[0], rows[1]
        new_key = np.r_[True, key[1:] != key[:-1]]
        first = new_key | np.r_[True, dig[1:] != dig[:-1]]
        at = np.flatnonzero(new_key)
        many = np.repeat(np.add.reduceat(first.astype(np.int64), at), np.diff(np.r_[at, len(key)]))
        yield from emit(rows, first & ((many > 1) | (rows[3] & 7 == _RECORD_AGAIN)), ~first, np.where(many > limit, _ASK_HOT, _ASK))

    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns])
        if (done := rows[3] & 7 == _REPEAT).any():
            yield batch.filter(pa.array(done))
            rows = rows[:, ~done]
        rows = np.concatenate([rest.pop(), rows], axis=1)
        if hot["key"] is not None and rows.shape[1]:
            n = int((rows[0] == hot["key"]).sum())
            if n:
                yield from streamed(rows[:, :n])
                rows = rows[:, n:]
            if rows.shape[1]:
                hot["key"] = None
        tail = int((rows[0] == rows[0][-1]).sum()) if rows.shape[1] else 0
        split = rows.shape[1] - tail
        yield from whole(rows[:, :split])
        rows = rows[:, split:]
        if len(np.unique(rows[1])) > limit:
            yield from streamed(rows)
            rows = rows[:, :0]
        rest.append(rows)
    yield from whole(rest.pop())


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3a: (doc, id, text, questions) to rows (key, doc, place, bytes); the windows of hot keys singly.

    Of equal windows of hot keys only the earliest of the slice goes on; the others are repeats, rows without bytes.
    """
    from xxhash import xxh3_64_intdigest

    names = ["key", "doc", "place", "bytes"]
    for batch in slices(batches, 2):
        key, doc, place, content = [], [], [], []
        hot: dict[bytes, tuple[int, int]] = {}
        again: list[tuple[int, int]] = []
        for d, text, asked in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, b, kind = _unpacked(np.array([q["place"] for q in asked], np.int64))
            for q, x, y, k in zip(asked, a.tolist(), b.tolist(), kind.tolist(), strict=True):
                if k == _ASK:
                    key.append(q["key"])
                    place.append(q["place"])
                    content.append(text[x : y + LENGTH])
                    doc.append(d)
                    continue
                for p in range(x, y + 1):
                    w = text[p : p + LENGTH]
                    best = hot.setdefault(w, (d, p))
                    if best != (d, p):
                        again.append(max(best, (d, p)))
                        hot[w] = min(best, (d, p))
        for w, (d, p) in hot.items():
            key.append(xxh3_64_intdigest(w) - (1 << 63))
            place.append(p << 33 | _ASK_HOT)
            content.append(w)
            doc.append(d)
        if again:
            late = np.array(again, np.int64)
            who, a, b = _merged(late[:, 0], late[:, 1], late[:, 1])
            key += who.tolist()
            doc += who.tolist()
            place += _packed(a, b, _REPEAT).tolist()
            content += [None] * len(who)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(place, pa.int64()), pa.array(content, pa.binary())], names=names)


class BlindTrie:
    """Strings of one length in a trie that keeps branching places only; equal strings share a leaf.

    An insertion follows the branching characters blindly to some leaf, compares the string with that leaf once, and
    hangs the new leaf where their common prefix ends.
    """

    __slots__ = ("leaf", "root")

    def __init__(self) -> None:
        self.root = None  # a leaf [string, members] or a node (depth, {byte: child})

    def add(self, s: bytes, member: int) -> None:
        if self.root is None:
            self.root = [s, [member]]
            return
        node = self.root
        while isinstance(node, tuple):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if s == other:
            node[1].append(member)
            return
        lcp = _common(s, other)
        above, edge, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < lcp:
            above, edge = node, s[node[0]]
            node = node[1][edge]
        leaf = [s, [member]]
        if isinstance(node, tuple) and node[0] == lcp:
            node[1][s[lcp]] = leaf
            return
        new = (lcp, {other[lcp]: node, s[lcp]: leaf})
        if above is None:
            self.root = new
        else:
            above[1][edge] = new

    def classes(self) -> list[list[int]]:
        """Members of each leaf, leaves in the order of their strings."""
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                out.append(node[1])
        return out


def _common(s: bytes, t: bytes) -> int:
    """Length of the common prefix of two different strings of one length."""
    low, high = 0, len(s)
    while high - low > 1:
        mid = (low + high) // 2
        if s[low:mid] == t[low:mid]:
            low = mid
        else:
            high = mid
    return low if s[low] != t[low] else high


def repeated_windows(group: np.ndarray, begin: np.ndarray, data: bytes) -> np.ndarray:
    """For windows in order of priority (group, offset into ``data``): whether an equal one of the group comes earlier."""
    flat = np.frombuffer(data, np.uint8)
    wide = np.lib.stride_tricks.sliding_window_view(np.r_[flat, np.zeros(8, np.uint8)], 8)
    word = lambda at: np.ascontiguousarray(wide[at]).view(">u8").ravel().astype(np.uint64)
    repeated = np.zeros(len(begin), bool)
    live, gid = np.arange(len(begin)), group.astype(np.int64)

    def narrowed(live: np.ndarray, gid: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Groups cut by a character; windows alone in their group drop out. The order within groups stays."""
        order = np.lexsort((chars, gid))
        g, c = gid[order], chars[order]
        fresh = np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])]
        gid = np.cumsum(fresh)
        keep = np.bincount(gid)[gid] > 1
        return live[order][keep], gid[keep]

    if not len(live):
        return repeated
    live, gid = narrowed(live, gid, np.zeros(len(live), np.uint64))
    for depth in range(0, SHALLOW, 8):
        if not len(live):
            return repeated
        live, gid = narrowed(live, gid, word(begin[live] + depth))
    if not len(live):
        return repeated
    at = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])
    size = np.diff(np.r_[at, len(gid)])
    # a trie of two leaves is one comparison
    x, y = live[at[size == 2]], live[at[size == 2] + 1]
    same = np.ones(len(x), bool)
    for depth in [*range(SHALLOW, LENGTH - 8, 8), LENGTH - 8]:
        same &= word(begin[x] + depth) == word(begin[y] + depth)
    repeated[y[same]] = True
    for s, n in zip(at[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        trie = BlindTrie()
        members = live[s : s + n].tolist()
        for m, b in zip(members, begin[live[s : s + n]].tolist(), strict=True):
            trie.add(data[b + SHALLOW : b + LENGTH], m)
        for equal in trie.classes():
            repeated[equal[1:]] = True
    return repeated


def _sort(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Step 3b, over rows sorted by key, doc, place: repeats among the windows of each key.

    Of a hot key, whose rows are single windows, no more than about ``most`` rows are held: repeats leave as they are found.
    """
    held: list[pa.RecordBatch] = []

    def solve(part: pa.Table) -> tuple[pa.RecordBatch | None, np.ndarray]:
        """Repeats, and for rows of single windows whether each is one."""
        key, doc = (part.column(i).to_numpy() for i in range(2))
        start, _, kind = _unpacked(part.column(2).to_numpy())
        content = part.column(3).to_pylist()
        length = np.array([len(c) for c in content], np.int64)
        count = length - LENGTH + 1
        base = np.cumsum(length) - length
        row = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        place = start[row] + step
        group = np.cumsum(np.r_[0, key[1:] != key[:-1]])[row]
        order = np.lexsort((place, doc[row], group))
        row, step, place, group = row[order], step[order], place[order], group[order]
        dup = repeated_windows(group, base[row] + step, b"".join(content))
        gone = np.zeros(len(key), bool)
        gone[row[dup & (kind[row] == _ASK_HOT)]] = True
        return (_repeats(doc[row][dup], place[dup], place[dup]) if dup.any() else None), gone

    for batch in batches:
        none = batch.column(3).is_null()
        if none.true_count:
            done = batch.filter(none)
            yield _batch(done.column(0), np.zeros(done.num_rows), done.column(1), done.column(2))
            batch = batch.filter(pc.invert(none))
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([*held, batch])
        key = whole.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1], side="left"))
        for at in _cuts(key[:last]):
            if (out := solve(whole.slice(*at))[0]) is not None:
                yield out
        rest = whole.slice(last)
        if rest.num_rows > most and bool((rest.column(2).to_numpy() & 7 == _ASK_HOT).all()):
            out, gone = solve(rest)
            rest = rest.filter(pa.array(~gone)).combine_chunks()
            if out is not None:
                yield out
        held = rest.to_batches()
    if held and (out := solve(pa.Table.from_batches(held))[0]) is not None:
        yield out


def _cuts(key: np.ndarray, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Slices (start, length) of about ``rows`` rows that hold whole keys."""
    at = 0
    while at < len(key):
        to = min(len(key), at + rows)
        if to < len(key):
            to = max(int(np.searchsorted(key, key[to], side="left")), at)
            if to == at:
                to = int(np.searchsorted(key, key[at], side="right"))
        yield at, to - at
        at = to


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: (row id, text, repeats) to the remaining bytes and counts."""
    for batch in slices(batches, 1):
        texts, removed, spans = [], [], []
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if not gone:
                texts.append(text)
                removed.append(0)
                spans.append(0)
                continue
            a, b, _ = _unpacked(np.array(gone, np.int64))
            b = b + LENGTH
            steps = np.bincount(a, minlength=len(text) + 1) - np.bincount(b, minlength=len(text) + 1)
            off = np.cumsum(steps)[: len(text)] > 0
            texts.append(np.frombuffer(text, np.uint8)[~off].tobytes())
            removed.append(int(off.sum()))
            spans.append(int((np.diff(np.r_[0, off.astype(np.int8)]) == 1).sum()))
        n = [len(t) + r for t, r in zip(texts, removed, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(texts, pa.binary())],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc`` (a long in the order of the documents), ``id``, ``text`` (bytes). Unique integer ids are taken as they are."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    if isinstance(rows.schema["id"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        twice = rows.groupBy("id").count().where("id IS NULL OR count > 1").limit(1).count()
        if not twice:
            return rows.select(F.col("id").cast("bigint").alias("doc"), "id", "text")
    # rows that share an identifier need numbers of their own; they keep the order of identifier, then text
    return cut(rows.sort(F.asc_nulls_last("id"), "text").select(F.monotonically_increasing_id().alias("doc"), "id", "text"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept`` for every row: the bytes that remain, and how many went in how many runs.

    Null text is empty; texts under ``LENGTH`` bytes lose nothing. Documents stand in the order of their identifier;
    null comes last, and rows with one identifier stand in the order of their bytes, the rest being arbitrary, so of
    identical rows the first keeps its bytes. ``kept`` may cut a character in two. Other columns are not read. A very long
    text is a slice of its own and takes about a hundred bytes a byte while its records are made; one of a gigabyte or more raises.
    """
    numbered = _numbered(docs, id_col, text_col)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = numbered.select("doc", "text").mapInArrow(_find, _SCHEMA)
    repeat = F.col("place").bitwiseAND(7) == _REPEAT
    met = found.repartition(n, "key").sortWithinPartitions(repeat, "key", "digest", "doc", "place").mapInArrow(lambda it: _meet(it, hot), _SCHEMA)
    met = cut(met)
    # both joins below read the same columns, so that the texts are dealt by document once
    texts = numbered.select("doc", "id", "text").repartition(n, "doc")
    asked = met.where(~repeat).groupBy("doc").agg(F.collect_list(F.struct("key", "place")).alias("asked"))
    contents = texts.join(asked, "doc").select("doc", "id", "text", "asked").mapInArrow(_fetch, "key bigint, doc bigint, place bigint, bytes binary")
    sorted_ = contents.repartition(n, "key").sortWithinPartitions("key", "doc", "place").mapInArrow(_sort, _SCHEMA)
    gone = met.where(repeat).unionByName(sorted_).groupBy("doc").agg(F.collect_list("place").alias("gone"))
    kind = numbered.schema["id"].dataType.simpleString()
    return (
        texts.join(gone, "doc", "left").select("id", "text", "gone").mapInArrow(_cut, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    )


def query(spark, sf_dir: str) -> DataFrame:
    done = dedup_substrings(table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
