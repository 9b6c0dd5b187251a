"""Spelling variants: every word's near words (one inserted, deleted or replaced code point) and the form they point to.

Words are cut in half. One error leaves the other half as it is, so near words either begin with the first half or end
with the second. Two minimal acyclic automata answer this, one over the words and one over the words read backwards: the
half is matched exactly, the rest is completed with one error. A state counts the words behind it, so a walk adds up to
the number of a word in order, which tells its text and its count (a perfect hash). A word found backwards that begins
with the first half as well was found forwards already, which removes duplicates without a list of pairs.

Words are range-partitioned into shards of about ``SHARD`` words, one automaton each; a query goes to those shards
whose range can hold its half. A shard with many queries is answered in several pieces. Automata come first in their
partition and queries stream past them, so memory is bounded by a shard. The driver sees the first 32 code points of at
most ``SHARDS`` splitters.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial
from math import ceil, log2

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut, table
from .exact_dedup import LOWER, UPPER

SHARD, SHARDS, HEAD = 40_000, 4096, 32
LEAST, OFTEN, RATIO = 7, 2, 10
#: The contract's rule for a damaged run: its crc32 is a multiple of this.
DAMAGED = 31
_FOUND = "word string, n bigint, n_near bigint, best_n bigint, best string"



class Automaton:
    """Minimal acyclic automaton of sorted distinct words; a word's number is its place in that order."""

    def __init__(self, words: list[str]) -> None:
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        size: list[int] = []
        known: dict[tuple, int] = {}
        last, path = "", [[False, []]]

        def settle(final: bool, out: list[tuple[str, int]]) -> int:
            key = (final, tuple(out))
            if key not in known:
                known[key] = len(size)
                before, edges = int(final), {}
                for c, to in out:
                    edges[c] = (to, before)
                    before += size[to]
                self.edges.append(edges)
                self.final.append(final)
                size.append(before)
            return known[key]

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                done = settle(*path.pop())
                path[-1][1].append((last[len(path) - 1], done))

        for word in words:
            same = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                same += 1
            close(same)
            path.extend([False, []] for _ in range(len(word) - same))
            path[-1][0] = True
            last = word
        close(0)
        self.root = settle(*path[0])

    def walk(self, state: int, number: int, text: str, at: int, to: int) -> tuple[int, int] | None:
        edges = self.edges
        for i in range(at, to):
            step = edges[state].get(text[i])
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def one_error(self, word: str, half: int) -> set[int]:
        """Numbers of the words that share ``word[:half]`` and differ from the rest by exactly one code point."""
        found: set[int] = set()
        here = self.walk(self.root, 0, word, 0, half)
        n = len(word)

        def complete(state: int, number: int, at: int) -> None:
            end = self.walk(state, number, word, at, n)
            if end is not None and self.final[end[0]]:
                found.add(end[1])

        for i in range(half, n + 1):
            if here is None:
                break
            state, number = here
            own = word[i] if i < n else ""
            for c, (to, before) in self.edges[state].items():
                if c != own:  # the own letter inserted here is the same word as inserted after it
                    complete(to, number + before, i)
                    if own:
                        complete(to, number + before, i + 1)
            if own and (i == half or own != word[i - 1]):  # of a run of equal letters the first is left out
                complete(state, number, i + 1)
            here = self.walk(state, number, word, i, i + 1) if own else None
        return found


def _asked(lows: list[tuple[str, int]], backward: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shard that can hold words with the exact half of a query."""
    heads = [x[0] for x in lows]
    for batch in batches:
        shards, keys, counts = [], [], []
        for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            exact = key[: len(key) - len(key) // 2 if backward else len(key) // 2]
            first, last = max(bisect_left(heads, exact[:HEAD]) - 1, 0), bisect_right(heads, exact[:HEAD] + "\U0010ffff")
            for _, shard in lows[first:last]:
                shards.append(shard)
                keys.append(key)
                counts.append(n)
        yield pa.record_batch([pa.array(shards, pa.int32()), pa.array(keys, pa.string()), pa.array(counts, pa.int64())], ["shard", "key", "n"])


def _answered(backward: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard and piece, words in order before queries; each query leaves one row a shard."""
    own, words, counts, automaton = None, [], [], None
    for batch in batches:
        rows: list[list] = [[], [], [], [], []]
        for shard, piece, asks, key, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != (shard, piece):
                own, words, counts, automaton = (shard, piece), [], [], None
            if not asks:
                words.append(key)
                counts.append(n)
                continue
            automaton = automaton or Automaton(words)
            half = len(key) // 2
            numbers = automaton.one_error(key, len(key) - half if backward else half)
            word = key[::-1] if backward else key
            near = [(-counts[i], words[i][::-1] if backward else words[i]) for i in numbers]
            if backward:
                near = [x for x in near if not x[1].startswith(word[:half])]
            best = min(near, default=(None, None))
            for out, x in zip(rows, (word, n, len(near), -best[0] if near else None, best[1]), strict=True):
                out.append(x)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.record_batch([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["word", "n", "n_near", "best_n", "best"])


def _direction(words: DataFrame, shards: int, backward: bool) -> DataFrame:
    """What one of the two automata finds: ``word, n, n_near, best_n, best``, a row for each shard that was asked."""
    key = F.reverse("word") if backward else F.col("word")
    own = cut(words.select(key.alias("key"), "n").repartitionByRange(shards, "key").withColumn("shard", F.spark_partition_id()))
    lows = sorted(tuple(r) for r in own.groupBy("shard").agg(F.substring(F.min("key"), 1, HEAD).alias("low")).select("low", "shard").collect())
    asked = cut(own.select("key", "n").mapInArrow(partial(_asked, lows, backward), "shard int, key string, n bigint"))
    # at most SHARDS rows: how many pieces answer a shard's queries
    pieces = F.broadcast(asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / (2 * SHARD)).cast("int").alias("pieces")))
    index = own.join(pieces, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(False).alias("asks"), "key", "n")
    asks = asked.join(pieces, "shard").select("shard", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int").alias("piece"), F.lit(True).alias("asks"), "key", "n")
    dealt = index.unionByName(asks).repartition("shard", "piece").sortWithinPartitions("shard", "piece", "asks", "key")
    return dealt.mapInArrow(partial(_answered, backward), _FOUND)


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """``word, n, n_near, best_n, best`` for distinct ``word`` and their counts ``n``: the number of words that differ by
    exactly one inserted, deleted or replaced code point, and of these the one of largest count (ties: the smallest)."""
    shards = min(SHARDS, max(1, ceil(words.count() / shard)))
    both = _direction(words, shards, False).unionByName(_direction(words, shards, True))
    per_word = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("c"), F.col("best").alias("w")))).alias("b"))
    return per_word.select("word", "n", "n_near", (-F.col("b.c")).alias("best_n"), F.col("b.w").alias("best"))


def _roots(links: DataFrame, depth: int) -> DataFrame:
    """``word, root``: the last of each chain ``word, form``, by pointer doubling; no chain has over ``depth`` links."""
    links = cut(links)
    for _ in range(ceil(log2(max(depth, 1)))):
        on = links.select(F.col("word").alias("form"), F.col("form").alias("further"))
        links = cut(links.join(on, "form", "left").select("word", F.coalesce("further", "form").alias("form")))
    return links.select("word", F.col("form").alias("root"))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """``word, n``: what becomes of the runs of Latin letters under the contract's rule, and how often."""
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))  # greedy: a whole run or none
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.expr("left(run, int(h % length(run)))"), F.substring(F.col("run"), at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % DAMAGED == 0, short).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often)


def variants(words: DataFrame, ratio: int = RATIO, shard: int = SHARD) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for distinct ``word`` and counts ``n``.

    The form of a word is its near word of largest count (ties: the smallest) if that count is ``ratio`` times its own or
    more. ``root`` follows the forms to the last, the word itself if it has none; counts grow by the ratio along a chain,
    so the largest count bounds its length. No words: no rows.
    """
    words = cut(words.select("word", "n"))
    most = words.agg(F.max("n")).first()[0] or 1
    depth = 1
    while ratio**depth < most:
        depth += 1
    near = cut(near_words(words, shard))
    formed = F.col("best_n") >= F.lit(ratio) * F.col("n")
    roots = _roots(near.where(formed).select("word", F.col("best").alias("form")), depth)
    return near.join(roots, "word", "left").select(
        "word", F.when(formed, F.col("best")).alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.when(formed, F.col("best_n")).alias("form_n")
    )


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Variants of the words of ``docs``. Null text has no words, a null identifier counts as an empty string; rows repeated
    count again. Texts of any length are read whole, a very long run of letters is one long word. Other columns are not read.
    An empty table gives no rows."""
    return variants(word_counts(docs, id_col, text_col))


def query(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def one_apart(a: str, b: str) -> bool:
    """Plain test of nearness, for small tables and tests."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, c in enumerate(a) if c != b[i]), len(a))
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]




# crc32 bit by bit, two letters' worth of UTF-8 at most a code point: DuckDB has no crc32 of its own
_BYTES = "flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))"
_BIT = "(CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END)"

ORACLE = f"""
WITH RECURSIVE crc_table AS (SELECT i, i::BIGINT AS v, 0 AS k FROM range(0, 256) t(i) UNION ALL SELECT i, {_BIT.format("v")}, k + 1 FROM crc_table WHERE k < 8),
bytes AS (SELECT list(v ORDER BY i) AS t FROM crc_table WHERE k = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
per AS (SELECT doc_id, run, count(*) AS c, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM runs WHERE length(run) >= {LEAST} GROUP BY doc_id, run),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}::BIGINT[]), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::BIGINT) AS h FROM per, bytes),
made AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM made WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(c) >= {OFTEN}),
cuts AS (SELECT word, n, p, left(word, p) || substr(word, p + 2) AS rest FROM (SELECT *, unnest(range(0, length(word)))::INT AS p FROM words)),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, [(-m)::VARCHAR, other]) FILTER (m = top) AS other, max(m) AS m FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM near) GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= {RATIO} * w.n THEN b.other END AS form, CASE WHEN b.m >= {RATIO} * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best b USING (word)),
chain AS (SELECT word, word AS here, 0 AS k FROM formed UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN formed f ON f.word = c.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, k) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
