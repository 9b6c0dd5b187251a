"""Collocations: phrases of two or three words that stand together more often than their parts suggest.

A first pass counts every run of one to three words in a sketch, an array of saturating counters. A counter is never
below the count of a run that it holds, so runs whose counter stays under ``OFTEN`` are no candidates. The sums go out
as one bit a counter (``2 ** MOST_BITS`` bits at most, 32 MB). A second pass takes the texts in slices: the slice's own
candidates by the sketch (a run's bound is the least of its own counter and those of the runs in it) are compiled into
Aho-Corasick automata, and the slice is scanned for all their overlapping matches; both are spelled in short marks of one
width, one for each different word of the slice, whose first letter is from an alphabet of its own. The
counts of all slices are summed, and only then compared with ``OFTEN``.

Nothing is dropped by the sketch, however full: it has a counter for every sixteen bytes of text or fewer, and from some 4 GB of text on,
when it stops growing, it lets more rare runs through, which then travel with their counts, and the exact sums sort them
out. A task's counters are 256 MB at most. Texts never travel. What a task holds is one slice of
``SLICE`` bytes (longer only where no delimiter allows a cut) and its automata.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from math import ceil, log2
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut, table
from .batches import slices

WORDS, OFTEN, INSIDE, TOP, SCALE = 3, 10, 50, 2000, 1_000_000
SLICE = 4_000_000
MOST_BITS, FEW_BITS, BLOCK_BITS = 28, 26, 14
_SALTS = 64
_LETTERS, _FIRSTS, _OTHERS = 46, 0x21, 0x50
#: Delimiters become line ends, tabs spaces, A-Z small letters; all of them single bytes in UTF-8.
_BYTES = bytes.maketrans(b".,;:!?\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n\n\n\n\n\n\n\n\n abcdefghijklmnopqrstuvwxyz")
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _parts(texts: Iterator[bytes], most: int) -> Iterator[bytes]:
    """The texts, normalised, joined by line ends and cut at line ends into parts of about ``most`` bytes."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        text, at = text.translate(_BYTES), 0
        while at < len(text):
            to = len(text) if len(text) - at <= most else text.find(b"\n", at + most)
            to = len(text) if to < 0 else to
            held.append(text[at:to] if at or to < len(text) else text)
            size += to - at
            at = to
            if size >= most:
                yield b"\n".join(held)
                held, size = [], 0
    if held:
        yield b"\n".join(held)


class _Slice:
    """Words of a part as numbers into ``names``; ``word`` is false at line ends."""

    def __init__(self, part: bytes) -> None:
        split = pc.split_pattern(pa.array([part.replace(b"\n", b" \n ")], pa.large_binary()).cast(pa.large_string()), " ").flatten()
        coded = split.filter(pc.not_equal(split, "")).dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = coded.dictionary.cast(pa.string())
        self.names = self.words.to_pylist()
        end = self.names.index("\n") if "\n" in self.names else -1
        self.word = self.codes != end
        self.hash = pd.util.hash_array(np.array(self.names, dtype=object), categorize=False) if self.names else np.zeros(0, np.uint64)

    def runs(self, k: int) -> np.ndarray:
        """Where runs of ``k`` words begin."""
        n = len(self.codes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        whole = self.word[:n].copy()
        for j in range(1, k):
            whole &= self.word[j : n + j]
        return np.flatnonzero(whole)

    def buckets(self, at: np.ndarray, k: int, lang: int, bits: int) -> np.ndarray:
        h = np.full(len(at), lang * 4 + k, np.uint64)
        for j in range(k):
            h = (h ^ self.hash[self.codes[at + j]]) * _K[j]
            h ^= h >> np.uint64(29)
        h *= _K[0]
        return (h >> np.uint64(64 - bits)).astype(np.int64)

    def marks(self) -> pa.Array:
        """A mark for each different word."""
        width, left = 1, np.arange(len(self.names))
        while _LETTERS**width < len(self.names):
            width += 1
        letters = np.empty((len(self.names), width), np.uint8)
        for j in range(width):
            letters[:, width - 1 - j] = left % _LETTERS + (_OTHERS if j < width - 1 else _FIRSTS)
            left = left // _LETTERS
        return pa.array(letters.reshape(-1).view(f"S{width}"), pa.binary()).cast(pa.string())

    def joined(self, of: pa.Array, at: np.ndarray, k: int, by: str) -> pa.Array:
        """``of`` the words of the runs at ``at``, joined."""
        return pc.binary_join_element_wise(*[of.take(pa.array(self.codes[at + j])) for j in range(k)], by)

    def distinct(self, at: np.ndarray, k: int) -> np.ndarray:
        """One place of each different run among those at ``at``."""
        key = self.codes[at]
        for j in range(1, k):
            key = key * len(self.names) + self.codes[at + j] if j == 1 else np.unique(key, return_inverse=True)[1] * len(self.names) + self.codes[at + j]
        return at[np.unique(key, return_index=True)[1]]


def _by_lang(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, _Slice]]:
    for batch in slices(batches, 1, most):
        texts: dict[str, list[bytes]] = defaultdict(list)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts[lang].append(text)
        for lang, own in texts.items():
            for part in _parts(iter(own), most):
                yield lang, _Slice(part)


def _sketch_bits(size: int) -> int:
    """For so many bytes of text: one for every 4 while they are few, then one for every 16, as a full sketch lets every run through."""
    return min(MOST_BITS, max(BLOCK_BITS + 1, min(FEW_BITS, ceil(log2(size / 4 + 1))), ceil(log2(size / 16 + 1))))


def _lang_hash(lang: str) -> int:
    return int(pd.util.hash_array(np.array([lang], dtype=object), categorize=False)[0]) >> 3


def _sketch(bits: int, limit: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's counters, saturated at ``limit``, in packed blocks of two counters a byte; most of them are zero."""
    counts = np.zeros(1 << bits, np.uint8)
    for lang, own in _by_lang(batches, most):
        seed = _lang_hash(lang)
        for k in range(1, WORDS + 1):
            at, n = np.unique(own.buckets(own.runs(k), k, seed, bits), return_counts=True)
            counts[at] = np.minimum(counts[at] + n, limit)
    block = 1 << BLOCK_BITS
    for start in range(0, len(counts), block * 64):
        few = counts[start : start + block * 64].reshape(-1, min(block, len(counts)))
        used = np.flatnonzero(few.any(axis=1))
        data = [zlib.compress((few[i, ::2] | few[i, 1::2] << 4).tobytes(), 1) for i in used]
        yield pa.record_batch([pa.array(used + start // block, pa.int32()), pa.array(data, pa.binary())], ["block", "data"])


def _bits(limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal blocks, which lie side by side, as one bit a counter: is it ``limit`` or more?"""
    own, total = None, None

    def done() -> pa.RecordBatch:
        return pa.record_batch([pa.array([own], pa.int32()), pa.array([np.packbits(total >= limit).tobytes()], pa.binary())], ["block", "data"])

    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            two = np.frombuffer(zlib.decompress(data), np.uint8)
            counts = np.empty(2 * len(two), np.uint8)
            counts[::2], counts[1::2] = two & 15, two >> 4
            if block != own:
                if own is not None:
                    yield done()
                own, total = block, counts
            else:
                total = np.minimum(total + counts, limit)
    if own is not None:
        yield done()


def _counted(bits: int, hot: Broadcast, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, words, phrase, n`` of the slices; the empty phrase stands for all words of a language."""
    may = hot.value
    passes = lambda b: (may[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1 == 1
    for lang, own in _by_lang(batches, most):
        seed, names = _lang_hash(lang), own.names
        at = own.runs(1)
        may_hold = np.zeros(len(own.codes) + 1, bool)
        may_hold[at] = passes(own.buckets(at, 1, seed, bits))
        code, n = np.unique(own.codes[np.flatnonzero(may_hold[:-1])], return_counts=True)
        sizes, counts = [np.zeros(1, np.int8), np.ones(len(code), np.int8)], [np.array([own.word.sum()], np.int64), n.astype(np.int64)]
        phrases = [pa.array([""]), own.words.take(pa.array(code))]
        automaton, found, marks = ahocorasick.Automaton(), 0, own.marks()
        for k in range(2, WORDS + 1):
            at = own.runs(k)
            at = at[may_hold[at] & may_hold[at + 1]]  # no run is more frequent than the runs in it
            at = at[passes(own.buckets(at, k, seed, bits))]
            may_hold[:] = False
            may_hold[at] = True
            at = own.distinct(at, k)
            sizes.append(np.full(len(at), k, np.int8))
            phrases.append(own.joined(own.words, at, k, " "))
            for key in own.joined(marks, at, k, "").to_pylist():
                automaton.add_word(key, found)
                found += 1
        if found:
            automaton.make_automaton()
            spelled = marks.to_pylist()
            text = "".join([spelled[c] for c in own.codes.tolist()])
            hits = np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64)
            counts.append(np.bincount(hits, minlength=found).astype(np.int64))
        total = np.concatenate(counts)
        yield pa.record_batch([pa.array([lang]).take(pa.array(np.zeros(len(total), np.int64))), pa.array(np.concatenate(sizes)), pa.concat_arrays(phrases), pa.array(total)], ["lang", "words", "phrase", "n"])


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", often: int = OFTEN, slice_bytes: int = SLICE) -> DataFrame:
    """``lang, words, phrase, n``: exact counts of all runs of one to three words that occur ``often`` (15 at most) times or
    more; ``words`` 0 is the number of all words. Written out."""
    if not 1 <= often <= 15:
        raise ValueError("a counter of the sketch has four bits")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text")).where(F.length("text") > 0)
    size = rows.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 1
    bits = _sketch_bits(size)
    blocks = rows.mapInArrow(partial(_sketch, bits, often, slice_bytes), "block int, data binary")
    summed = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(partial(_bits, often), "block int, data binary")
    hot = np.zeros(1 << (bits - 3), np.uint8)
    for block, data in summed.collect():  # a bit a counter, 32 MB at most
        bytes_ = np.frombuffer(data, np.uint8)
        hot[block * len(bytes_) : (block + 1) * len(bytes_)] = bytes_
    counted = rows.mapInArrow(partial(_counted, bits, spark.sparkContext.broadcast(hot), slice_bytes), "lang string, words tinyint, phrase string, n bigint")
    return cut(counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= often) | (F.col("words") == 0)))


def _score(a: Column, left: Column, right: Column, scale: int) -> Column:
    """``floor(scale * a * a / (left * right))`` in whole numbers of up to 38 digits (counts under 10^15)."""
    wide = lambda x: x.cast("decimal(15,0)")
    return F.call_function("div", F.lit(scale).cast("decimal(8,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, often: int = OFTEN, inside: int = INSIDE, slice_bytes: int = SLICE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best ``top`` phrases by the weakest of their cuts.

    Phrases that mostly occur inside a longer candidate (``inside`` percent or more) are left out. Null and empty texts
    have no words, a null language is ``und``; repeated rows count again, equal scores and counts are ordered by phrase.
    Very long texts are taken in parts cut at delimiters, no run reaches over one. Other columns are not read. An empty
    table gives no rows.
    """
    counts = phrase_counts(docs, text_col, lang_col, often, slice_bytes)
    words = F.split("phrase", " ")
    cand = counts.where("words >= 2").select("lang", "words", "phrase", F.col("n").alias("a"))
    part = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    longest = cand.where(f"words = {WORDS}").select("lang", F.explode(F.array(part(1, WORDS - 1), part(2, WORDS - 1))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = cand.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    cuts = kept.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    of = lambda name, count: counts.where(f"words BETWEEN 1 AND {WORDS - 1}").select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r"), SCALE).cast("bigint"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("s")).select("lang", "phrase", "s.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))  # a language can hold nearly all phrases
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    total = counts.where("words = 0").select("lang", F.col("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH pieces AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^ \\t]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
runs AS (SELECT lang, unnest([w[i], CASE WHEN len(w) > i THEN array_to_string(w[i : i + 1], ' ') END, CASE WHEN len(w) > i + 1 THEN array_to_string(w[i : i + 2], ' ') END]) AS phrase, unnest([1, 2, 3]) AS words FROM starts),
f AS (SELECT lang, words, phrase, count(*) AS n FROM runs WHERE phrase IS NOT NULL GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
cand AS (SELECT lang, words, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE words >= 2 AND n >= {OFTEN}),
inner_ AS (SELECT lang, array_to_string(w[1 + s : 2 + s], ' ') AS phrase, max(a) AS longer FROM cand, (SELECT unnest([0, 1]) AS s) WHERE words = 3 GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN inner_ i ON i.lang = c.lang AND i.phrase = c.phrase WHERE i.longer IS NULL OR 100 * i.longer < {INSIDE} * c.a),
cuts AS (SELECT *, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail FROM (SELECT *, unnest(range(1, words)) AS k FROM kept)),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, l.n AS l, r.n AS r, ({SCALE}::HUGEINT * c.a * c.a // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.head AND l.words < 3 JOIN f r ON r.lang = c.lang AND r.phrase = c.tail AND r.words < 3),
least_ AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM least_)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
