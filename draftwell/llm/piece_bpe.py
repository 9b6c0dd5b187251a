"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut before each run of the space mark (no piece of the vocabulary holds a mark after another
character, which :class:`PieceBPE` checks). Arrow splits the texts of a slice and numbers their distinct words, so
Python sees a word once a slice, and words are encoded once per worker and looked up afterwards.
New words of a slice are laid side by side in one flat symbol array. A round finds the best pair of every word
by a segmented minimum over pair ranks, merges it at its leftmost places in all words at once, and compacts the
array; only pairs beside a merged place are looked up anew, and words without a pair left leave the array. Several
places in one word are merged together only where that gives what one-at-a-time merging gives; otherwise the word
merges its leftmost place alone in that round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import table
from .batches import slices

MARK = "▁"
CACHE_WORDS = 200_000
_NEVER = np.int64(1 << 40)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PieceBPE:
    """Encoder and decoder for a serialized BPE model with byte fallback and an identity normaliser."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        self.size = n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        scores = np.array([sp.get_score(i) for i in range(n)])
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        ids = {pieces[i]: i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a piece holds the space mark after another character: words cannot be cut there")
        _, order = np.unique(-scores, return_inverse=True)
        self.rank = order.astype(np.int64)
        self.bytes_of = [b""] * n
        self.byte_id = [0] * 256
        for i in range(n):
            if sp.is_byte(i):
                value = int(pieces[i][3:5], 16)
                self.byte_id[value] = i
                self.bytes_of[i] = bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.bytes_of[i] = pieces[i].replace(MARK, " ").encode()
        self.flat_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.byte_len = np.array([len(b) for b in self.bytes_of], np.int64)
        self.byte_start = np.cumsum(self.byte_len) - self.byte_len
        self.char_id = {p: i for p, i in ids.items() if len(p) == 1}
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                left, right = ids.get(p[:k]), ids.get(p[k:])
                if left is not None and right is not None:
                    pairs[left * n + right] = i
        self._file(pairs)
        self._forget()

    def _file(self, pairs: dict[int, int]) -> None:
        """Pairs in an open-addressed table that is at most an eighth full."""
        self.shift = np.uint64(64 - max(10, (8 * len(pairs)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.slot_key, self.slot_id = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        keys, ids = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        at = self._slot(keys)
        while len(keys):
            free = self.slot_key[at] < 0
            self.slot_key[at[free]], self.slot_id[at[free]] = keys[free], ids[free]  # of rivals for one slot the last wins
            lost = self.slot_key[at] != keys
            keys, ids, at = keys[lost], ids[lost], (at[lost] + 1) % size

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, -1 if none."""
        key = left * self.size + right
        at = self._slot(key)
        seen = self.slot_key[at]
        made = np.where(seen == key, self.slot_id[at], -1)
        open_ = np.flatnonzero((seen != key) & (seen >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.slot_key)
            seen = self.slot_key[at[open_]]
            hit = seen == key[open_]
            made[open_[hit]] = self.slot_id[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return np.where((left < self.size) & (right < self.size), made, -1)

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.start = self.count = np.empty(0, np.int64)

    def _lookup(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the places ``at`` the piece the pair begun there makes and that piece's rank (``_NEVER`` if it makes none)."""
        after = np.minimum(at + 1, len(sym) - 1)
        made = np.where((after > at) & (word[at] == word[after]), self._pair(sym[at], sym[after]), -1)
        return made, np.where(made >= 0, self.rank[made], _NEVER)

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and how many each has."""
        lens = np.array([len(w) for w in words], np.int64)
        chars, place = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), return_inverse=True)
        strange: list[str] = []
        table_ = np.empty(len(chars), np.int64)
        for k, c in enumerate(map(chr, chars.tolist())):
            i = self.char_id.get(c)
            if i is None:
                i = self.size + len(strange)
                strange.append(c)
            table_[k] = i
        sym, word = table_[place], np.repeat(np.arange(len(words)), lens)
        done_sym, done_word = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        made, rank = self._lookup(sym, word, np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[starts, len(sym)])
            best = np.minimum.reduceat(rank, starts)
            going = best < _NEVER
            if not going.all():
                live = np.repeat(going, size)
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, made, rank = sym[live], word[live], made[live], rank[live]
                best, size = best[going], size[going]
                if not len(sym):
                    break
            # of neighbouring places that overlap, every other one from the left
            at = np.flatnonzero(rank == np.repeat(best, size))
            fresh = np.r_[True, np.diff(at) > 1]
            first_of_run = np.repeat(at[fresh], np.diff(np.r_[np.flatnonzero(fresh), len(at)]))
            at = at[(at - first_of_run) % 2 == 0]
            lead = np.r_[True, word[at][1:] != word[at][:-1]]
            crowd = ~lead | np.r_[~lead[1:], False]
            if crowd.any():
                at = at[lead | self._together(sym, word, made, rank, at, crowd)]
            sym, word, made, rank = self._apply(sym, word, made, rank, at)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        sym, count = sym[order], np.bincount(word, minlength=len(words))
        if strange:
            # characters without a piece become the pieces of their bytes
            spelt = [np.array([self.byte_id[b] for b in c.encode()], np.int64) for c in strange]
            flat = np.concatenate([np.arange(self.size), *spelt])
            n = np.r_[np.ones(self.size, np.int64), [len(x) for x in spelt]]
            wide = n[sym]
            word = word[order]
            count = np.bincount(word, weights=wide, minlength=len(words)).astype(np.int64)
            sym = flat[_ranges((np.cumsum(n) - n)[sym], wide)]
        return sym, count

    def _together(self, sym: np.ndarray, word: np.ndarray, made: np.ndarray, rank: np.ndarray, at: np.ndarray, crowd: np.ndarray) -> np.ndarray:
        """For the places ``at``: whether all those of the word may be merged at once (``crowd``: the word has several)."""
        many = np.zeros(int(word[-1]) + 1, bool)
        many[word[at[crowd]]] = True
        unsafe = np.zeros(len(many), bool)
        part = at[crowd]
        # a place just after a merged one meets the new piece before it is merged itself
        sooner = self._pair(made[part], sym[part])
        sooner = (sooner >= 0) & (self.rank[sooner] <= rank[part])
        unsafe[word[part[sooner]]] = True
        # and what is made may itself be merged sooner than what is still to be made
        rows = np.flatnonzero(many[word])
        best = np.full(len(many), _NEVER)
        best[word[part]] = rank[part]
        _, w2, _, r2 = self._apply(sym[rows], word[rows], made[rows], rank[rows], np.searchsorted(rows, part))
        unsafe[w2[r2 <= best[w2]]] = True
        return ~unsafe[word[at]]

    def _apply(self, sym: np.ndarray, word: np.ndarray, made: np.ndarray, rank: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Merges the pairs begun at the places ``at``, compacts, and looks up the pairs that changed."""
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        new = sym.copy()
        new[at] = made[at]
        new, word, made, rank = new[keep], word[keep], made[keep], rank[keep]
        here = at - np.arange(len(at))
        near = np.concatenate([here, np.maximum(here - 1, 0)])
        made[near], rank[near] = self._lookup(new, word, near)
        return new, word, made, rank

    def _learn(self, words: list[str]) -> None:
        """Encodes words that are new and appends them to the pool."""
        ids, sizes = self._merge(words)
        self.index.update(zip(words, range(len(self.start), len(self.start) + len(words)), strict=True))
        self.start = np.r_[self.start, len(self.flat) + np.cumsum(sizes) - sizes]
        self.count = np.r_[self.count, sizes]
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])

    def _words(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words, the number of each word of the texts, and how many words each text has.

        A text splits at every space; a word has one mark, and one more for each empty part before it. Empty parts at
        the end are a word of marks alone. An empty text has no words.
        """
        parts = pc.split_pattern(pc.replace_substring(texts, MARK, " "), " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        count = np.diff(offsets)
        blank = code == (names.index("") if "" in names else -1)
        if not blank.any():
            return [MARK + w for w in names], code, count
        first = offsets[:-1] - offsets[0]
        place = np.arange(len(code))
        last = np.zeros(len(code), bool)
        last[offsets[1:] - offsets[0] - 1] = True
        # the nearest part before each one, of the same text, that is not empty
        before = np.maximum.accumulate(np.where(blank, -1, place))
        before = np.maximum(np.r_[-1, before[:-1]], np.repeat(first - 1, count))
        marks = place - before
        nothing = np.repeat((count == 1) & blank[first], count)
        taken = (~blank | last) & ~nothing
        doc = np.repeat(np.arange(len(count)), count)[taken]
        count = np.bincount(doc, minlength=len(count))
        code, marks = code[taken], marks[taken]
        wide = np.flatnonzero((marks > 1) | blank[taken])
        kinds, of = np.unique(marks[wide] * len(names) + code[wide], return_inverse=True)
        code[wide] = len(names) + of
        more = [MARK * (k // len(names)) + names[k % len(names)] for k in kinds.tolist()]
        used = np.zeros(len(names) + len(more), bool)
        used[code] = True
        rank = np.cumsum(used) - 1
        words = [MARK + w for w in names] + more
        return [words[k] for k in np.flatnonzero(used).tolist()], rank[code], count

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offset at which each text begins (one more offset than texts)."""
        if len(self.index) > CACHE_WORDS:
            self._forget()
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not len(texts):
            return np.empty(0, np.int32), np.zeros(1, np.int64)
        words, which, count = self._words(texts)
        known = [self.index.get(w, -1) for w in words]
        if fresh := [w for w, k in zip(words, known, strict=True) if k < 0]:
            self._learn(fresh)
            known = [self.index[w] for w in words]
        of = np.array(known, np.int64)[which]
        sizes = self.count[of]
        ids = self.flat[_ranges(self.start[of], sizes)]
        return ids, np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(count)]]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of the ids between the offsets; the space that encoding puts in front is taken off again."""
        data = self.flat_bytes[_ranges(self.byte_start[ids], self.byte_len[ids])].tobytes()
        ends = np.r_[0, np.cumsum(self.byte_len[ids])][offsets].tolist()
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            text = data[a:b].decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, side by side."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)


@lru_cache(maxsize=2)
def _codec(model: bytes) -> PieceBPE:
    return PieceBPE(model)


def _run(model: bytes):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in slices(batches, 1):
            ids, offsets = codec.encode(batch.column(1))
            texts = pa.array(codec.decode(ids, offsets), pa.string())
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, texts], names=["id", "ids", "decoded"])

    return go


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read once at the driver; its bytes (half a megabyte) go to the workers with the function."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``id, ids, decoded`` for every row: the token ids of the whole text, and the text they decode to.

    Null text is empty and has no ids. Rows come back as often as they came; other columns are not read. A very long
    text is a slice of its own; a worker holds about twenty times its size at once.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return rows.mapInArrow(_run(model_bytes(model)), f"id {kind}, ids array<int>, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digests(encode_decode(table(spark, sf_dir, "documents")))
