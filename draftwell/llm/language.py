"""Language identification with hyperdimensional profiles.

Each letter owns a random vector of +1 and -1. A three-letter sequence is bound by multiplying the vectors of its
letters after rotating the first by two places and the second by one, so that order counts. A text is the bundle
(sum) of its sequences, a language prototype the bundle of its training texts; texts are compared with prototypes
by cosine. Words are letters only, lower-cased, and a blank on either side takes part in the sequences.

Training needs no text at the driver: executors sum sequence counts for each language, and one row a language (the
prototype) is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import table
from .batches import slices

DIM = 512
SEED = 20_011
UND = "und"
_BITS = 21
_LOW = (1 << _BITS) - 1
_TEXTS, _CODES = 512, 4_096
_KEEP = 60_000  # sequence vectors kept by a worker: 120 MB


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low[0])
    return out


def sequences(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct three-letter sequences of a text as packed code points, and their counts. Blank is 32."""
    cps = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not cps.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cps = np.r_[np.uint32(0), cps, np.uint32(0)].astype(np.int64)
    cps = cps[np.r_[True, (cps[1:] != 0) | (cps[:-1] != 0)]]
    cps[cps == 0] = 32
    return np.unique((cps[:-2] << (2 * _BITS)) | (cps[1:-1] << _BITS) | cps[2:], return_counts=True)


class Vectors:
    """Vectors of letter sequences, made when first asked for."""

    def __init__(self, dim: int = DIM, seed: int = SEED) -> None:
        self.dim, self.seed = dim, seed
        self.letter: dict[int, np.ndarray] = {}
        self._forget()

    def _forget(self) -> None:
        self.codes = np.empty(0, np.int64)
        self.place = np.empty(0, np.int64)
        self.rows = np.empty((1024, self.dim), np.float32)
        self.used = 0

    def _letter(self, cp: int) -> np.ndarray:
        if (v := self.letter.get(cp)) is None:
            v = self.letter[cp] = (np.random.default_rng((self.seed, cp)).integers(0, 2, self.dim) * 2 - 1).astype(np.int8)
        return v

    def of(self, codes: np.ndarray) -> np.ndarray:
        """One row for each of the (sorted, distinct) packed sequences."""
        if self.used > _KEEP:
            self._forget()
        at = np.searchsorted(self.codes, codes)
        known = (at < len(self.codes)) & (self.codes[np.minimum(at, max(len(self.codes) - 1, 0))] == codes) if len(self.codes) else np.zeros(len(codes), bool)
        new = codes[~known]
        if len(new):
            made = [np.roll(self._letter(c >> (2 * _BITS)), 2) * np.roll(self._letter((c >> _BITS) & _LOW), 1) * self._letter(c & _LOW) for c in new.tolist()]
            while self.used + len(made) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.rows[self.used : self.used + len(made)] = made
            codes_, place = np.r_[self.codes, new], np.r_[self.place, np.arange(self.used, self.used + len(made))]
            order = np.argsort(codes_, kind="stable")
            self.codes, self.place = codes_[order], place[order]
            self.used += len(made)
            at = np.searchsorted(self.codes, codes)
        return self.rows[self.place[at]]

    def bundles(self, texts: list[tuple[np.ndarray, np.ndarray]], exact: bool = False) -> np.ndarray:
        """For each text, given by its sequences and counts, the sum of the vectors, each times its count.

        Matrix products over blocks of at most ``_TEXTS`` texts and ``_CODES`` sequences, 16 MB at most. Single precision
        holds the counts of one document; ``exact`` sums in double precision, which holds whole numbers up to 2 ** 53.
        """
        kind = np.float64 if exact else np.float32
        out = np.zeros((len(texts), self.dim), np.float64)
        for t in range(0, len(texts), _TEXTS):
            some = texts[t : t + _TEXTS]
            codes, place = np.unique(np.concatenate([c for c, _ in some]), return_inverse=True)
            counts = np.concatenate([n for _, n in some]).astype(kind)
            row = np.repeat(np.arange(len(some)), [len(c) for c, _ in some])
            for s in range(0, len(codes), _CODES):
                mine = (place >= s) & (place < s + _CODES) if len(codes) > _CODES else slice(None)
                dense = np.zeros((len(some), min(_CODES, len(codes) - s)), kind)
                dense[row[mine], place[mine] - s] = counts[mine]
                out[t : t + _TEXTS] += dense @ self.of(codes[s : s + _CODES]).astype(kind, copy=False)
        return out


@lru_cache(maxsize=2)
def _vectors(dim: int, seed: int) -> Vectors:
    return Vectors(dim, seed)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        langs = batch.column(0).to_pylist()
        parts: dict[str, list] = {}
        for lang, text in zip(langs, batch.column(1).to_pylist(), strict=True):
            parts.setdefault(lang, []).append(sequences(text))
        for lang, found in parts.items():
            codes, place = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([n for _, n in found]), minlength=len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])


def prototypes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dim: int = DIM, seed: int = SEED) -> dict[str, np.ndarray]:
    """Unit vectors by language, from every row with a language and a text. One row a language reaches the driver."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t")
    )
    counts = rows.mapInArrow(_counted, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        vectors = _vectors(dim, seed)
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                part = part.sort_values("code")
                v = vectors.bundles([(part["code"].to_numpy(), part["n"].to_numpy())], exact=True)[0]
                total[lang] = total.get(lang, 0) + v
        yield pd.DataFrame({"lang": list(total), "v": [x.tolist() for x in total.values()]})

    sums = counts.mapInPandas(partial, "lang string, v array<double>")
    rows = sums.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = rows.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    out = {}
    for r in sorted(found, key=lambda r: r.lang):
        v = np.round(np.array([p.x for p in r.v]))
        if norm := np.linalg.norm(v):
            out[r.lang] = v / norm
    return out


def _predicted(names: list[str], matrix: np.ndarray, dim: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _vectors(dim, seed)
        for batch in slices(batches, 1):
            found = [sequences(text or "") for text in batch.column(1).to_pylist()]
            sums = vectors.bundles(found)
            norm = np.linalg.norm(sums, axis=1)
            known = (norm > 0) & bool(names)
            lang, score = np.full(len(found), UND, object), np.zeros(len(found))
            if known.any():
                cos = np.round((sums[known] / norm[known, None]) @ matrix.T, 12)  # the last digits hang on who shares the batch
                best = cos.argmax(axis=1)
                lang[known] = [names[k] for k in best]
                score[known] = np.clip(cos[np.arange(len(best)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, learned: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", dim: int = DIM, seed: int = SEED) -> DataFrame:
    """``id, lang_pred, score`` for every row: the prototype of the largest cosine, and that cosine (0 if negative).

    Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing was learned. Equal
    cosines go to the language that sorts first. Repeated rows are all answered; other columns are not read. A very long
    text is a slice of its own; what it takes grows with its length and its distinct sequences.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = sorted(learned)
    matrix = np.stack([learned[n] for n in names]) if names else np.zeros((0, dim))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(_predicted(names, matrix, dim, seed), f"id {kind}, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = prototypes(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, learned).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
