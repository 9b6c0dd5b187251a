"""Line-level quality by a linear-chain conditional random field.

Every line of a text is labelled bad (0) or good (1). A line's potentials come from its own surface features and
from those of the lines before and after it; the chain adds a score for each pair of neighbouring labels. The
document's quality is the mean of the lines' forward-backward marginals, weighted by their length. The field is
trained by gradient ascent on documents whose label all their lines share, with the corpus rows that the caller
allows; at most ``SAMPLE`` documents, chosen by a hash of the identifier, are gathered for that, as features of at most
``LINES`` lines each. Scores always come from all lines of a text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import table
from .batches import slices

SAMPLE = 2_500
LINES = 512
SEGMENT = 64
ROUNDS = 150
OWN = 9  # features of a line itself
WIDTH = 1 + 3 * OWN + 2

_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 odd mark, 4 white space, 5 letter below 128
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?"]] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[97:123] = 5


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x ``WIDTH``) and byte lengths of the lines that are not blank; none for an empty text."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    if not lines:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0, np.float64)
    size = np.array([len(x) for x in lines], np.float64)
    kinds = _CLASS[np.frombuffer(b"".join(lines), np.uint8)]
    starts = np.r_[0, np.cumsum(size[:-1])].astype(np.int64)
    share = [np.add.reduceat(kinds == k, starts, dtype=np.int64) / size for k in (1, 2, 3, 4)]
    own = np.zeros((len(lines), OWN), np.float32)
    own[:, 0] = np.minimum(np.log1p(size) / 8, 2)
    own[:, 1:5] = np.stack(share, axis=1) * np.array([2, 4, 8, 2])
    seen: set[bytes] = set()
    before: set[bytes] = set()
    for i, line in enumerate(lines):
        words = line.split()
        few = set(words)
        own[i, 5] = len(few) / len(words)
        own[i, 6] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
        own[i, 7] = line in seen
        own[i, 8] = len(few & before) / len(few)
        seen.add(line)
        before = few
    out = np.zeros((len(lines), WIDTH), np.float32)
    out[:, 0] = 1
    out[:, 1 : 1 + OWN] = own
    out[1:, 1 + OWN : 1 + 2 * OWN] = own[:-1]
    out[:-1, 1 + 2 * OWN : 1 + 3 * OWN] = own[1:]
    out[0, -2] = 1
    out[-1, -1] = 1
    return out, size


@dataclass(frozen=True)
class Field:
    """Weights of the potentials of label 1 (label 0 has none), 2 x 2 label-pair scores, and the prior of label 1."""

    weights: np.ndarray
    pairs: np.ndarray
    prior: float

    def marginals(self, features: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every line, by the forward-backward recursion in log space."""
        unary = features @ self.weights
        _, fwd, bwd, z = _recursions(unary[None, :], self.pairs)
        return np.exp(fwd[0, :, 1] + bwd[0, :, 1] - z[0])

    def quality(self, text: bytes | None) -> float:
        features, size = line_features(text or b"")
        if not len(size):
            return self.prior
        if len(size) == 1:
            return float(1 / (1 + np.exp(-np.clip(features[0] @ self.weights, -500, 500))))
        return float(np.clip(np.average(self.marginals(features), weights=size), 0, 1))


def _recursions(unary: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log potentials, forward and backward messages and log partition for chains of one length (chains x lines)."""
    b, n = unary.shape
    pot = np.stack([np.zeros_like(unary), unary], axis=2)
    fwd, bwd = np.empty((b, n, 2)), np.zeros((b, n, 2))
    fwd[:, 0] = pot[:, 0]
    for t in range(1, n):
        fwd[:, t] = pot[:, t] + np.logaddexp(fwd[:, t - 1, 0, None] + pairs[0], fwd[:, t - 1, 1, None] + pairs[1])
    for t in range(n - 2, -1, -1):
        nxt = pot[:, t + 1] + bwd[:, t + 1]
        bwd[:, t] = np.logaddexp(nxt[:, 0, None] + pairs[:, 0], nxt[:, 1, None] + pairs[:, 1])
    return pot, fwd, bwd, np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])


def train(chains: list[tuple[np.ndarray, int]], rounds: int = ROUNDS, ridge: float = 1e-3, prior: float | None = None) -> Field:
    """Fit by Adam on the mean log-likelihood a line; ``chains`` are (features, label of all lines), ``prior`` by default the share of 1."""
    chains = [c for c in chains if len(c[0])]
    if not chains:
        return Field(np.zeros(WIDTH), np.zeros((2, 2)), 0.5)
    prior = sum(y for _, y in chains) / len(chains) if prior is None else prior
    groups: dict[int, list[tuple[np.ndarray, int]]] = {}
    for f, y in chains:
        groups.setdefault(len(f), []).append((f, y))
    packed = [(np.stack([f for f, _ in g]).astype(np.float64), np.array([y for _, y in g])) for _, g in sorted(groups.items())]
    lines = sum(len(f) for f, _ in chains)
    theta = np.zeros(WIDTH + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, pairs = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        grad = np.zeros_like(theta)
        for x, y in packed:
            _, fwd, bwd, z = _recursions(x @ w, pairs)
            one = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None])
            grad[:WIDTH] += np.einsum("bt,btf->f", y[:, None] - one, x)
            if x.shape[1] > 1:
                pot = np.stack([np.zeros(one.shape), x @ w], axis=2)
                both = fwd[:, :-1, :, None] + pairs + (pot + bwd)[:, 1:, None, :] - z[:, None, None, None]
                grad[WIDTH:] -= np.exp(both).sum(axis=(0, 1)).ravel()
                grad[WIDTH] += (y == 0).sum() * (x.shape[1] - 1)
                grad[WIDTH + 3] += (y == 1).sum() * (x.shape[1] - 1)
        grad = grad / lines - ridge * theta
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:WIDTH].copy(), theta[WIDTH:].reshape(2, 2).copy(), prior)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def excerpts(x: np.ndarray, lines: int) -> list[np.ndarray]:
    """A chain of at most ``lines`` lines as it is; of a longer one whole segments from all over it, in the order of their hash."""
    if len(x) <= lines:
        return [x]
    step = min(SEGMENT, lines)
    parts = sorted((x[a : a + step].tobytes() for a in range(0, len(x), step)), key=lambda p: (zlib.crc32(p), p))
    return [np.frombuffer(p, x.dtype).reshape(-1, x.shape[1]) for p in parts[: lines // step]]


def _features(lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [[p.tobytes() for p in excerpts(line_features(t or b"")[0], lines)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary())), batch.column(2)], names=["y", "xs", "k"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Train on labelled rows outside the held-out third: at most ``sample`` identifiers, in the order of their hash.

    A text gives at most ``lines`` lines to the training: one of more lines gives segments from all over it, with the features of
    their neighbours outside. So a row sends at most ``lines`` times ``WIDTH`` floats to the driver, however long its text is, and
    ``sample`` rows at most do, however often an identifier is repeated: 2,500 x 512 x 120 bytes, 154 MB at the very worst.
    Rows without a label, with a label other than 0 or 1, or without a text are no examples. No examples at all
    give a field that scores every text 0.5.
    """
    good = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    few = good.select(F.struct(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).alias("few")).distinct()
    few = few.orderBy(F.xxhash64("few.id"), "few.id", "few.y").limit(sample)
    # both sides are one column of a name of their own: no column of the documents can clash
    texts = docs.where(F.col(text_col).isNotNull()).select(F.struct(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("t")).alias("doc"))
    rows = texts.join(F.broadcast(few), F.col("doc.id") == F.col("few.id")).select(F.col("few.y").alias("y"), F.col("doc.t").alias("t"), F.xxhash64("few.id").alias("k"))
    # an identifier may stand on many rows: of those, too, at most ``sample`` travel
    found = rows.mapInArrow(_features(lines), "y int, xs array<binary>, k bigint").orderBy(F.xxhash64("k", "y", "xs")).limit(sample).collect()
    found.sort(key=lambda r: (r.y, [bytes(x) for x in r.xs]))  # the result doesn't hang on the order of arrival
    counted = [r.y for r in found if r.xs[0]]  # a text counts once, however many segments it gives
    chains = [(np.frombuffer(x, np.float32).reshape(-1, WIDTH), r.y) for r in found for x in r.xs]
    return train(chains, prior=sum(counted) / len(counted) if counted else None)


def _scores(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            scores = [field.quality(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return run


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` for every row; texts without a line that isn't blank (null ones too) score the prior."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))
    return rows.mapInArrow(_scores(field), f"id {kind}, score double")


def keep_good(docs: DataFrame, field: Field, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more; columns as they came, nothing is joined."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, names.index(text_col)):
            texts = batch.column(names.index(text_col)).to_pylist()
            yield batch.filter(pa.array([field.quality((t or "").encode()) >= least for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, field)
    return scored.select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
