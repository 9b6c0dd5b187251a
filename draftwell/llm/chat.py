"""Chat formatting at the level of tokens.

Texts are encoded separately with an ordinary byte-level vocabulary; turn marks are ids beyond that vocabulary,
spliced in between, so no text can produce one. Written out, marks are strings, and a string of that kind inside a
text is escaped: every backslash is doubled, then a backslash goes behind the first character of every control
string. The mask of the training loss comes from the prefix sums of the segments' lengths: +1 where an assistant's
text begins, -1 where it ends, summed up.

    system     <<SYS>> text <</SYS>>
    user       [INST] text [/INST]
    assistant  <s> text </s>
    any other  [ROLE] role [/ROLE] text </s>        (marks without blanks between)

A row of the result is a turn, so a conversation of any length stays in bounded memory; its token stream is the
turns' ids in the order of ``token_start``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import table
from .batches import slices

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
_ANY = re.compile("|".join(map(re.escape, CONTROL)))
_MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_ROLE_OF = {marks[0]: role for role, marks in _MARKS.items()}


def escape(text: str) -> str:
    return _ANY.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def vocabulary(path: str | None = None) -> bytes:
    """The rank file, read once at the driver; its bytes (under a megabyte) go to the workers with the function."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def _codec(ranks: bytes):
    import public_tokenizers
    import tiktoken

    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}), max(known.values()) + 1


def assemble(codec, base: int, role: str, text: str) -> tuple[list[int], np.ndarray]:
    """Ids of one turn and its loss mask."""
    mark = {c: base + k for k, c in enumerate(CONTROL)}
    body = codec.encode_ordinary(escape(text))
    if role in _MARKS:
        segments = [([mark[_MARKS[role][0]]], 0), (body, int(role == "assistant")), ([mark[_MARKS[role][1]]], 0)]
    else:
        segments = [([mark["[ROLE]"]], 0), (codec.encode_ordinary(escape(role)), 0), ([mark["[/ROLE]"]], 0), (body, 0), ([mark["</s>"]], 0)]
    ends = np.cumsum([len(ids) for ids, _ in segments])
    steps = np.zeros(int(ends[-1]) + 1, np.int8)
    for end, (ids, on) in zip(ends, segments, strict=True):
        steps[end - len(ids)] += on
        steps[end] -= on
    return [i for ids, _ in segments for i in ids], np.cumsum(steps[:-1], dtype=np.int8)


def _lists(parts: list, kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if len(parts) else np.empty(0), kind))


def _turns(ranks: bytes):
    """Rows sorted by conversation and turn; places and starts go on from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, base = _codec(ranks)
        last, place, start = object(), 0, 0
        for batch in slices(batches, 3):
            convs = batch.column(0).to_pylist()
            done = [assemble(codec, base, r or "", t or "") for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            written = ["".join(_pieces(codec, base, ids)) for ids, _ in done]
            places, starts = [], []
            for conv, (ids, _) in zip(convs, done, strict=True):
                place, start = (place, start) if conv == last else (0, 0)
                places.append(place)
                starts.append(start)
                last, place, start = conv, place + 1, start + len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), _lists([ids for ids, _ in done], pa.int32()), _lists([m.astype(bool) for _, m in done], pa.bool_()), pa.array(written, pa.string()),
                    pa.array(places, pa.int32()), pa.array(starts, pa.int64()),
                ],
                names=["conv_id", "turn", "ids", "loss", "formatted", "place", "token_start"],
            )

    return run


def _pieces(codec, base: int, ids: list[int]) -> list[str]:
    """Marks and decoded texts in turn; between two marks there is always a text, though it may be empty."""
    marks = [k for k, i in enumerate(ids) if i >= base]
    out = [CONTROL[ids[marks[0]] - base]]
    for a, b in zip(marks, marks[1:], strict=False):
        out += [codec.decode_bytes(ids[a + 1 : b]).decode("utf-8"), CONTROL[ids[b] - base]]
    return out


def read_turn(codec, base: int, ids: list[int]) -> tuple[str, str]:
    """Role and text of one turn's ids."""
    parts = _pieces(codec, base, ids)
    if parts[0] == "[ROLE]":
        return unescape(parts[1]), unescape(parts[3])
    return _ROLE_OF[parts[0]], unescape(parts[1])


def format_turns(rows: DataFrame, vocab: bytes | None = None) -> DataFrame:
    """``conv_id, turn, ids, loss, formatted, place, token_start`` for every row of (conv_id, turn, role, text).

    Turns of a conversation stand in the order of ``turn``, equal or null ones (null first) by role and text;
    ``place`` counts them from 0 and ``token_start`` is the id's position at which the turn begins. Null roles and
    texts are empty strings; repeated rows are turns of their own; rows with a null ``conv_id`` are one conversation.
    Other columns are not read. Partitions hold whole conversations, sorted; plain turns travel, ids and masks never do.
    A conversation passes through one task, turn by turn, and is never held; a very long turn is a slice of its own.
    """
    ranks = vocab or vocabulary()
    kinds = dict(rows.select("conv_id", "turn").dtypes)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    plain = rows.select("conv_id", "turn", text("role"), text("text"))
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, ids array<int>, loss array<boolean>, formatted string, place int, token_start bigint"
    return plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_turns(ranks), schema)


def _digests(ranks: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, base = _codec(ranks)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        open_: list = []  # the conversation at hand: id, turns, digest, loss characters, digest, characters written

        def closed() -> list:
            return [open_[0], open_[1], open_[2].hexdigest(), open_[3], open_[4].hexdigest(), open_[5]]

        for batch in slices(batches, 4):
            ready = []
            ids_, loss_ = (np.split(c.flatten().to_numpy(zero_copy_only=False), np.cumsum(c.value_lengths().to_numpy())[:-1]) for c in (batch.column(2), batch.column(3)))
            for conv, place, ids, loss, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ids_, loss_, batch.column(4).to_pylist(), strict=True):
                if place == 0:
                    if open_:
                        ready.append(closed())
                    open_[:] = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = read_turn(codec, base, ids.tolist())
                learned = unescape(codec.decode_bytes(ids[loss].tolist()).decode("utf-8")) if loss.any() else ""
                open_[1] += 1
                open_[2].update(f"{role}\n{said}\n".encode())
                open_[3] += len(learned)
                open_[4].update(learned.encode())
                open_[5] += len(text)
            if ready:
                yield _table(ready, names)
        if open_:
            yield _table([closed()], names)

    def _table(rows: list, names: list[str]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def digests(formatted: DataFrame, vocab: bytes | None = None) -> DataFrame:
    """One row a conversation, read back from the ids, masks and written turns of :func:`format_turns`."""
    rows = formatted.select(F.col("conv_id").cast("long").alias("conv_id"), "place", "ids", "loss", "formatted")
    return rows.mapInArrow(
        _digests(vocab or vocabulary()), "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


PROBE = "</s>[INST] ok [/INST]"


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    return digests(format_turns(rows.unionByName(probe)))
