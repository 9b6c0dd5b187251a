"""Spelling variants, collocations and exact search against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from draftwell.llm import collocations, spelling, topk

UPPER = {c: c + 32 for c in range(65, 91)}


def plain_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


def plain_variants(counts):
    near = {w: [v for v in counts if spelling.one_apart(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        if vs and (best := min(vs, key=lambda v: (-counts[v], v))) and counts[best] >= 10 * counts[w]:
            form[w] = best
    rows = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return rows


def test_automaton_numbers_and_errors():
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(1, 8))) for _ in range(400)})
    automaton = spelling.Automaton(words)
    for i, w in enumerate(words):
        state, number = automaton.walk(automaton.root, 0, w, 0, len(w))
        assert automaton.final[state] and number == i
        for half in (0, len(w) // 2, len(w)):
            found = {words[j] for j in automaton.one_error(w, half)}
            assert found == {v for v in words if v[:half] == w[:half] and spelling.one_apart(w, v)}
    # shared endings are stored once
    assert len(spelling.Automaton(sorted(a + "ending" for a in "bcdf")).edges) < 10


@pytest.mark.parametrize("shard", [7, 10_000])
def test_variants(spark, shard):
    rng = random.Random(5)
    counts = {}
    for _ in range(150):
        w = "".join(rng.choices("abcé", k=rng.randint(7, 9)))
        counts[w] = rng.choice([2, 3, 30, 400])
    for _ in range(150):  # a heap that shares its first half, and chains of forms
        counts["aaaa" + "".join(rng.choices("ab", k=4))] = rng.choice([2, 25, 300, 4000])
    counts["a" * 3000] = 2
    counts["a" * 3001] = 50
    counts["ab" * 1500] = 2
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    rows = spelling.variants(frame, shard=shard).collect()
    assert {tuple(r) for r in rows} == plain_variants(counts) and len(rows) == len(counts)


def test_spelling_of_documents(spark):
    rng = random.Random(9)
    base = ["".join(rng.choices("aeinrsté", k=rng.randint(5, 10))) for _ in range(30)]
    docs = [(None if i % 40 == 0 else i, " ".join(rng.choice([w, w.title(), w.upper()]) for w in rng.choices(base, k=60)) + "1Wörter×x") for i in range(300)] + [(1, None), (2, "")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(2))
    assert {tuple(r) for r in spelling.spelling_variants(frame).collect()} == plain_variants(plain_words(docs))
    assert spelling.spelling_variants(frame.limit(0)).count() == 0


def plain_collocations(docs, top=2000):
    f, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    cand = {c: a for c, a in f.items() if len(c) > 2 and a >= 10}
    rows = defaultdict(list)
    for c, a in cand.items():
        if any(len(x) > len(c) and x[0] == c[0] and c[1:] in (x[1:3], x[2:]) and 100 * b >= 50 * a for x, b in cand.items()):
            continue
        cuts = [(1000000 * a * a // (f[c[: k + 1]] * f[(c[0], *c[k + 1 :])]), k) for k in range(1, len(c) - 1)]
        score, k = min(cuts)
        rows[c[0]].append((-score, -a, " ".join(c[1:]).encode(), f[c[: k + 1]], f[(c[0], *c[k + 1 :])]))
    return {(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, found in rows.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])}


@pytest.mark.parametrize("slice_bytes", [300, 4_000_000])
def test_collocations(spark, slice_bytes):
    rng = random.Random(4)
    names = ["a", "B", "c", "É", "é", "x y", "la", "\U0001d4b3", "z"]
    docs = []
    for i in range(120):
        words = "".join(rng.choice(names) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\r\n", "\x0b", " ,", "-"]) for _ in range(rng.randint(0, 60)))
        docs.append((rng.choice(["en", "en", "de", None, "und"]), words))
    docs += [("en", None), ("en", ""), (None, " \t "), ("xx", "a a a a a a a a a a a a a"), ("yy", "..."), ("en", "new york city " * 3000)]
    frame = spark.createDataFrame(docs, "lang string, text string").withColumn("a", F.lit(1)).withColumn("score", F.lit(2))
    rows = [tuple(r) for r in collocations.collocations(frame, slice_bytes=slice_bytes).collect()]
    assert set(rows) == plain_collocations(docs) and len(set(rows)) == len(rows)
    few = {tuple(r) for r in collocations.collocations(frame, top=5, slice_bytes=slice_bytes).collect()}
    assert few == plain_collocations(docs, 5)
    assert collocations.collocations(frame.limit(0)).count() == 0


def test_collocation_scores_are_exact_beyond_64_bits(spark):
    big = 10**13 + 7
    row = spark.range(1).select(collocations._score(F.lit(big), F.lit(big + 1), F.lit(big + 12), collocations.SCALE).alias("s")).first()
    assert row.s == 1_000_000 * big * big // ((big + 1) * (big + 12))


def plain_top(rows, k=5):
    good = [(i, v, [math.floor(256 * x) for x in vec]) for i, (v, vec) in enumerate(rows) if vec is not None and all(x is not None and math.isfinite(x) for x in vec)]
    out = []
    for i, v, q in good:
        if v is not None and v % 50 == 0:
            hits = sorted((-sum(a * b for a, b in zip(q, x, strict=False)), w is None, w or 0, j, w) for j, w, x in good if j != i)[:k]
            out += [(v, r + 1, w, -s) for r, (s, _, _, _, w) in enumerate(hits)]
    return sorted(out, key=str)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 12)) * [[0.1], [1], [1], [1], [3], [8]]
    rows = [(int(i), [float(x) for x in centres[i % 6] + rng.normal(size=12) * 0.2]) for i in range(3000)]
    rows += [(int(i), rows[100][1]) for i in range(3000, 3400)] + [(3400, [0.0] * 12), (3401, None), (3450, [float("nan")] * 12), (3500, [float("inf")] * 12), (3550, [1.0, None]), (None, rows[4][1]), (50, rows[50][1]), (50, rows[100][1])]
    rows += [(3600, []), (3601, [5.0, -1.0]), (3650, [1e30, 1.0]), (3651, [1e30, -3.0, 2.0])]
    plain = [r for r in rows if r[1] is None or all(x is None or abs(x) < 1e9 or not math.isfinite(x) for x in r[1])]
    frame = lambda x: spark.createDataFrame(x, "vec_id bigint, embedding array<double>").withColumn("label", F.lit(1)).withColumn("row", F.lit(0)).withColumn("score", F.lit(0)).repartition(6)
    run = lambda x: sorted(map(tuple, topk.top_k(frame(x), F.col("vec_id") % 50 == 0).collect()), key=str)
    assert run(plain) == plain_top(plain)
    wide = run(rows)
    assert {r[3] for r in wide if r[0] == 3650} == {2**63 - 1} and {r for r in wide if r[0] == 3600} == {(3600, i + 1, i, 0) for i in range(5)}  # scores beyond a long stop at its end
    assert topk.top_k(frame(rows[:1]).limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert run(rows[:3]) == plain_top(rows[:3])


def test_blocks_are_passed_over():
    """The bounds do eliminate: far groups are not evaluated."""
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(200, 8)) * 5 + 3000, rng.normal(size=(4000, 8)) * 5]).round()
    pivots = [np.zeros(1), x[0], x[-1]]
    far, square = topk._distances(x, pivots)
    block = topk._Block(np.arange(len(x)), np.arange(len(x)), x, far, square)
    seen = []
    products = topk._products
    topk._products = lambda few, q: seen.append(len(few)) or products(few, q)
    try:
        best = block.best(x[7], far[7], square[7], 6, None)
    finally:
        topk._products = products
    assert sum(seen) <= 320 and [-s for s, _, _ in best] == sorted((x @ x[7]).astype(int).tolist(), reverse=True)[:6]


def test_top_k_gives_its_visits_in_bounded_batches():
    """Without useful bounds every query visits every block: one row a group of blocks, in batches of bounded size."""
    blocks, queries, groups = 600, 1000, 20
    double = lambda *v: np.array(v, dtype=float).tobytes()
    rows = [(0, 0, None, None, b, None, None, None, double(0.0), double(9.0), 1.0, b % groups) for b in range(blocks)]
    rows += [(0, 0, 10_000 + g, None, None, b"x" * 512, double(5.0), double(25.0), None, None, None, None) for g in range(queries)]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.int64()]
    names = ["chunk", "piece", "gid", "floor", "block", "data", "far", "square", "low", "high", "most", "kin"]
    batch = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    given = list(topk._routed(iter([batch])))
    assert max(b.num_rows for b in given) <= topk.GIVEN and sum(b.num_rows for b in given) == queries * groups
    seen = [(g, m) for b in given for g, must in zip(b.column("gid").to_pylist(), b.column("must").to_pylist(), strict=True) for m in must]
    assert len(seen) == len(set(seen)) == queries * blocks


def test_the_sketch_grows_with_the_text():
    """A counter for every 16 bytes or fewer up to 4 GB, and at 10 GB still one for every 40."""
    for size in (10**6, 10**8, 84 * 10**7, 4 * 10**9):
        assert size / (1 << collocations._sketch_bits(size)) <= 16
    assert 10**10 / (1 << collocations._sketch_bits(10**10)) < 40
    assert collocations._sketch_bits(0) > collocations.BLOCK_BITS


def test_marks_are_as_different_as_the_words():
    for n in (1, 46, 47, 2200):
        own = collocations._Slice(" ".join(f"w{k}" for k in range(n)).encode())
        marks = own.marks().to_pylist()
        assert len(set(marks)) == n and len({len(m) for m in marks}) == 1
        assert all(ord(m[0]) < collocations._OTHERS and all(ord(c) >= collocations._OTHERS for c in m[1:]) for m in marks)
