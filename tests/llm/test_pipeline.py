"""The stages one after another, against what they must keep and drop."""

import corpus_pipeline
from draftwell.llm import registry

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import __spark_entry__

    assert set(registry.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact dedup", "near dedup", "decontamination", "encoding"]
    start = spark.read.parquet(f"{SF}/documents.parquet")
    docs, sizes = start, [start.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == start.columns
        docs = spark.createDataFrame(docs.toPandas(), start.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] / 2
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len({t.lower() for t in texts.values()}) == len(texts)
    bench = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(b in " ".join(t.lower().split()) for t in texts.values() for b in bench)
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.text for r in out} == texts and all(len(r.ids) == r.n_tokens for r in out)


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run_equals_a_plain_version(spark):
    """What follows the quality stage, by all pairs, all alignments and the library."""
    import re

    import numpy as np
    from sentencepiece import SentencePieceProcessor

    from draftwell.llm import piece_bpe

    start = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in corpus_pipeline.keep_quality(spark, start, SF).collect())
    ascii_low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    last = {}
    for i, t in rows:  # of equal texts the largest identifier stays
        last[t.translate(ascii_low)] = (i, t)
    rows = sorted(last.values())
    # one of each group that pairs of five-word similarity 0.8 connect: the smallest identifier
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", t.translate(ascii_low))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small >= 0.8 * large and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    rows = [r for k, r in enumerate(rows) if root(k) == k]
    # no alignment with an item may have four fifths of 16 consecutive item tokens, of all if the item is shorter
    number = {}
    tokens = lambda t: np.array([number.setdefault(w, len(number)) for w in re.findall(r"[^\W_]+", t.lower())], np.int64)
    items = [x for x in (tokens(r.text or "") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()) if len(x) >= 8]

    def dirty(text):
        doc = tokens(text)
        for item in items:
            n, w = len(item), min(16, len(item))
            padded = np.concatenate([np.full(n, -1), doc, np.full(n, -1)])
            same = np.stack([padded[j : len(padded) - n + j] == item[j] for j in range(n)]).astype(np.int64)
            sums = np.vstack([np.zeros((1, same.shape[1]), np.int64), same.cumsum(axis=0)])
            if ((sums[w:] - sums[:-w]) * 5 >= 4 * w).any():
                return True
        return False

    rows = [(i, t) for i, t in rows if not dirty(t)]
    library = SentencePieceProcessor(model_proto=piece_bpe.model_bytes())
    want = {i: (library.encode(t), library.decode(library.encode(t))) for i, t in rows}
    got = {r.doc_id: (r.ids, r.text) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == want.keys() and got == want


def test_stages_take_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows and identifiers, and columns with inner names."""
    long = "one two three four five six seven eight nine ten " * 30_000
    odd = [(1, None, None), (1, None, None), (None, "", "x"), (None, None, None), (2, long, "en"), (2, long, "en"), (3, long.upper(), None), (4, " \n\t ", None), (5, "the same text", "en"), (5, "another text", "en"), (None, "the same text", "en")]
    schema = "doc_id bigint, text string, lang string, node bigint, sig binary, key bigint, t string, y int, __text_sha string, __text_key string, __id bigint"
    docs = spark.createDataFrame([(i, t, g, 1, b"s", 2, "t", 1, "s", "k", 3) for i, t, g in odd], schema)
    texts = {(i, t) for i, t, _ in odd}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name != "encoding":
            assert out.columns == docs.columns and {(r.doc_id, r.text) for r in rows} <= texts and all((r.node, r.key, r.t, r.y) == (1, 2, "t", 1) for r in rows)
        else:
            assert len(rows) == len(odd) and {r.n_tokens for r in rows if r.text == ""} == {0}
        if name == "exact dedup":
            assert len({(r.text or "").lower() for r in rows}) == len(rows) == 5
        if name == "near dedup":
            assert sum((r.text or "").lower() == long for r in rows) <= 2 and any(r.text == "another text" for r in rows)
        if name == "decontamination":
            assert len(rows) == len(odd)
