"""Cliques of loose components: very many small problems are shared out over tasks, many to a batch."""

import itertools

import pandas as pd
from pyspark.sql import functions as F

from draftwell.operators import topology


def test_cliques_across_batches():
    rows = [(v, p, q) for v in range(0, 900, 3) for p, q in ((v + 1, v + 1), (v + 2, v + 2), (v + 1, v + 2))]
    want = [(v, [v, v + 1, v + 2]) for v in range(0, 900, 3)]
    frame = pd.DataFrame(rows, columns=["v", "p", "q"])
    batches = (frame.iloc[i : i + 7] for i in range(0, len(frame), 7))
    got = list(itertools.chain.from_iterable(zip(x["v"], x["clique"], strict=True) for x in topology._first_cliques(batches)))
    assert [(int(v), list(c)) for v, c in got] == want


def test_cliques_are_shared_out_over_tasks(spark, monkeypatch):
    frames, n = [], 300

    def watched(df, was=topology.stored):
        frames.append(was(df))
        return frames[-1]

    links = spark.range(n).select(F.explode(F.array(*[F.struct((F.col("id") * 3 + a).alias("a"), (F.col("id") * 3 + b).alias("b")) for a, b in ((0, 1), (1, 2))])).alias("l")).select("l.*")
    comp = topology.components(links)
    monkeypatch.setattr(topology, "stored", watched)
    got = topology.maximal_cliques(links, comp)
    assert sorted(r.clique for r in got.collect()) == sorted([k * 3 + a, k * 3 + a + 1] for k in range(n) for a in (0, 1))
    found = next(f for f in frames if f.columns == ["v", "clique"])
    assert len(found.inputFiles()) >= 4  # one file a task
