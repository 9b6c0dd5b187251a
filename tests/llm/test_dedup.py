"""Exact, near and substring deduplication and decontamination against brute force."""

import hashlib
import itertools
import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from draftwell.llm import decontaminate, exact_dedup, simhash, substring_dedup

SCHEMA = "doc_id bigint, text string, salt int, key string, id int"  # further columns whose names clash with inner ones


def docs(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, 7, "k", 3) for i, t in rows], schema).repartition(3)


WORDS = ["alpha", "beta", "gamma", "delta", "of", "the", "to", "ümläut", "x"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ---- exact


def test_exact_groups(spark):
    rows = [(1, "Abc"), (2, "aBC"), (3, "abc "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 200_000), (9, "X" * 200_000), (None, "abc"), (10, "solo"), (10, "solo")]
    got = exact_dedup.exact_groups(docs(spark, rows), keep="max").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert [(r.keep_id, r.group_size, r.kept) for r in by[1] + by[2] + by[None]] == [(2, 3, False), (2, 3, True), (2, 3, False)]
    assert (by[4][0].keep_id, by[5][0].kept) == (5, True) and by[6][0].kept and by[7][0].kept and by[8][0].keep_id == 9
    assert sorted(r.kept for r in by[10]) == [False, True] and by[10][0].group_size == 2
    assert by[1][0].text_sha256 == hashlib.sha256(b"abc").hexdigest()
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


def test_exact_dedup_keeps_columns_and_one_row(spark):
    rows = [(1, "a"), (2, "A"), (3, "b"), (3, "b"), (None, "c"), (None, None), (4, "")]
    for keep, want in (("min", [(1, "a"), (3, "b"), (4, ""), (None, "c")]), ("max", [(2, "A"), (3, "b"), (4, ""), (None, "c")])):
        out = exact_dedup.exact_dedup(docs(spark, rows), keep=keep)
        assert out.columns == ["doc_id", "text", "salt", "key", "id"]
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_exact_hot_group(spark):
    rows = [(i, "same text") for i in range(400)] + [(1000 + i, f"other {i}") for i in range(50)]
    got = exact_dedup.exact_groups(docs(spark, rows)).where("kept").collect()
    assert sorted(r.id for r in got) == [0, *range(1000, 1050)]


def test_exact_runs_over_borders(spark):
    """Long common prefixes, and groups that several ranges share, against plain grouping."""
    rng = random.Random(8)
    stem = "Lorem " * 2000
    rows = [(i, stem + str(rng.randrange(12))) for i in range(300)] + [(400 + i, rng.choice(["hot", "HOT"])) for i in range(900)]
    rows += [(2000 + i, f"own {i}") for i in range(100)] + [(3000 + i, None) for i in range(150)] + [(410, "hot"), (None, "hot"), (None, "hot")]
    want = {}
    for i, t in rows:
        want.setdefault((t or "").lower(), []).append(i)
    for keep, best in (("max", max), ("min", min)):
        got = exact_dedup.exact_groups(docs(spark, rows), keep=keep, partitions=16).collect()
        assert len(got) == len(rows)
        sizes = {hashlib.sha256(t.encode()).hexdigest(): (len(g), best(x for x in g if x is not None)) for t, g in want.items()}
        assert all((r.group_size, r.keep_id) == sizes[r.text_sha256] for r in got)
        assert sorted(r.id for r in got if r.kept) == sorted(b for _, b in sizes.values())
        assert sum(r.again for r in got) == 2


def test_exact_splitters_are_short(spark):
    frame = docs(spark, [(i, "é" * 100_000 + str(i)) for i in range(40)])
    keys = exact_dedup._splitters(frame, "doc_id", "text", 8)
    assert len(keys) == 7 and all(len(h) <= exact_dedup.PREFIX for h, _, _ in keys)


def test_clashing_names(spark):
    """Columns called like inner ones come back untouched, from every stage."""
    from draftwell.llm import quality

    schema = "doc_id bigint, text string, y int, __text_sha string, __text_key string, __id int, __sha string, __key int, few int, doc int, range int, norm int, hash int"
    rows = [(i, t, 1, "s", "k", 2, "h", 3, 4, 5, 6, 7, 8) for i, t in [(1, "a b"), (2, "A b"), (3, "one two three four five six seven eight nine ten"), (4, None), (3, "other")]]
    frame = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1, 9), (2, 0, 9), (3, 1, 9), (4, 0, 9), (None, 1, 9)], "doc_id bigint, quality int, y int")
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", 1)], "item_id bigint, text string, il int")
    tail = tuple(rows[0][2:])
    for out, ids in (
        (exact_dedup.exact_dedup(frame), [1, 3, 3, 4]),
        (decontaminate.decontaminate(frame, items), [1, 2, 3, 4]),
        (simhash.near_dedup(frame, shingle=5, similarity=0.8), [1, 3, 3, 4]),
        (quality.keep_good(frame, quality.fit(frame, labels), least=0.0), [1, 2, 3, 3, 4]),
    ):
        assert out.columns == frame.columns
        got = out.collect()
        assert sorted(r.doc_id for r in got) == ids and all(tuple(r[2:]) == tail for r in got)


# ---- near


def fingerprint_plainly(text, k=3):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_plainly(rows, radius=3):
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                top[root(i)] = root(j)
    name = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            name[root(i)] = min(doc, name.get(root(i), doc))
    return sorted(((d, name.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_simhash_groups(spark):
    rng = random.Random(2)
    base = [prose(rng, n) for n in (1, 2, 3, 30, 300, 3000)]
    rows = [(i, t) for i, t in enumerate(base * 2)] + [(50, None), (51, ""), (52, " \t\n "), (53, base[5] + " the"), (54, base[5].upper()), (None, base[4]), (53, base[5] + " the")]
    got = simhash.near_groups(docs(spark, rows)).collect()
    marks = [(d, fingerprint_plainly(t)) for d, t in rows]
    assert sorted((r.id, r.fp & (2**64 - 1)) for r in got if r.id is not None) == sorted(m for m in marks if m[0] is not None)
    assert sorted(((r.id, r.component_id) for r in got), key=str) == groups_plainly(marks)
    assert simhash.near_groups(docs(spark, [])).count() == 0
    kept = simhash.near_dedup(docs(spark, rows), seeds=1)
    assert kept.columns == ["doc_id", "text", "salt", "key", "id"]
    assert sorted({r.doc_id for r in kept.collect()}) == sorted({c for _, c in groups_plainly(marks)})


def test_more_seeds_find_more_near_copies(spark):
    rng = random.Random(12)
    base = [" ".join(f"w{rng.randrange(4000)}" for _ in range(400)) for _ in range(60)]
    rows = list(enumerate(base))
    for i, t in enumerate(base):
        w = t.split()
        for k in rng.sample(range(400), 4):
            w[k] = "changed"
        rows.append((100 + i, " ".join(w)))
    left = {n: sorted(r.doc_id for r in simhash.near_dedup(docs(spark, rows), seeds=n).collect()) for n in (1, simhash.SEEDS)}
    assert all(set(range(60)) <= set(v) for v in left.values())  # no two different texts were taken for one
    # 4 of 400 words replaced: 5 bits on average, so one fingerprint finds a quarter and twelve find 97 %
    assert 120 - len(left[simhash.SEEDS]) >= 54 and 120 - len(left[1]) < 30


@pytest.mark.parametrize("how", [{"seeds": 1}, {"shingle": 5, "similarity": 0.8}])
def test_near_dedup_with_shared_and_null_ids(spark, how):
    rng = random.Random(16)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(4000)}" for _ in range(200)) for _ in range(5))
    rows = [(1, a), (None, a.upper()), (None, b), (None, c), (None, c.upper()), (5, d), (7, d.upper()), (7, e), (7, e), (9, b.upper() + "\n")]
    rows += [(11, "one two"), (11, "ONE TWO")]
    got = [(r.doc_id, r.text) for r in simhash.near_dedup(docs(spark, rows), **how).collect()]
    assert sorted(t for i, t in got if i is None) == sorted([c, c.upper()])  # no named row in their group
    assert sorted(x for x in got if x[0] not in (None, 11)) == sorted([(1, a), (5, d), (7, e), (7, e), (9, b.upper() + "\n")])
    assert len([x for x in got if x[0] == 11]) == 1


def five_word_pairs(rng, low, high, count):
    """Pairs of random texts whose five-word similarity, taken plainly, lies in a band; ids i and 1000 + i."""
    sh = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    rows = []
    while len(rows) < 2 * count:
        w = [f"w{rng.randrange(4000)}" for _ in range(300)]
        v = list(w)
        for k in rng.sample(range(300), rng.randrange(1, 16)):
            v[k] = f"x{rng.randrange(4000)}"
        if low <= len(sh(w) & sh(v)) / len(sh(w) | sh(v)) < high:
            i = len(rows) // 2
            rows += [(i, " ".join(w)), (1000 + i, " ".join(v))]
    return rows


@pytest.mark.parametrize(("low", "high"), [(0.8, 0.82), (0.82, 0.86), (0.86, 0.95)])
def test_near_stage_finds_copies_from_the_threshold_on(spark, low, high):
    rows = five_word_pairs(random.Random(13), low, high, 100)
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near(spark, docs(spark, rows), None).collect())
    assert set(range(100)) <= set(kept) and len(kept) <= 102  # 98 % at least


def test_near_stage_keeps_what_is_under_the_threshold(spark):
    rows = five_word_pairs(random.Random(15), 0.68, 0.8, 100)
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near(spark, docs(spark, rows), None).collect())
    assert kept == sorted(i for i, _ in rows)


@pytest.mark.parametrize("shard", [4, 2048])
def test_similar_links_of_large_groups(spark, shard):
    """Copies of one text that share bands, dealt over several parts of a shard, end in one group each."""
    rng = random.Random(14)
    texts = []
    for _ in range(3):
        w = [f"w{rng.randrange(4000)}" for _ in range(300)]
        for _ in range(30):
            v = list(w)
            v[rng.randrange(300)] = "changed"
            texts.append(" ".join(v))
    rows = [(k, t.encode()) for k, t in enumerate(texts)]
    marks = spark.createDataFrame(rows, "node bigint, t binary").select(F.lit(0).alias("id"), "node", "t")
    marks = marks.mapInArrow(simhash._sketches(5), "id int, node bigint, fp bigint, bands array<bigint>, sig binary, n bigint")
    links = simhash.similar_links(marks, spark.createDataFrame(rows, "node bigint, t binary"), 5, 0.8, shard).collect()
    label = list(range(90))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in links:
        label[root(r.a)] = root(r.b)
    assert [len({root(k) for k in range(g, g + 30)}) for g in (0, 30, 60)] == [1, 1, 1] and len({root(k) for k in range(90)}) == 3


@pytest.mark.parametrize("block", [16, 512])
def test_similar_groups_equal_all_pairs(spark, block):
    """Groups around one text at every similarity from 0.3 on: many candidates that are no links. Against all pairs."""
    rng = random.Random(17)
    base = [f"w{rng.randrange(4000)}" for _ in range(250)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(250), rng.randrange(0, 26)):
            w[k] = f"x{rng.randrange(4000)}"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "a b"), (203, "A  b"), (204, base[0])]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for _, t in rows)]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    close = 0
    for i in range(len(rows)):
        for j in range(i):
            share = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            close += 0.66 < share < 0.8
            if share >= 0.8:
                top[root(i)] = root(j)
    want = {}
    for k, (i, _) in enumerate(rows):
        want.setdefault(root(k), set()).add(i)
    got = {}
    for r in simhash.similar_groups(docs(spark, rows), block=block).collect():
        got.setdefault(r.component_id, set()).add(r.id)
    assert close > 300 and len(want) > 10
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(c == min(g) for c, g in got.items())


@pytest.mark.parametrize("shard", [4, 2048])
def test_links_span_all_groups(spark, shard):
    """Dense clusters, chains and strangers; small shards exercise the split of hot ones."""
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for centre in list(fps)[:6]:
        for _ in range(20):
            x = centre
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp bigint"), shard=shard).collect()
    label = {s[0]: s[0] for s in signed}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in links:
        label[root(r.a)] = root(r.b)
    parts = {}
    for s in label:
        parts.setdefault(root(s), []).append(s)
    want = {}
    for d, c in groups_plainly([(i, x) for i, x in enumerate(fps)]):
        want.setdefault(c, []).append(signed[d][0])
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("bits", [0, 1, 9, 16, 17, 28])
def test_every_link_lies_in_a_shard(spark, bits):
    rng = random.Random(21)
    pairs = []
    for _ in range(3000):
        x = y = rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randrange(1, 4)):
            y ^= 1 << b
        pairs.append(tuple(v - (1 << 64) if v >> 63 else v for v in (x, y)))
    both = spark.createDataFrame(pairs, "x bigint, y bigint")
    assert both.where(~F.arrays_overlap(simhash._keys(F.col("x"), bits), simhash._keys(F.col("y"), bits))).count() == 0


def test_links_come_from_searched_trees(spark, monkeypatch):
    """At any number of fingerprints shards are trees of dozens of nodes, of which a search leaves some out."""
    for n in (500, 20_000, 200_000):
        sizes = spark.range(n).select(F.explode(simhash._keys(F.xxhash64("id"), simhash._bits(n))).alias("key")).groupBy("key").count()
        got = sizes.agg(F.avg("count").alias("mean"), F.sum(F.when(F.col("count") > 2, F.col("count"))).alias("trees"), F.sum("count").alias("all")).first()
        assert simhash.FILL / 4 <= got.mean <= 2 * simhash.FILL and got.trees > 0.99 * got.all
    rng, asked, met = random.Random(22), [], []
    within = simhash.BKTree.within

    def counted(tree, x, radius):
        class Counted(list):
            def __getitem__(self, k):
                met.append(k)
                return list.__getitem__(self, k)

        asked.append(len(tree.values))
        plain, tree.edges = tree.edges, Counted(tree.edges)
        try:
            return within(tree, x, radius)
        finally:
            tree.edges = plain

    monkeypatch.setattr(simhash.BKTree, "within", counted)
    fps = [(rng.getrandbits(48), k) for k in range(64)]  # a shard's fingerprints agree in its key
    fps.append((fps[5][0] ^ 0b101, 64))
    assert simhash._forest(fps, fps, 3) == [(64, 5)]
    assert len(asked) == 65 and 0 < len(met) < 0.8 * sum(asked)


def test_large_bands_take_rows_in_proportion(spark):
    """20,000 variants of one page in one band and 60 strangers there: no part meets all others."""
    rng, n, block = random.Random(23), 20_000, 64
    m = simhash.BANDS * simhash.ROWS
    base = bytes(rng.randrange(256) for _ in range(m))

    def variant():
        sig = bytearray(base)
        for k in rng.sample(range(simhash.ROWS, m), 5):
            sig[k] = rng.randrange(256)
        return bytes(sig)

    rows = [(1, k, variant()) for k in range(n)]
    rows += [(1, n + k, base[:6] + bytes(rng.randrange(256) for _ in range(m - 6))) for k in range(60)] + [(2, 1, rows[1][2]), (2, 2, rows[2][2])]
    marks = spark.createDataFrame(rows, "key bigint, node bigint, sig binary").repartition(4)
    offers = simhash._offered(marks.select("key", "node"), marks.select("node", "sig").dropDuplicates(["node"]), 0.8, block)
    assert offers.count() < 1.1 * n
    top = list(range(n + 60))

    def root(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for r in offers.collect():
        top[root(r.a)] = root(r.b)
    assert len({root(k) for k in range(n)}) == 1 and len({root(k) for k in range(n + 60)}) == 61
    named = marks.select("key", "node", F.lit(10).cast("bigint").alias("n"), F.lit(0).alias("band"), F.when(F.col("node") < n, F.lit(0)).otherwise(F.col("node")).cast("bigint").alias("comp"))
    met = simhash._met(named.where("key = 1"), block)
    assert met.count() < 4 * n
    # every pair of texts of different groups meets once: the 60 with each other and with all others
    sides = met.where(f"node >= {n}").groupBy("pair", "side").count().withColumnRenamed("side", "s")
    ours = met.where(f"node < {n}").groupBy("pair", "side").count().withColumnRenamed("count", "many")
    assert sides.join(ours, "pair").where("s <> side").agg(F.sum(F.col("count") * F.col("many"))).first()[0] == 60 * n
    assert met.where(f"node >= {n}").groupBy("pair").agg(F.count_distinct("side").alias("d"), F.count(F.lit(1)).alias("c"), F.max("side").alias("x")).where("c = 60 AND d = 1").count() >= 1


def test_bk_tree():
    rng = random.Random(8)
    values = [rng.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 4096, 37):
        assert sorted(tree.within(q, 2)) == sorted(v for v in set(values) if (v ^ q).bit_count() <= 2)


# ---- substrings


def substrings_plainly(rows):
    seen, out = set(), []
    for _, text in rows:
        b = (text or "").encode()
        off = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                off[p : p + 100] = True
            seen.add(w)
        out.append((len(b), int(off.sum()), int((np.diff(np.r_[0, off.astype(int)]) == 1).sum()), np.frombuffer(b, np.uint8)[~off].tobytes()))
    return out


@pytest.mark.parametrize("hot", [1, 1024])
def test_substrings(spark, hot):
    rng = random.Random(6)
    shared = [prose(rng, 30) for _ in range(4)]
    texts = [prose(rng, 60) + rng.choice(shared) + prose(rng, rng.randrange(40)) for _ in range(30)]
    texts += [texts[3], texts[4][7:], "a" * 99, "a" * 100, "a" * 101, "a" * 3000, "ab" * 700, "The End " * 300, "", None, "é" * 120, texts[5] + texts[5], "b" * 100_000, "b" * 100_000]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = substring_dedup.dedup_substrings(docs(spark, rows), hot=hot).orderBy("id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == substrings_plainly(sorted(rows))


def test_substrings_with_shared_and_null_ids(spark):
    rng = random.Random(7)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(5, a), (5, a), (5, b), (None, a), (9, b)]
    got = substring_dedup.dedup_substrings(docs(spark, rows)).collect()
    removed = {}
    for r in got:
        removed.setdefault(r.id, []).append(r.n_removed > 0)
    assert {k: sorted(v) for k, v in removed.items()} == {5: [False, False, True], None: [True], 9: [True]}
    assert substring_dedup.dedup_substrings(docs(spark, [])).count() == 0


def test_blind_trie():
    rng = random.Random(9)
    words = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(200)] * 2
    trie = substring_dedup.BlindTrie()
    for i, w in enumerate(words):
        trie.add(w, i)
    classes = trie.classes()
    assert [words[c[0]] for c in classes] == sorted(set(words))
    assert all(sorted(c) == [i for i, w in enumerate(words) if w == words[c[0]]] for c in classes)


# ---- decontamination


def test_contamination(spark):
    rng = random.Random(10)
    vocab = [f"w{i}" for i in range(3000)]
    line = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, line(n)) for i, n in enumerate((16, 24, 40, 59, 8, 5, 7, 4))]
    bench = spark.createDataFrame([(i, " ".join(t), 1) for i, t in items] + [(0, " ".join(items[0][1]), 1), (90, None, 1), (91, "", 1)], "item_id bigint, text string, pos int")
    rows, want = [], set()

    def plant(words, item):
        rows.append((len(rows), " ".join([*line(20), *words, *line(20)]).title()))
        if item is not None:
            want.add((len(rows) - 1, item))

    for i, t in items[:7]:
        plant(t, i)
    for _ in range(40):  # three of any 16 words replaced
        t = list(items[1][1])
        for k in (rng.sample(range(16), 3)):
            t[k] = "zzz"
        plant(t, 1)
    plant(items[3][1][10:30], 3)  # part of an item
    plant([w if k % 2 else "zz" for k, w in enumerate(items[2][1])], None)  # every second word replaced
    plant(items[7][1], None)  # items under five tokens match nothing
    plant(items[6][1][:6], None)
    rows += [(900, None), (901, ""), (902, "one two"), (903, " ".join(items[0][1])), (903, " ".join(items[0][1]))]
    want.add((903, 0))
    got = decontaminate.contamination(docs(spark, rows), bench).collect()
    assert {(r.id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {r.overlap for r in got if r.id < 7} == {1.0} and {r.doc_start for r in got if r.id < 7} == {20}
    rest = decontaminate.decontaminate(docs(spark, rows), bench)
    assert rest.columns == ["doc_id", "text", "salt", "key", "id"]
    assert sorted(r.doc_id for r in rest.collect()) == sorted(i for i, _ in rows if i not in {w[0] for w in want})
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0
    assert decontaminate.contamination(docs(spark, rows), bench.limit(0)).count() == 0


def test_items_of_8_to_16_tokens_match_by_the_rule(spark):
    """Every choice of the replaced tokens that leaves 80 % of the item, against the rule and not the seeds."""
    items = [(n, [f"i{n}w{k}" for k in range(n)]) for n in range(8, 17)]
    bench = spark.createDataFrame([(n, " ".join(t)) for n, t in items], "item_id bigint, text string")
    rows, want = [], set()
    for n, t in items:
        most = n - -(-n * 4 // 5)
        for size in (most, most + 1):
            for off in itertools.combinations(range(n), size):
                if size == most:
                    want.add((len(rows), n))
                elif len(off) > 2 and off[0]:
                    continue
                rows.append((len(rows), " ".join(["a", "b", *("zz" if k in off else w for k, w in enumerate(t)), "c"])))
    got = decontaminate.contamination(docs(spark, rows), bench).select("id", "item_id").collect()
    assert {(r.id, r.item_id) for r in got} == want and len(got) == len(want)


def test_blocks_of_the_benchmark(spark, monkeypatch):
    rng = random.Random(11)
    items = [(i, " ".join(f"v{rng.randrange(500)}" for _ in range(20))) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    texts = docs(spark, [(i, "a b c " + t) for i, t in items])
    monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", 300)
    got = decontaminate.contamination(texts, bench).select("id", "item_id").collect()
    assert sorted((r.id, r.item_id) for r in got) == [(i, i) for i in range(12)]


def test_many_seeds_find_what_few_find(spark, monkeypatch):
    """More seeds than are broadcast: the same rows, for partial items, long texts, null and shared identifiers, repeats and hot seeds."""
    rng = random.Random(12)
    line = lambda n: [f"v{rng.randrange(400)}" for _ in range(n)]
    items = [(i, line(n)) for i, n in enumerate((5, 6, 8, 10, 11, 16, 20, 60, 300, 700))]
    items += [(20 + i, [*items[6][1][:12], *line(8)]) for i in range(5)]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id bigint, text string")
    rows = [(1, None), (2, ""), (None, " ".join(items[5][1])), (None, "other " + " ".join(items[7][1])), (3, " ".join(line(3000)))]
    for k, (_, t) in enumerate(items):
        words = [w if rng.random() > 0.08 else "zz" for w in t]
        rows.append((10 + k, " ".join([*line(rng.randrange(600)), *words, *line(rng.randrange(600))])))
        rows.append((7, " ".join([*words, *line(5)])))
    rows += [(40, " ".join([*line(1500), *items[9][1], *line(500), *items[8][1][20:]]))] * 2
    rows += [(100 + i, " ".join([*items[6][1][:14], *line(30)])) for i in range(300)]
    texts = docs(spark, rows).repartition(3)
    want = decontaminate.contamination(texts, bench).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", 50)
    assert len(want) > 20 and sorted(map(repr, decontaminate.contamination(texts, bench).collect())) == sorted(map(repr, want))
    monkeypatch.setattr(decontaminate, "BITS", 1 << 18)  # nearly full tables let more through and lose nothing
    assert sorted(map(repr, decontaminate.contamination(texts, bench).collect())) == sorted(map(repr, want))
    assert decontaminate.contamination(texts.limit(0), bench).count() == 0


def test_segments_find_what_whole_items_find(spark, monkeypatch):
    """Long items cut into segments: the same rows as without, both ways, whatever part of an item a text holds."""
    rng = random.Random(24)
    line = lambda n: [f"v{rng.randrange(900)}" for _ in range(n)]
    items = [(i, line(n)) for i, n in enumerate((6, 9, 16, 33, 64, 65, 80, 400, 1500))]
    items.append((20, [*items[8][1][:700], *line(300)]))
    items.append((21, items[7][1]))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id bigint, text string")
    rows = [(1, None), (None, " ".join(items[8][1])), (None, " ".join(line(40))), (2, " ".join(line(4000)))]
    for i, t in items:
        words = [w if rng.random() > 0.1 else "zz" for w in t]
        rows.append((10 + i, " ".join([*line(rng.randrange(900)), *words, *line(rng.randrange(900))])))
        at = rng.randrange(max(1, len(t) - 15))
        rows.append((50, " ".join([*line(30), *t[at : at + 16], *line(600)])))  # one window, anywhere
        rows.append((60, " ".join([*t[-40:], *line(3)])))  # begins before the text
        rows.append((70, " ".join([*line(5), *t[: len(t) // 2], "x", *t[len(t) // 2 :]] * 2)))  # several alignments
    texts = docs(spark, rows + rows[-5:]).repartition(3)
    monkeypatch.setattr(decontaminate, "SEGMENT", 1 << 20)
    want = sorted(map(repr, decontaminate.contamination(texts, bench).collect()))
    assert len(want) > 30
    for segment, seeds in ((64, decontaminate.BLOCK_SEEDS), (64, 50), (512, decontaminate.BLOCK_SEEDS)):
        monkeypatch.setattr(decontaminate, "SEGMENT", segment)
        monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", seeds)
        assert sorted(map(repr, decontaminate.contamination(texts, bench).collect())) == want
    assert decontaminate._segments(spark.createDataFrame([(1, [*range(2000)], 2000, 5)], "item_id int, ith array<int>, il int, key bigint")).agg(F.max("il")).first()[0] == 512


def test_membership_holds_every_hash(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BITS", 1 << 18)
    for n in (0, 1, 5000, 200000):
        hashes = spark.range(n).selectExpr("xxhash64(id) as h")
        hit = decontaminate._membership(hashes, n)
        assert hashes.where(hit(hashes["h"])).count() == n
        others = spark.range(1 << 40, (1 << 40) + 20000).selectExpr("xxhash64(id) as h")
        assert others.where(hit(others["h"])).count() <= (20000 if n > 5000 else 200)
