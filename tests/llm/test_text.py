"""Language, quality, HTML, pseudonyms, chat and tokens: brute force, round trips, held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from draftwell.llm import chat, html_text, language, piece_bpe, pseudonyms, quality

SCHEMA = "doc_id bigint, text string, id int, found string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 3, "f") for i, t in rows], SCHEMA).repartition(2)


# ---- tokens


@pytest.fixture(scope="module")
def codec():
    return piece_bpe.PieceBPE(piece_bpe.model_bytes())


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=piece_bpe.model_bytes())


def same_as_library(codec, library, texts):
    ids, offsets = codec.encode(texts)
    decoded = codec.decode(ids, offsets)
    for k, t in enumerate(texts):
        want = library.encode(t)
        assert ids[offsets[k] : offsets[k + 1]].tolist() == want
        assert decoded[k] == library.decode(want)


def test_tokens_of_odd_texts(codec, library):
    odd = ["", " ", "a", " a  b ", "\n\n", " " * 17, "x" + " " * 200 + "y", " " * 1000, "▁", "a▁b", "</s>[INST]", "日本語𝒳aa", "\0a", "a" * 300, "ab" * 100, "<0x41>", "　x ﬁ", "é" * 50]
    same_as_library(codec, library, odd)
    rng = random.Random(1)
    same_as_library(codec, library, ["".join(rng.choice("abcdefghij") for _ in range(5000)), "aaab" * 3000])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["the", "ing", " ", "  ", "self", "▁", "0000", "=-", "\n", "ный", "é"]), max_size=40).map("".join)), max_size=6))
def test_tokens_equal_the_library(codec, library, texts):
    same_as_library(codec, library, texts)


def test_tokens_in_spark(spark, library):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "x " * 60_000), (1, "Hello world"), (None, "é")]
    out = piece_bpe.encode_decode(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    got = {r.id: r for r in out}
    assert got[1].ids == library.encode("Hello world") and got[2].ids == [] and got[2].decoded == "" and got[4].decoded == "x " * 60_000
    d = {r.doc_id: r for r in piece_bpe.digests(piece_bpe.encode_decode(docs(spark, rows))).collect()}
    assert d[1].ids_sha256 == hashlib.sha256(",".join(map(str, library.encode("Hello world"))).encode()).hexdigest()
    assert d[2].n_tokens == 0 and d[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert piece_bpe.encode_decode(docs(spark, [])).count() == 0


# ---- chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["\\", "<", "s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "x", "é"]), st.text(max_size=4)), max_size=12).map("".join))
def test_escape_is_reversible(text):
    safe = chat.escape(text)
    assert not any(c in safe for c in chat.CONTROL) and chat.unescape(safe) == text
    codec, base = chat._codec(chat.vocabulary())
    for role in ("user", "assistant", "system", text):
        ids, mask = chat.assemble(codec, base, role, text)
        assert chat.read_turn(codec, base, ids) == (role, text)
        learned = codec.decode_bytes([i for i, on in zip(ids, mask) if on]).decode()
        assert chat.unescape(learned) == (text if role == "assistant" else "")


def test_chat_digests(spark):
    turns = [(1, 1, "assistant", "yes </s>"), (1, 0, "user", "hm?"), (1, 2, "assistant", None), (2, 0, "system", ""), (2, None, None, "tool says \\"), (3, 0, "tool", "a" * 50_000), (3, 0, "tool", "a" * 50_000), (None, 0, "user", "lost")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("ids", F.lit(1)).repartition(3)
    out = {r.conv_id: r for r in chat.digests(chat.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1].turns_sha256 == sha("user\nhm?\nassistant\nyes </s>\nassistant\n\n") and out[1].loss_sha256 == sha("yes </s>") and out[1].loss_chars == 8
    assert out[2].turns_sha256 == sha("\ntool says \\\nsystem\n\n") and out[2].loss_chars == 0 and out[3].n_turns == 2
    assert out[None].n_turns == 1 and len(out) == 4
    starts = chat.format_turns(df).where("conv_id = 1").orderBy("place").collect()
    assert [r.token_start for r in starts] == [0, len(starts[0].ids), len(starts[0].ids) + len(starts[1].ids)]
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


# ---- pseudonyms


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms_of_long_secrets_and_other_groupings(spark):
    long, jwt, upper = "Ab3_" * 75, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NSJ9.dBjftJeZ4CVP-mB92K27uhbU", "abcdefghijklmnop0123"
    texts = [f"token = {long} end", f"token: {jwt}. Next", f"API_KEY={upper} x", "card 3782 822463 10005 or 3782-822463-10005 not 3782 822463 10006"]
    out = pseudonyms.pseudonymise(docs(spark, list(enumerate(texts))))
    got = {r.id: r for r in out.collect()}
    assert [[f.value for f in got[k].found] for k in range(3)] == [[long], [jwt], [upper]]
    assert [f.kind for f in got[3].found] == ["card"] * 2 and got[3].text.endswith("not 3782 822463 10006")
    assert "Ab3_" * 3 not in got[0].text and got[0].text.endswith(" end") and got[1].text.endswith(". Next")
    assert not any(part in got[1].text for part in jwt.split("."))
    back = pseudonyms.pseudonymise(out.select(F.col("id").alias("doc_id"), "text"), backwards=True).collect()
    assert {r.id: r.text for r in back} == dict(enumerate(texts))


def test_pseudonyms_round_trip_and_format(spark):
    texts = [
        "call +1 (499) 555-6503 or 55.148.143.52 now", "card 4845168114407329 vs 9807915762804490 and 4845-1681-1440-7329", "x und.34@mail7.example.com, y",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', "Version 2.0. 999.1.1.1 256.1.1.1", "1984-02-29 29.02.1984 02/29/1984 1999-12-31 31.12.1999 2001-13-01 1899-01-01",
        "GB82WEST12345698765432 GB83WEST12345698765432 DE89 3704 0044 0532 0130 00", "ssn 123-45-6789 000-12-3456 666-12-3456 123-00-4567", None, "", "4845168114407329$$$ 4845168114407329", "plain " * 30_000,
    ]
    df = docs(spark, list(enumerate(texts)) + [(0, texts[0])])
    out = pseudonyms.pseudonymise(df)
    rows = out.collect()
    got = {r.id: r for r in rows}
    assert len(rows) == len(texts) + 1 and got[8].text is None and got[9].text == "" and got[8].found == []
    assert got[11].text == texts[11] and got[4].text == texts[4]
    back = pseudonyms.pseudonymise(out.select(F.col("id").alias("doc_id"), "text"), backwards=True).collect()
    assert all(r.text == texts[r.id] for r in back)
    for r in rows:
        for f in r.found:
            assert re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", f.value))) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", f.pseudonym))) or f.kind in ("ip", "secret")
    cards = [f for f in got[1].found if f.kind == "card"]
    assert len(cards) == 2 and cards[0].pseudonym == cards[1].pseudonym.replace("-", "") and luhn(cards[0].pseudonym) and "9807915762804490" in got[1].text
    assert [f.pseudonym for f in got[10].found] == [cards[0].pseudonym] * 2  # linked across documents
    assert [f.kind for f in got[5].found] == ["date"] * 5 and got[5].text.endswith("2001-13-01 1899-01-01")
    assert [f.kind for f in got[6].found] == ["iban", "iban"] and "GB83WEST12345698765432" in got[6].text
    for f in got[6].found:
        t = f.pseudonym.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1
    assert [f.kind for f in got[7].found] == ["ssn"] and got[0].found[0].kind == "phone" and got[0].found[1].kind == "ip"
    assert pseudonyms.pseudonymise(df.limit(0)).count() == 0


def test_feistel_is_a_permutation(spark):
    space = spark.range(7 * 10 * 3).select(F.array(F.col("id") % 7, F.floor(F.col("id") / 7) % 10, F.floor(F.col("id") / 70)).alias("v"))
    out = space.select("v", pseudonyms.feistel(F.col("v"), F.array(F.lit(7), F.lit(10), F.lit(3)), "t", "k").alias("w"))
    rows = out.select("v", "w", pseudonyms.feistel(F.col("w"), F.array(F.lit(7), F.lit(10), F.lit(3)), "t", "k", True).alias("x")).collect()
    assert len({tuple(r.w) for r in rows}) == 210 and all(r.v == r.x for r in rows) and sum(r.v == r.w for r in rows) < 10
    assert all(0 <= a < b for r in rows for a, b in zip(r.w, (7, 10, 3)))


# ---- html


def test_main_text_of_layouts():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body><header><a href="/">Home</a> My site</header>
    <nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><div class="cookie-notice">We use cookies on this site for many good reasons indeed.</div>
    <article><h1>Big &amp; bold&nbsp;title</h1><p>First <b>par</b>a&#x67;raph
      goes <a href=x>here</a>.<br>Same block.<aside>Read also: other stories from here</aside><p>Second &lt;tag&gt; <span class="ad">buy now</span>text.<ul><li>item</ul>
    <form><p>Mail me news</p><input></form><section class="comments"><p>I disagree with all of this, said a reader.</p></section></article>
    <aside><p>Something long that stands in the side bar of the page for readers.</p></aside><footer>&copy; me</footer></body></html>"""
    text = html_text.main_text(page)
    assert text.split("\n") == ["Big & bold title", "First paragraph goes here. Same block.", "Second <tag>", "text.", "item"]
    plain = '<body><div id="menu"><a href=1>a</a> <a href=2>b</a></div><div><h1>Head of it</h1><p>Prose that has no article around it but is long enough to be told.</p><p>Short one.</p></div><div class="sidebar">Side text</div>'
    assert html_text.main_text(plain).split("\n") == ["Head of it", "Prose that has no article around it but is long enough to be told.", "Short one."]
    for odd in (None, "", "<", "<p", "a < b", "<a href='", "<!-- x", "<script>", "&am", "<div>" * 3000, '<a "' * 3000):
        assert isinstance(html_text.main_text(odd), str)
    assert html_text.main_text("<article><p>cut &am") == "cut &am"


def test_extract_rows(spark):
    rows = [(1, "u", "<article><p>é x</p></article>"), (2, None, None), (3, "w", ""), (1, "u", "<article><p>é x</p></article>"), (4, "v", "<article>" + "<p>w w w</p>" * 20_000)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert sorted((r.page_id, r.n_chars) for r in out) == [(1, 3), (1, 3), (2, 0), (3, 0), (4, 20_000 * 6 - 1)]


def test_tree_fits_its_table():
    assert all(html_text.is_content(r[:-1]) == bool(r[-1]) for r in html_text._labelled())


def test_text_evidence_overrules_names_and_tags():
    prose = lambda n: " ".join(f"w{k}" for k in range(n))
    for name in ("has-sidebar", "post-share", "widget-area", "entry-alert", "page-header-fixed"):
        assert html_text.main_text(f'<div class="{name}"><p>{prose(30)}</p><p>{prose(40)}</p></div>').split("\n") == [prose(30), prose(40)]
    inside = f'<article><p>{prose(50)}</p><div class="notice-of-motion"><p>{prose(42)}</p></div><div class="notice">{prose(42)}</div><p>{prose(20)}</p></article>'
    assert html_text.main_text(inside).split("\n") == [prose(50), prose(42), prose(20)]
    # teasers in article tags beside prose that stands outside them: the tag rule would take the teasers
    teasers = f"<div><p>{prose(90)}</p><p>{prose(80)}</p></div><article><h3><a href=x>{prose(5)}</a></h3></article><article><h3><a href=y>{prose(6)}</a></h3></article>"
    assert html_text.main_text(teasers).split("\n") == [prose(90), prose(80)]
    used = set()

    def walk(tree):
        if not isinstance(tree, int):
            used.add(html_text.FEATURES[tree[0]])
            walk(tree[2])
            walk(tree[3])

    walk(html_text.decision_tree())
    assert used & {"words", "box_words", "words_before", "words_after"} and used & {"links", "box_links"} and used & {"links_before", "links_after", "links_both", "links_either"}


def test_paragraphs_beside_links_stay():
    page = "<article><h1>Head of it all</h1><p>First words of the text.</p><p>LAST words of the text.</p></article><nav><a>Home</a> <a>About</a></nav>"
    assert html_text.main_text(page).split("\n") == ["Head of it all", "First words of the text.", "LAST words of the text."]
    page = "<article><p>Words before the link stay here.</p><p><a href=x>one link</a></p><p>Words after it stay, too.</p></article>"
    assert html_text.main_text(page).split("\n") == ["Words before the link stay here.", "one link", "Words after it stay, too."]
    for tag in ("title", "object", "svg", "iframe"):
        assert html_text.main_text(f"<{tag}><p>The rest of the page is all here and can be read.").endswith("can be read.")


def test_pages_equal_a_plain_reading(spark):
    """Every page of the tables, against a reading of their one layout with regular expressions."""
    import html
    import re

    def plain(page):
        body = re.search(r"<article>(.*)</article>", page or "", re.S)
        parts = re.split(r"</?(?:p|h1)[^>]*>", body[1]) if body else []
        return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", part)).split()) for part in parts) if x)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in html_text.query(spark, "/root/testdata/sf0.01").collect()}
    assert got == want
    assert html_text.extract(pages.limit(0)).count() == 0


# ---- language


def test_languages(spark):
    rng = random.Random(3)
    parts = {"en": ["th", "ing", "er", "ou", "st"], "de": ["sch", "ung", "ä", "ie", "tz"], "fr": ["eau", "é", "tion", "ç", "oi"]}
    make = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, make(lang, 60), lang) for i, lang in enumerate(["en", "de", "fr"] * 30)] + [(200, "x y z", None), (201, None, "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = language.prototypes(df)
    assert sorted(learned) == ["de", "en", "fr"]
    tests = [(i, make(lang, 30)) for i, lang in enumerate(["en", "de", "fr"] * 20)] + [(100, None), (101, ""), (102, "123 !!"), (103, make("de", 20_000)), (0, "ÉCLAIR eau")]
    out = language.identify(docs(spark, tests), learned).collect()
    assert len(out) == len(tests) and all(0 <= r.score <= 1 for r in out)
    got = {}
    for r in out:
        got.setdefault(r.id, []).append(r.lang_pred)
    assert sum(got[i][-1] == ["en", "de", "fr"][i % 3] for i in range(1, 60)) == 59
    assert got[100] == got[101] == got[102] == ["und"] and got[103] == ["de"]
    assert {r.lang_pred for r in language.identify(docs(spark, tests), {}).collect()} == {"und"}
    assert language.prototypes(df.limit(0)) == {} and language.identify(docs(spark, []), learned).count() == 0


def test_bundles_are_sums_of_bound_vectors():
    v = language.Vectors(64, 5)
    codes, counts = language.sequences("Ab a?b")
    a, b, blank = v._letter(97).astype(int), v._letter(98).astype(int), v._letter(32).astype(int)
    bind = lambda x, y, z: np.roll(x, 2) * np.roll(y, 1) * z
    want = bind(blank, a, b) + bind(a, b, blank) + bind(b, blank, a) + bind(blank, a, blank) + bind(a, blank, b) + bind(blank, b, blank)
    assert (v.bundles([(codes, counts)])[0] == want).all()


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    got = language.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    row = got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert row[1] > 20 and row[0] > 0.95


# ---- quality


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    f = quality.Field(rng.normal(size=quality.WIDTH), rng.normal(size=(2, 2)), 0.5)
    x = rng.normal(size=(5, quality.WIDTH)) * 0.3
    total, one = 0.0, np.zeros(5)
    for y in itertools.product((0, 1), repeat=5):
        p = np.exp(sum(y[t] * (x[t] @ f.weights) for t in range(5)) + sum(f.pairs[a, b] for a, b in zip(y, y[1:])))
        total += p
        one += p * np.array(y)
    assert np.allclose(f.marginals(x), one / total)


def test_gradient_and_fit():
    good, bad = b"A plain line of words that differ.\nAnother line, with other words.", b"AAA!! BBB!! AAA!! BBB!!\nword word word word word"
    f = quality.train([(quality.line_features(good)[0], 1), (quality.line_features(bad)[0], 0)] * 5)
    assert f.quality(good) > 0.9 and f.quality(bad) < 0.1 and f.quality(b"") == f.quality(None) == f.quality(b" \n ") == 0.5
    assert quality.train([]).quality(good) == 0.5
    assert f.quality(good.split(b"\n")[0]) == pytest.approx(f.marginals(quality.line_features(good.split(b"\n")[0])[0])[0])


def test_training_takes_bounded_parts_of_long_texts():
    x = np.arange(1000 * 3, dtype=np.float32).reshape(1000, 3)
    assert [p.tobytes() for p in quality.excerpts(x[:512], 512)] == [x[:512].tobytes()] and len(quality.excerpts(x[:0], 512)) == 1
    parts = quality.excerpts(x, 512)
    assert len(parts) == 8 and all(len(p) <= quality.SEGMENT for p in parts)
    starts = sorted(int(p[0, 0]) // 3 for p in parts)
    assert all(s % 64 == 0 for s in starts) and starts != list(range(0, 512, 64))  # whole segments, not the head of the text
    assert len(quality.excerpts(x, 10)) == 1 and len(quality.excerpts(x, 10)[0]) == 10


def test_training_survives_long_texts_and_repeated_identifiers(spark):
    good = "The river runs past the old mill and the town behind it.\n" * 3000
    bad = "$$ %% 1234 !!\n" * 3000
    rows = [(i, good if i % 2 else bad) for i in range(2, 40) for _ in range(3)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2, 40)], "doc_id bigint, quality int")
    whole, few = quality.fit(frame, labels), quality.fit(frame, labels, sample=20, lines=64)
    for field in (whole, few):
        assert field.quality(good.encode()) > 0.9 and field.quality(bad.encode()) < 0.1
    assert whole.prior == pytest.approx(np.mean([i % 2 for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]))


def test_quality_held_out_and_edges(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.query(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    field = quality.train([])
    rows = [(1, None), (2, ""), (3, "x" * 100_000), (3, "x" * 100_000), (None, "a")]
    assert [r.score for r in quality.score(docs(spark, rows), field).collect()] == [0.5] * 5
    kept = quality.keep_good(docs(spark, rows), field)
    assert kept.count() == 5 and kept.columns == ["doc_id", "text", "id", "found"]
    assert quality.fit(docs(spark, []), labels).prior == 0.5 and quality.score(docs(spark, []), field).count() == 0


# ---- whole queries against plain versions

SF = "/root/testdata/sf0.001"


def test_languages_equal_a_plain_version(spark):
    """Prototypes and predictions of the query, by sums of vectors over sequences one by one."""
    import zlib
    from collections import Counter

    import numpy as np

    docs_ = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()

    def grams(text):
        spaced = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
        words = " ".join(spaced.split())
        line = f" {words} "
        return Counter(line[k : k + 3] for k in range(len(line) - 2)) if words else Counter()

    letter, bound = {}, {}

    def vector(gram):
        if gram not in bound:
            for c in gram:
                cp = 32 if c == " " else ord(c)
                if c not in letter:
                    letter[c] = np.random.default_rng((language.SEED, cp)).integers(0, 2, language.DIM) * 2 - 1
            a, b, c = (letter[c] for c in gram)
            bound[gram] = np.roll(a, 2) * np.roll(b, 1) * c
        return bound[gram]

    def bundle(counts):
        return sum((n * vector(g) for g, n in counts.items()), np.zeros(language.DIM, np.int64))

    out_of = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    total = {}
    for r in docs_:
        if r.lang is not None and r.text is not None and not out_of(r.doc_id):
            total.setdefault(r.lang, Counter()).update(grams(r.text))
    protos = {k: bundle(c) for k, c in sorted(total.items())}
    protos = {k: v / np.linalg.norm(v) for k, v in protos.items()}
    got = {r.doc_id: r for r in language.query(spark, SF).collect()}
    assert len(got) == len(docs_)
    for r in docs_:
        v = bundle(grams(r.text))
        norm = np.linalg.norm(v)
        scores = {k: float(p @ v / norm) for k, p in protos.items()} if norm else {}
        best = max(scores, key=scores.get) if scores else language.UND
        assert got[r.doc_id].lang_pred == best and got[r.doc_id].held_out == out_of(r.doc_id)
        assert abs(got[r.doc_id].score - max(0.0, scores.get(best, 0.0))) < 1e-6


def plain_feistel(values, bases, kind, key):
    """The network digit by digit, with one hash at a time."""
    state = list(values)
    for r in range(pseudonyms.ROUNDS):
        other = ",".join(str(x) for i, x in enumerate(state) if (i + r) % 2 == 1)
        first = hashlib.sha512("|".join([key, kind, str(r), str(len(state)), other]).encode()).hexdigest()
        for i in range(len(state)):
            if (i + r) % 2 == 0:
                block, at = divmod(i // 2, 18)
                draw = first if block == 0 else hashlib.sha512(f"{first}|{block}".encode()).hexdigest()
                state[i] = (state[i] + int(draw[at * 7 : at * 7 + 7], 16)) % bases[i]
    return state


def test_pseudonyms_equal_a_plain_network(spark):
    rng = random.Random(21)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (16, 40, 41, 128, 300)]
    cards = ["4111111111111111", "378282246310005"]
    rows = [(i, f"token = {h} end") for i, h in enumerate(hexes)] + [(50 + i, f"pay {c} now") for i, c in enumerate(cards)]
    got = {r.id: r for r in pseudonyms.pseudonymise(docs(spark, rows)).collect()}
    for i, h in enumerate(hexes):
        want = "".join(f"{v:x}" for v in plain_feistel([int(c, 16) for c in h], [16] * len(h), "hex", pseudonyms.KEY))
        assert got[i].text == f"token = {want} end"
    for i, c in enumerate(cards):
        body = plain_feistel([int(x) for x in c[:-1]], [10] * (len(c) - 1), "card", pseudonyms.KEY)
        made = got[50 + i].found[0].pseudonym
        assert made[:-1] == "".join(map(str, body)) and luhn(made)


def test_pseudonyms_of_every_document(spark):
    """The secrets of the table, which are 40 hexadecimal digits, and nothing but found values changes."""
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in pseudonyms.query(spark, SF).select("doc_id", "text", "n_replaced").collect():
        text = source[r.doc_id]
        if not r.n_replaced:
            assert r.text == text
            continue
        assert len(r.text) == len(text) or r.n_replaced
        for m in re.finditer(r"(?<![0-9A-Za-z_-])(?:token|secret|password|api_key|apikey) ?[=:] ?[\"']?([0-9a-f]{40})(?![0-9A-Za-z_.-])", text, re.I):
            want = "".join(f"{v:x}" for v in plain_feistel([int(c, 16) for c in m[1]], [16] * 40, "hex", pseudonyms.KEY))
            assert want in r.text and m[1] not in r.text
