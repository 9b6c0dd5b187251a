"""Pages of usual layouts with compound names, link cards and hostile markup; phone numbers in many spellings."""

import time

import pytest

from draftwell.llm import html_text, pseudonyms

NAMES = (
    "ad-slot ad-container cookie-banner site-footer left-sidebar comment-list newsletter-signup share-buttons related-posts main-nav promo-box adsbygoogle top-banner footer-links "
    "nav-wrapper ad_unit comments-section sidebar-right popup-inner sponsored-content social-bar"
).split()
PROSE = " ".join(f"prose{i}" for i in range(90))
OTHER = " ".join(f"other{i}" for i in range(26))


text_of = html_text.main_text


@pytest.mark.parametrize("name", NAMES)
def test_compound_names(name):
    box = f'<div class="{name}"><p>{OTHER}</p></div>'
    for page in (
        f"<article><h1>Head line here</h1><p>{PROSE}</p>{box}<p>{PROSE}</p></article>",
        f"<div><h1>Head line here</h1><p>{PROSE}</p></div>{box}",
        f"{box}<div><p>{PROSE}</p><p>{PROSE}</p></div>",
    ):
        got = text_of(page)
        assert "other3" not in got and "prose89" in got, page[:60]


@pytest.mark.parametrize("name", ["with-footer", "has-ads", "the-comment-that-changed", "menu-of-the-day"])
def test_prose_in_badly_named_wrappers(name):
    assert "prose89" in text_of(f'<div class="{name}"><h1>Head line here</h1><p>{PROSE}</p><p>{PROSE}</p></div><footer>{OTHER}</footer>')


def test_link_cards_are_linked():
    cards = "".join(f'<a href="/{i}"><div>Menu entry {i}</div></a>' for i in range(6))
    got = text_of(f"{cards}<div><h1>Head line here</h1><p>{PROSE}</p><p>{PROSE}</p></div>")
    assert "entry" not in got and "prose0" in got
    # a link that is never closed ends with what it began in
    assert [b.linked for b in html_text.blocks("<p><a>one two<p>three four</p><div>five</div>")] == [2, 0, 0]


@pytest.mark.parametrize("page", ["<div>" * 90_000 + "</section>" * 60_000, '<div class="ad">' * 60_000 + "x", "<p><a>" * 150_000, "<" * 1_000_000, "<b class=ad>" * 80_000])
def test_hostile_pages_take_time_in_proportion(page):
    began = time.process_time()
    text_of(page)
    assert time.process_time() - began < 12


NUMBERS = [
    ("7", "4951234567"), ("7", "8123456789"), ("1", "2125550123"), ("44", "2079460958"), ("49", "3012345678"), ("33", "612345678"), ("353", "12345678"), ("351", "211234567"), ("420", "212345678"),
    ("39", "0612345678"), ("34", "912345678"), ("852", "21234567"), ("91", "1123456789"), ("81", "312345678"), ("61", "212345678"), ("27", "211234567"), ("380", "441234567"), ("48", "221234567"),
]


def spellings(code, n):
    yield f"+{code}{n}"
    yield f"+{code} {n[:2]} {n[2:5]} {n[5:]}"
    yield f"+{code}-{n[:3]}-{n[3:6]}-{n[6:]}"
    yield f"+{code} {n[0]} {n[1:4]} {n[4:8]}" if len(n) == 8 else f"+{code} ({n[:3]}) {n[3:6]} {n[6:]}"
    if len(n) == 9:
        yield f"+{code} {n[0]} {n[1:3]} {n[3:5]} {n[5:7]} {n[7:]}"


def test_phones_are_linked_across_spellings(spark):
    rows = [(i, f"call {s}, please") for i, (code, n) in enumerate(NUMBERS) for s in spellings(code, n)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = pseudonyms.pseudonymise(frame).collect()
    seen = {}
    for r in got:
        assert len(r.found) == 1 and r.found[0].kind == "phone", r
        digits = "".join(c for c in r.found[0].pseudonym if c.isdigit())
        code, n = NUMBERS[r.id]
        assert digits.startswith(code) and len(digits) == len(code + n)
        seen.setdefault(r.id, set()).add(digits)
    assert all(len(x) == 1 for x in seen.values()) and len({min(x) for x in seen.values()}) == len(NUMBERS)
    back = pseudonyms.pseudonymise(spark.createDataFrame([(r.id, r.text) for r in got], "doc_id bigint, text string"), backwards=True).collect()
    assert sorted((r.id, r.text) for r in back) == sorted(rows)
    trunk = pseudonyms.pseudonymise(spark.createDataFrame([(1, "+44 (0)20 7946 0958"), (2, "+442079460958")], "doc_id bigint, text string")).collect()
    assert trunk[0].text.replace(" ", "").replace("(0)", "") == trunk[1].text
