"""HTML extraction on classes of ordinary pages, and on pages of eight scripts with known text."""

import collections
import itertools
import random

import pytest
from test_html_pages import wrap

from helioflux.llm.html_extract import extract

S = "River stone paper, window garden. Letter market winter!"


def p(n):
    return "<p>" + " ".join([S] * n) + "</p>"


def t(n):
    return " ".join([S] * n)


HINDI = "यह एक लंबा वाक्य है जो लेख में है। दूसरा वाक्य यहाँ है।"
LINKS = "<nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>"
CASES = {
    "no marks": ("<article><h1>Title</h1><p>Some plain text without marks at all</p></article>", "Title Some plain text without marks at all"),
    "one line": ("<p>Hello world</p>", "Hello world"),
    "danda": (f"<article><h1>शीर्षक</h1><p>{HINDI}</p></article>", f"शीर्षक {HINDI}"),
    "linked paragraphs": (
        "<div><p><a href=1>A very long link text that fills this paragraph with a link</a></p><p>Short plain text here.</p><p><a href=2>Another very long link text that fills this one too</a></p></div>",
        "A very long link text that fills this paragraph with a link Short plain text here. Another very long link text that fills this one too",
    ),
    "page in a form": (f"<body><form action='x'><input type=hidden name=v><div id=c><h1>T</h1>{p(3)}{p(2)}</div><input type=submit></form></body>", f"T {t(3)} {t(2)}"),
    "page in a form, no heading": (f"<form action='x'><input type=hidden name=v><input type=text>{p(9)}{p(5)}</form>", f"{t(9)} {t(5)}"),
    "a form beside the text": (f"<form><label>Mail</label><input><p>Sign up, it is free.</p><button>Go</button></form><div>{p(2)}</div>", t(2)),
    "doubtful names around the article": (f"<div class='social-post discussion'><h1>T</h1>{p(4)}{p(3)}</div><div class='other'><p>Buy one, get one.</p></div>", f"T {t(4)} {t(3)}"),
    "the same without a heading": (f"<div class='social-post discussion'>{p(4)}{p(3)}</div><div class='other'><p>Buy one, get one.</p></div>", f"{t(4)} {t(3)}"),
    "doubtful names in the article": (f"<main>{p(1)}<div class='search-results'>{p(1)}{p(2)}{p(1)}</div></main>", f"{t(1)} {t(1)} {t(2)} {t(1)}"),
    "notes by another name": (f"<article><h1>T</h1>{p(1)}</article><div class='reactions'>" + p(2) * 30 + "</div>", f"T {t(1)}"),
    "notes without a heading": (f"<article>{p(1)}</article><div class='reader-notes'>" + p(2) * 30 + "</div>", t(1)),
    "notes without an article": (f"<div id=story><h1>T</h1>{p(1)}</div><div class='reader-notes'>" + f"<div class=n><b>Ann</b>{p(2)}</div>" * 30 + "</div>", f"T {t(1)}"),
    "notes as articles": (f"<main><article><h1>T</h1>{p(1)}</article><section class='comments'>" + f"<article class=comment>{p(2)}</article>" * 30 + "</section></main>", f"T {t(1)}"),
    "sections are no notes": ("<h1>T</h1><div class=content>" + "".join(f"<section><h2>{x}</h2>{p(1)}</section>" for x in "abc") + "</div>", f"T a {t(1)} b {t(1)} c {t(1)}"),
    "furniture alone": (f"{LINKS}<footer>2020</footer>", ""),
    "a long notice": (f"<div class=cookie-notice>{p(4)}</div><article><h1>T</h1><p>One two three</p></article>", "T One two three"),
    "a linked title": (f"<div class='header'><div class='logo'>Site</div></div><div class='main'><h1><a href=1>T x</a></h1>{p(1)}<ul><li><a href=1>r1</a></li><li><a href=2>r2</a></li></ul></div>", f"T x {t(1)}"),
    "null": (None, ""),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    html, want = CASES[name]
    assert extract(html) == want


#: Letters and sentence marks of eight scripts.
SCRIPTS = {
    "Latin": ("abdeilmnorstu", "."), "Cyrillic": ("абвгдежзиклмн", "."), "Devanagari": ("कगचजतदनपबमरल", "।"), "Armenian": ("աբգդեզիլխմնս", "։"),
    "Ethiopic": ("ሀለመሰረሸቀበተነ", "።"), "Khmer": ("កខគងចជតនបមយរ", "។"), "Arabic": ("ابتجدرسعفقلمن", "؟"), "Japanese": ("あいうえおかきくけこ", "。"),
}


def test_pages_of_many_scripts():
    """64 pages: eight scripts, eight ways to hold the text; no page gives an empty text."""
    right = got = want = whole = 0
    kinds = ["article", "plain", "section", "table", "main", "teasers", "form", "social"]
    for seed, (script, kind) in enumerate(itertools.product(SCRIPTS, kinds)):
        rng = random.Random(seed)
        letters, mark = SCRIPTS[script]
        sentence = lambda n: " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))  # noqa: E731, B023
        parts = [("h1", sentence(4))] + [("p", " ".join(sentence(rng.randint(5, 12)) + mark for _ in range(rng.randint(2, 5)))) for _ in range(rng.randint(2, 6))]
        inner = "".join(f"<{tag}>{x}</{tag}>" for tag, x in parts)
        page = {"form": f"<form><input type=hidden><div>{inner}</div><input type=submit></form>", "social": f"<div class='social-post'>{inner}</div>"}.get(kind) or wrap(kind, inner)
        found = extract(f"<html>{LINKS}{page}<footer><p>{sentence(6)}{mark}</p></footer></html>")
        assert found
        text = " ".join(x for _, x in parts)
        a, b = collections.Counter(found.split()), collections.Counter(text.split())
        right, got, want, whole = right + sum((a & b).values()), got + sum(a.values()), want + sum(b.values()), whole + (found == text)
    print(f"precision {right / got:.4f} recall {right / want:.4f} whole {whole} of 64")
    assert right / got >= 0.98 and right / want >= 0.98 and whole >= 58


def test_repeated_rows_and_clashing_columns(spark):
    from helioflux.llm.html_extract import extract_pages

    rows = [(1, "<p>Hello world</p>", "x"), (1, "<p>Hello world</p>", "x"), (None, None, None)]
    d = extract_pages(spark.createDataFrame(rows, "page_id long, html string, main_text string"))
    assert sorted((r["page_id"] or 0, r["main_text"]) for r in d.collect()) == [(0, ""), (1, "Hello world"), (1, "Hello world")]
    assert extract_pages(d.limit(0)).collect() == []
