"""HTML extraction on varied pages whose main text is known: precision and recall of words, and the odd cases of the format."""

import collections
import itertools
import random
import time

from helioflux.llm import html_extract

WORDS = "river stone paper window garden letter market winter engine silver mountain harbour question answer teacher doctor music bridge forest candle".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + rng.choice([".", ".", "!", "?"])


def paragraph(rng):
    return " ".join(sentence(rng, rng.randint(6, 14)).replace(" ", ", ", 1) for _ in range(rng.randint(2, 5)))


def wrap(kind, inner):
    return {
        "article": f"<main><article class='post'>{inner}</article></main>",
        "plain": f"<div id='page'><div class='story-body'>{inner}</div></div>",
        "section": f"<section><div class='c1'><div class='c2'>{inner}</div></div></section>",
        "table": f"<table><tr><td>{inner}</td></tr></table>",
        "main": f"<main id='content'>{inner}</main>",
        "teasers": f"<div class='text'>{inner}</div><article class='card'><h3>Next one</h3><p>Read on.</p></article><article class='card'><h3>Other</h3><p>Read too.</p></article>",
    }[kind]


def furniture(kind, rng):
    links = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rng.sample(WORDS, 5))
    text = paragraph(rng)
    return {
        "bare": ("", ""),
        "menus": (f"<header><h2>Site</h2></header><nav><ul>{links}</ul></nav>", f"<footer><p>&copy; All rights reserved, {sentence(rng, 4)}</p></footer>"),
        "divs": (f"<div class='top-menu'><ul>{links}</ul></div><div class='cookie-notice'><p>{text}</p></div>", f"<div id='sidebar'><p>{sentence(rng, 9)}</p><ul>{links}</ul></div>"),
        "comments": ("<form><label>Search</label><button>Go</button></form>", f"<div class='comments'><div class='comment'><p>{text}</p></div><div class='comment'><p>{paragraph(rng)}</p></div></div>"),
        "adverts": (f"<aside class='promo'>{text}</aside>", f"<div class='ad'>{text}</div><script>var x = '<p>{text}</p>';</script><style>p {{ }}</style>"),
        "sloppy": (f"<head><title>t</title><body><ul class=nav>{links}", f"<select><option>{sentence(rng, 5)}</select><dialog open>{text}</dialog>"),
    }[kind]


def page(body, around, seed):
    rng = random.Random(seed)
    parts = [("h1", sentence(rng, 5)), *[("p", paragraph(rng)) for _ in range(rng.randint(3, 7))], ("h2", sentence(rng, 3)), ("p", paragraph(rng)), ("ul", [sentence(rng, 4) for _ in range(3)]), ("blockquote", paragraph(rng))]
    inner, want = "", []
    for tag, x in parts:
        inner += f"<{tag}>" + ("".join(f"<li>{y}</li>" for y in x) if tag == "ul" else x.replace(" ", " <em>", 1).replace(",", "</em>,", 1) if tag == "p" else x) + f"</{tag}>"
        want += x if tag == "ul" else [x]
    before, after = furniture(around, rng)
    return f"<!DOCTYPE html><html>{before}{wrap(body, inner)}{after}</html>", " ".join(want)


def test_precision_and_recall():
    """36 pages: six ways to hold the text, six kinds of furniture."""
    right = got = want = whole = 0
    kinds = list(itertools.product(["article", "plain", "section", "table", "main", "teasers"], ["bare", "menus", "divs", "comments", "adverts", "sloppy"]))
    for seed, (body, around) in enumerate(kinds):
        html, text = page(body, around, seed)
        found = html_extract.extract(html)
        a, b = collections.Counter(found.split()), collections.Counter(text.split())
        right, got, want = right + sum((a & b).values()), got + sum(a.values()), want + sum(b.values())
        whole += found == text
    precision, recall = right / got, right / want
    print(f"pages {len(kinds)} precision {precision:.4f} recall {recall:.4f} whole {whole}")
    assert precision >= 0.98 and recall >= 0.98 and whole >= 30


def test_head_without_end_tag():
    assert html_extract.extract("<html><head><title>x</title><body><p>A text, of some words. And more.</p>") == "A text, of some words. And more."


def test_class_words_on_the_text_itself():
    html = "<article><h1>T</h1><p>Long text here, with stops. More of it, yes.</p><p class='notice-text'>A notice, but of the article.</p><p class='story-comment-note'>This, too.</p></article><div class='ad'>Buy, now. Cheap, good.</div>"
    assert html_extract.extract(html) == "T Long text here, with stops. More of it, yes. A notice, but of the article. This, too."


def test_deep_pages_take_time_in_step_with_their_length():
    def took(n):
        began = time.perf_counter()
        html_extract.extract("<div>x, y. " * n)
        return time.perf_counter() - began

    took(200)
    assert took(16000) < 40 * max(took(1000), 0.01)
