"""HTML extraction by tag-path ratios: paths of tags whose text is long and punctuated hold the article."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

# Element names of the HTML standard, by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select option textarea button dialog map".split())
FRAME = frozenset("nav header footer aside menu".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br big acronym".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Words in class, id or role that name page furniture. Readers' own text counts as such unless the heading of the page is in it.
READERS = frozenset("comment comments commentlist reply replies respond disqus reactions responses guestbook".split())
#: Names of things that no article is put into.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar related recommended recommendations footer masthead toolbar login hidden copyright contentinfo complementary skip".split()
)
#: Names that also stand around articles: much text outweighs them.
DOUBTFUL = frozenset("banner side aside widget widgets header discussion social share sharing shares search form feedback".split())
#: Names of places for the text; such an element is no list of readers' notes.
CONTENT = frozenset("article body content entry main page post story text".split())
MARKS = regex.compile(r"\p{Po}")
GAPS = re.compile(r"\s+")
HEADINGS = ("h1", "h2", "h3")

#: What a furniture name on an element around a path leaves of the path's score.
FURNITURE_WEIGHT = 0.02
#: Elements of the text itself, whose class, id or role names no furniture.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figcaption body html article main".split())
#: A path that holds content has this share of the best path's score without what its neighbours lend it.
OWN_SHARE = 0.15
#: A form with less text than this for each of its controls is a form, one with more a text with controls.
TEXT_PER_CONTROL = 250
HEAD = frozenset("head base link meta noscript script style template title".split())


class _Open:
    """An open element: its name, the path that leads to it, and what holds for everything inside."""

    __slots__ = ("form", "linked", "name", "path", "unseen")

    def __init__(self, name: str, path: int, unseen: bool, linked: bool, form: int) -> None:
        self.name, self.path, self.unseen, self.linked, self.form = name, path, unseen, linked, form


class Paths:
    """Root-to-leaf tag paths as numbered nodes, so that a step costs the same at any depth; a parent has a lower number."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, str], int] = {}
        self.parent, self.name, self.article, self.words, self.times = [-1], [""], [-1], [frozenset()], [1]

    def step(self, at: int, name: str, label: str, words: frozenset[str]) -> int:
        key = (at, label)
        got = self.known.get(key)
        if got is None:
            got = self.known[key] = len(self.parent)
            self.parent.append(at)
            self.name.append(name)
            self.article.append(got if name in ("article", "main") else self.article[at])
            self.words.append(words)
            self.times.append(0)
        self.times[got] += 1
        return got

    def sums(self, own: dict[int, float]) -> list[float]:
        """Per path, what it and all paths below it have together."""
        out = [float(own.get(p, 0)) for p in range(len(self.parent))]
        for p in range(len(out) - 1, 0, -1):
            out[self.parent[p]] += out[p]
        return out

    def inside(self, top: list[bool]) -> list[bool]:
        """Per path, whether it or a path above it is marked."""
        out = list(top)
        for p in range(1, len(out)):
            out[p] = out[p] or out[self.parent[p]]
        return out


class Block:
    """Text between two borders of blocks, with its path, the characters of it in links, and the form around it."""

    __slots__ = ("form", "linked", "path", "text")

    def __init__(self, path: int, text: str, linked: int, form: int) -> None:
        self.path, self.text, self.linked, self.form = path, text, linked, form


class _Blocks(HTMLParser):
    """Cuts a page into text blocks, each with its tag path and link length."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.paths = Paths()
        self.stack: list[_Open] = [_Open("", 0, False, False, -1)]
        self.count: dict[str, int] = {}
        self.blocks: list[Block] = []
        self.forms: list[list[int]] = []  # controls that are seen, and whether the form holds a heading or an article
        self.parts: list[str] = []
        self.linked = 0

    def _flush(self) -> None:
        text = GAPS.sub(" ", "".join(self.parts)).strip()
        if text:
            top = self.stack[-1]
            self.blocks.append(Block(top.path, text, self.linked, top.form))
        self.parts, self.linked = [], 0

    def _pop(self, name: str, stop: tuple[str, ...] = ()) -> None:
        if not self.count.get(name):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name == name:
                for x in self.stack[i:]:
                    self.count[x.name] -= 1
                del self.stack[i:]
                return
            if self.stack[i].name in stop:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self._flush()
            if tag not in HEAD:
                self._pop("head")  # its end tag may be left out
            if tag in CLOSES_P:
                self._pop("p", ("article", "section", "div", "td", "blockquote", "body", "li"))
                self._pop("select")  # holds no blocks
            if tag == "button":
                self._pop("button")
            if tag in ENDS:
                for t in ("td", "th") if tag == "tr" else ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,):
                    self._pop(t, ENDS[tag])
                if tag == "tr":
                    self._pop("tr", ENDS[tag])
        a, top = dict(attrs), self.stack[-1]
        if top.form >= 0:
            held = self.forms[top.form]
            held[0] += tag in ("select", "textarea", "button") or tag == "input" and (a.get("type") or "").lower() != "hidden"
            held[1] |= tag in ("h1", "article", "main")
        if tag in VOID:
            return
        form = top.form
        if tag == "form" and form < 0:
            form = len(self.forms)
            self.forms.append([0, 0])
        hidden = tag in UNSEEN or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in (a.get("style") or "").replace(" ", "")
        named = frozenset(re.split(r"[^a-z]+", " ".join(str(a.get(k) or "") for k in ("class", "id", "role")).lower())) - {""}
        known = frozenset() if tag in TEXTUAL else named & (FURNITURE | READERS | DOUBTFUL)
        path = top.path
        if tag not in INLINE or known:
            label = tag + ("." + ".".join(sorted((a.get("class") or "").split())[:2]) if a.get("class") else "") + ("|" + ".".join(sorted(known)) if known else "")
            path = self.paths.step(path, tag, label, named if tag not in TEXTUAL else named & CONTENT)
        self.stack.append(_Open(tag, path, top.unseen or hidden, top.linked or tag == "a", form))
        self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        self._pop(tag, ("article",) if tag in INLINE or tag == "p" else ())

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if top.unseen:
            return
        self.parts.append(data)
        if top.linked:
            self.linked += len(data)


def page_blocks(html: str) -> tuple[list[Block], Paths]:
    """Blocks of a page, in order, and the paths. Forms that are controls are left out, those around a text are not."""
    p = _Blocks()
    p.feed(html)
    p.close()
    p._flush()
    text = [0] * len(p.forms)
    for b in p.blocks:
        if b.form >= 0:
            text[b.form] += len(b.text)
    shown = [bool(held) or n >= TEXT_PER_CONTROL * max(1, controls) for n, (controls, held) in zip(text, p.forms, strict=True)]
    return [b for b in p.blocks if b.form < 0 or shown[b.form]], p.paths


def _smooth(values: list[float]) -> list[float]:
    """Each value with its neighbours, weighted 1, 2, 1."""
    out = []
    for i, v in enumerate(values):
        near = [*values[max(0, i - 1) : i], v, v, *values[i + 1 : i + 2]]
        out.append(sum(near) / len(near))
    return out


def _furniture(paths: Paths, text: list[float], h1: list[float], holds: list[float]) -> list[bool]:
    """Per path, whether an element of it is furniture by tag or name.

    ``text``, ``h1`` and ``holds`` count, for a path with all below it, the characters outside links, first-level headings and article or
    main elements. Readers' text is none if the heading is in it, other names if the heading and half of all text are, doubtful
    ones if half of the text of the page or of the article around them is, or the article itself.
    """
    own = []
    for p, (name, words) in enumerate(zip(paths.name, paths.words, strict=True)):
        around = max(0, paths.article[paths.parent[p]]) if p else 0
        if name in FRAME:
            own.append(True)
        elif not p or name in TEXTUAL:
            own.append(False)
        elif words & READERS:
            own.append(not h1[p])
        elif words & FURNITURE:
            own.append(not (h1[p] and text[p] >= 0.5 * text[0]))
        elif words & DOUBTFUL:
            own.append(not (h1[p] or holds[p] and text[p] >= 0.5 * text[0] or text[p] >= 0.5 * text[around]))
        else:
            own.append(False)
    return paths.inside(own)


def _readers_notes(paths: Paths, text: list[float], direct: dict[int, float], h1: list[float], heads: list[float]) -> list[bool]:
    """Per path, whether it is in a run of like elements outside the part with the heading: readers' notes under any name.

    That is three or more of one path with paragraphs but no heading inside, in a parent without the first heading and
    without a name for content, on a page where text stands beside the heading.
    """
    out = [False] * len(paths.parent)
    title = max((p for p, n in enumerate(paths.name) if n == "h1" and h1[p]), default=-1)
    if title < 0:
        return out
    region = paths.parent[title]
    beside = sum(direct.get(p, 0) for p, at in enumerate(paths.parent) if at == region and paths.name[p] == "p")
    for p, name in enumerate(paths.name):
        up = paths.parent[p]
        if paths.times[p] >= 3 and name in ("div", "li", "article", "section") and up > 0 and not h1[up] and not heads[p] and beside > 0:
            nested = text[p] - direct.get(p, 0)
            if nested > direct.get(p, 0) and up != region and not (paths.words[p] | paths.words[up]) & CONTENT:
                out[up] = True
    return paths.inside(out)


def _anchor(paths: Paths, text: list[float], h1: list[float], furniture: list[bool]) -> int:
    """The article or main element that is the text's place, or -1: the innermost one around the first-level heading; on a page without
    such a heading the only one; beside a heading elsewhere the only one, if it has half of the text."""
    spots = [p for p, n in enumerate(paths.name) if n in ("article", "main") and text[p] and not furniture[p]]
    with_title = [p for p in spots if h1[p]]
    if with_title:
        return with_title[-1]
    alone = [p for p in spots if paths.times[p] == 1 and (not h1[0] or text[p] >= 0.5 * text[0])]
    articles = [p for p in alone if paths.name[p] == "article"]
    if len(articles) == 1 and sum(paths.name[p] == "article" for p in spots) == 1:
        return articles[0]
    mains = [p for p in alone if paths.name[p] == "main"]
    return mains[0] if len(mains) == 1 and not articles else -1


def extract(html: str | None) -> str:
    """The main text of one page.

    Per tag path, from the blocks that are not mostly links: text length per node (the ratio of text to paths) and punctuation per node
    (any script's). Both are smoothed over the neighbouring paths in page order and fused as length * (1 + log(1 +
    punctuation)); a path inside furniture (by tag, name or as a run of readers' notes) keeps FURNITURE_WEIGHT of its score. Where an
    article or main element is the text's place, only paths inside count. Paths at or above a threshold (a share of the
    spread of all scores) hold content; where none does, the best path outside furniture does, so that any text gives a result.
    Short blocks follow them: those inside the element that holds most of their score, and those in the article and main
    elements around the path with most text, unless they are mostly links or furniture. Null or empty html and pages of
    furniture alone give ""; a page is read to its end at any depth.
    """
    if not html:
        return ""
    blocks, paths = page_blocks(html)
    stats: dict[int, list[float]] = {}
    free: dict[int, float] = {}
    for b in blocks:
        s = stats.setdefault(b.path, [0, 0, 0, 0, 0])
        s[3], s[4] = s[3] + b.linked, s[4] + len(b.text)
        if b.linked < 0.5 * len(b.text):
            s[0], s[1], s[2] = s[0] + len(b.text), s[1] + len(MARKS.findall(b.text)), s[2] + 1
            free[b.path] = free.get(b.path, 0) + len(b.text)
    if not stats:
        return ""
    text = paths.sums(free)
    frame = paths.inside([n in FRAME for n in paths.name])
    h1 = paths.sums({p: 1 for p, n in enumerate(paths.name) if n == "h1" and stats.get(p) and not frame[p]})
    furniture = _furniture(paths, text, h1, paths.sums({p: 1 for p, n in enumerate(paths.name) if n in ("article", "main")}))
    notes = _readers_notes(paths, text, free, h1, paths.sums({p: 1 for p, n in enumerate(paths.name) if n in HEADINGS}))
    furniture = [a or b for a, b in zip(furniture, notes, strict=True)]
    anchor = _anchor(paths, text, h1, furniture)
    here = paths.inside([p == anchor for p in range(len(paths.parent))]) if anchor > 0 else [True] * len(paths.parent)
    weight = [FURNITURE_WEIGHT if furniture[p] else 1.0 for p in stats]
    raw = [(w * s[0] / max(1, s[2]), w * s[1] / max(1, s[2])) for w, s in zip(weight, stats.values(), strict=True)]
    fused = {p: w * n * (1 + math.log1p(m)) for p, w, n, m in zip(stats, weight, _smooth([x[0] for x in raw]), _smooth([x[1] for x in raw]), strict=True) if here[p]}
    mean = sum(fused.values()) / len(fused)
    spread = math.sqrt(sum((x - mean) ** 2 for x in fused.values()) / len(fused))
    alone = {p: s[0] / max(1, s[2]) * (1 + math.log1p(s[1] / max(1, s[2]))) for p, s in stats.items() if here[p] and not furniture[p]}  # without its neighbours
    least = OWN_SHARE * max(alone.values(), default=0)
    chosen = {p for p, x in fused.items() if x >= 0.5 * spread and stats[p][0] and not furniture[p] and alone[p] >= least}
    if not chosen:
        left = [p for p in fused if stats[p][0] and not furniture[p]]
        if not left:
            return ""
        chosen = {max(left, key=lambda p: (fused[p], -p))}
    around = set()
    at = paths.article[max(chosen, key=lambda p: (stats[p][0], p))]
    while at > 0:
        around.add(at)
        at = paths.article[paths.parent[at]]
    held: dict[int, float] = {}
    for p in chosen:
        held[paths.parent[p]] = held.get(paths.parent[p], 0) + fused[p]
    home = max(held, key=lambda h: (held[h], h))
    under = paths.inside([p == home and home > 0 and paths.name[home] not in ("body", "html") for p in range(len(paths.parent))])
    mostly = lambda s, most: s[3] >= most * s[4]  # noqa: E731  links
    short = {p for p, s in stats.items() if here[p] and not furniture[p] and (paths.article[p] in around and not mostly(s, 0.7) or under[p] and not mostly(s, 0.5))}
    above, at = {home}, home
    while at > 0:
        at = paths.parent[at]
        above.add(at)
    short |= {p for p in stats if paths.name[p] == "h1" and here[p] and not furniture[p] and (paths.parent[p] in above or under[p])}  # the title
    textual = lambda p: paths.name[p] in ("p", *HEADINGS)
    return " ".join(b.text for b in blocks if b.path in chosen and (textual(b.path) or b.linked < 0.9 * len(b.text)) or b.path in short)


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``main_text`` (empty if there is none). Pages are independent; nothing is shuffled or gathered.

    Extra columns are carried along; a column named ``main_text`` is replaced. Repeated rows are read each; an empty table
    gives an empty one.
    """
    own = [c for c in pages.columns if c != "main_text"]
    d = pages.select(*own)
    schema = StructType([*d.schema.fields, StructField("main_text", StringType())])
    at = own.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([extract(h) for h in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, "main_text"])

    return d.mapInArrow(run, schema)
