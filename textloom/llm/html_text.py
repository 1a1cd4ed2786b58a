"""Main text of HTML pages by tree scoring.

1. A forgiving parser builds the element tree: void elements, raw text (scripts, styles), implied ends of paragraphs and
   list items, stray end tags.
2. Elements that are no article go: scripts and forms by their tag; menus, headers, sidebars, notices, adverts and reader
   comments by tag, role or a name in class or id that says nothing else, such as "sidebar", "left-sidebar" or "ad-box";
   hidden ones. Names of discussions go whatever else they say ("user-comments"); a paragraph named as a teaser is a lead and
   stays. Other names that say more ("related-work"), or how the page is ("has-sidebar"), only move points. Elements whose
   class or id also has a name of articles as a whole are left to their points, and so are those that hold most of the
   page's text outside links, if no article or main element is elsewhere.
3. Each paragraph passes points for its length and commas to its ancestors, all to the parent, half to the grandparent, a
   third of that share further up; containers start with points by tag and by name. Points are discounted by the share of
   text that is in links. The best container is kept, widened to the article element around it, with all other articles of the
   page that have enough points; without an article, with those siblings that have enough points, are real paragraphs, or head
   it. In an article element every list stays; in another container boxes of links are menus, but for those behind a
   paragraph that a heading or a colon introduces, or whose links have two words and more: sources of a text.
4. References are decoded, white space in a block becomes one space, and blocks are joined in page order by one space.

Defined cases: null and empty pages, and pages without visible text, give the empty text. A page without markup is one
block. If nothing scores, the first article or main element is taken, else the body. Null ids and repeated rows are rows
like others; an empty table gives an empty result. Other columns are ignored. Parsing takes time and memory in proportion to
the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm import kernels as K

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe noframes xmp".split())
BLOCK = set("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - set("br option optgroup legend td th tr tbody thead tfoot html head body".split())
#: What a start tag ends, up to the element that holds such ones.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
DROPPED = set("head nav footer aside form button select input fieldset dialog menu iframe object embed applet canvas svg math audio video map figure-menu".split()) | RAW
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
UNLIKELY = set(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-menu comment comments commentlist consent cookie cookies disclaimer "
    "discussion disqus footer footnav gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination paging "
    "popup promo promotion promoted recommended related replies responses rss search share sharing shoutbox sidebar sidebars signup skip skyscraper social sponsor "
    "sponsored subscribe subscription tagcloud teaser toolbar topbar tweet widget widgets".split()
)
#: Words beside one of those that don't change what is named, and words that make a name a state of the page.
PLACES = set(
    "area bar block body bottom box button buttons col container content first fixed global group holder inner item items large last left link links list main outer page "
    "panel primary right row secondary section site slot small sticky text top unit wide wrap wrapper zone".split()
)
STATES = set("active are closed disabled enabled has have hide is no not off on open opened show shows with without".split())
LIKELY = set("article body content entry hentry main page post story text blog column".split())
DISCUSSION = set("comment comments commentlist discussion disqus replies responses reviews".split())
#: Names that a paragraph may have and still be one of the text.
LEADS = {"teaser"}
START = {"article": 10, "main": 10, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3} | dict.fromkeys("address ol ul dl dd dt li".split(), -3) | dict.fromkeys("h1 h2 h3 h4 h5 h6 th".split(), -5)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = set("p pre td blockquote div section li dd figcaption article main body center".split())
ENOUGH = 10.0


class Element:
    __slots__ = ("tag", "parent", "inner", "gone", "named", "good", "score", "length", "linked", "commas")

    def __init__(self, tag: str, parent: Element | None) -> None:
        self.tag, self.parent = tag, parent
        self.inner: list[Element | str] = []
        self.gone, self.good, self.score = False, 0, 0.0
        self.named = False  # gone by its names alone
        self.length = self.linked = self.commas = 0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip(" /\n\t") else {}


def _words(name: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(name)} | {name.lower()}


def _judge(e: Element, attributes: dict[str, str]) -> None:
    """Sets whether the element goes, and whether its names speak for it."""
    tag = e.tag
    if tag in DROPPED:
        e.gone = True
        return
    inside = e.parent
    while tag == "header" and inside is not None and inside.tag not in ("article", "main"):
        inside = inside.parent
    if tag == "header" and inside is None:
        e.gone = True
        return
    if not attributes:
        return
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        e.gone = True
        return
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    bad: set[str] = set()  # what names say that say nothing else
    points = 0
    for name in names:
        words = _words(name)
        if words & STATES:
            continue
        found = words & (UNLIKELY | DISCUSSION)
        if found & DISCUSSION or found and not words - UNLIKELY - PLACES - {name.lower()} and not name.lower() in LIKELY:
            bad |= found
        points -= bool(found)
        points += bool(words & LIKELY) and not found
    e.good = min(1, max(-1, points))
    if tag == "p":
        bad -= LEADS
    if bad and tag not in ("html", "body", "main") and not (tag == "article" and not bad & DISCUSSION) and not (tag in ("header", *HEADINGS) and "header" in bad):
        # a name such as "comments-body" or "ad-text" is still that of a comment or an advert
        e.gone = not any(name.lower() in LIKELY for name in names) or bool(bad & DISCUSSION)
        e.named = e.gone and not bad & DISCUSSION


def parse(html: str) -> Element:
    root = Element("#root", None)
    here = root
    opened: dict[str, int] = {}
    at = 0

    def close(to: Element) -> None:
        nonlocal here
        while here is not to:
            opened[here.tag] -= 1
            here = here.parent

    pos = 0
    while m := _MARKUP.search(html, pos):
        if m.start() > at:
            here.inner.append(unescape(html[at : m.start()]))
        pos = at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                here.inner.append(m[0][9:].removesuffix("]]>"))
            continue
        if m[1] or m[4]:
            if tag == "br":
                here.inner.append(Element("br", here))
            elif opened.get(tag):
                e = here
                while e.tag != tag:
                    e = e.parent
                close(e.parent)
            continue
        if tag in ENDS_P and opened.get("p"):
            e = here
            while e is not root and e.tag not in ("p", "td", "th", "button", "object", "table"):
                e = e.parent
            if e.tag == "p":
                close(e.parent)
        if tag in IMPLIED:
            ended, within = IMPLIED[tag]
            e, last = here, None
            while e is not root and e.tag not in within:
                if e.tag in ended:
                    last = e
                e = e.parent
            if last is not None:
                close(last.parent)
        e = Element(tag, here)
        here.inner.append(e)
        rest = m[3] if m[2] else m[6]
        _judge(e, _attributes(rest))
        if tag in VOID or rest.rstrip().endswith("/") and tag not in BLOCK and tag not in RAW and tag not in ("a", "b", "i", "span"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, pos)
            pos = at = end.end() if end else len(html)
            continue
        here = e
        opened[tag] = opened.get(tag, 0) + 1
    if at < len(html):
        here.inner.append(unescape(html[at:]))
    return root


def _spare(root: Element) -> None:
    """Elements that go by their names stay if they hold most of the page's text outside links, and no article is elsewhere."""
    order, stack = [], [root]
    while stack:
        e = stack.pop()
        if e.tag == "a" or e.gone and not e.named:
            continue
        order.append(e)
        stack.extend(x for x in e.inner if isinstance(x, Element))
    if not any(e.named for e in order):
        return
    held: dict[int, int] = {}
    articles: dict[int, int] = {}
    for e in reversed(order):
        n = held[id(e)] = held.get(id(e), 0) + sum(len(" ".join(x.split())) for x in e.inner if isinstance(x, str))
        k = articles[id(e)] = articles.get(id(e), 0) + (e.tag in ("article", "main") and n > 0)
        if e.parent is not None:
            held[id(e.parent)] = held.get(id(e.parent), 0) + n
            articles[id(e.parent)] = articles.get(id(e.parent), 0) + k
    for e in order:
        if e.named and 2 * held[id(e)] > held[id(root)]:
            around, up = 0, e.parent
            while up is not None:
                around += up.tag in ("article", "main")
                up = up.parent
            e.gone = articles[id(e)] + around < articles[id(root)]


def _order(root: Element) -> list[Element]:
    """The elements that stay, parents first."""
    out, stack = [], [root]
    while stack:
        e = stack.pop()
        if e.gone:
            continue
        out.append(e)
        stack.extend(x for x in reversed(e.inner) if isinstance(x, Element))
    return out


def _weigh(order: list[Element]) -> None:
    """Length of the text below each element, how much of it is in links, and its commas."""
    for e in reversed(order):
        for x in e.inner:
            if isinstance(x, str):
                n = len(" ".join(x.split()))
                e.length += n
                e.commas += x.count(",") + x.count("，") + x.count("、")
        if e.tag == "a":
            e.linked = e.length
        if e.parent is not None:
            e.parent.length += e.length
            e.parent.linked += e.linked
            e.parent.commas += e.commas


def _density(e: Element) -> float:
    return min(1.0, e.linked / e.length) if e.length else 0.0


def _score(order: list[Element]) -> None:
    scored: set[int] = set()
    for e in order:
        if e.tag not in PARAGRAPHS or not e.length or any(isinstance(x, Element) and not x.gone and x.tag in BLOCK and x.tag != "br" for x in e.inner):
            continue
        points = (min(e.length / 25, 1) + e.commas + min(e.length // 100, 3)) * (1 - _density(e))
        up, share = e.parent if e.tag in ("p", "li", "td", "dd", "pre", "blockquote", "figcaption") else e, 1.0
        level = 0
        while up is not None and level < 5:
            if id(up) not in scored:
                scored.add(id(up))
                up.score += START.get(up.tag, 0) + 25 * up.good
            up.score += points * share
            level += 1
            share = 1 / 2 if level == 1 else 1 / (level * 3)
            up = up.parent
    for e in order:
        e.score *= 1 - _density(e)


def _article(e: Element | None) -> Element | None:
    """The article or main element around an element, itself included."""
    while e is not None and e.tag not in ("article", "main"):
        e = e.parent
    return e


def _holds(outer: Element, e: Element | None) -> bool:
    while e is not None and e is not outer:
        e = e.parent
    return e is outer


def _best(root: Element, order: list[Element]) -> list[Element]:
    top = max(order, key=lambda e: e.score, default=root)
    if top.score <= 0:
        return [next((e for e in order if e.tag in ("article", "main") and e.length), next((e for e in order if e.tag == "body" and e.length), root))]
    around = _article(top)
    if around is not None:
        # further articles of the page, those in another one left to it
        return [x for x in order if x is around or x.tag == "article" and _article(x.parent) is None and not _holds(around, x) and x.score >= max(ENOUGH, 0.2 * around.score)]
    if top.parent is None or top.parent.parent is None or top.tag == "body":
        return [top]
    kept, enough = [], max(ENOUGH, 0.2 * top.score)
    around = [x for x in top.parent.inner if isinstance(x, Element) and not x.gone]
    place = around.index(top)
    for k, x in enumerate(around):
        real = x.tag == "p" and (x.length > 80 and _density(x) < 0.25 or 0 < x.length <= 80 and _density(x) == 0 and x.commas + 1 > 0)
        heads = x.tag in HEADINGS and k < place and _density(x) < 0.25
        if x is top or x.score >= enough or real or heads:
            kept.append(x)
    return kept


def _is_links(e: Element) -> bool:
    """A list or box of links."""
    return e.tag in ("ul", "ol", "dl", "div", "section", "table") and e.length > 0 and _density(e) > 0.8 and e.linked > 0 and sum(isinstance(x, Element) for x in e.inner) > 1


def _links(e: Element) -> tuple[int, int]:
    """How many links there are below an element, and how many words they have."""
    count = words = 0
    stack: list[tuple[Element | str, bool]] = [(e, False)]
    while stack:
        x, inside = stack.pop()
        if isinstance(x, str):
            words += len(x.split()) if inside else 0
        elif not x.gone:
            count += x.tag == "a"
            stack.extend((y, inside or x.tag == "a") for y in x.inner)
    return count, words


def _is_menu(e: Element, before: Element | str | None, read: bool) -> bool:
    """A box of links is a menu, unless text was read before and it has a heading or a colon in front, or links of several words."""
    if not _is_links(e):
        return False
    if not read or e.good < 0:
        return True
    if isinstance(before, Element):
        if before.tag in HEADINGS:
            return False
        last = "".join(x for x in before.inner if isinstance(x, str))
    else:
        last = before or ""
    if last.rstrip().endswith(":"):
        return False
    count, words = _links(e)
    return words < 2 * count


def _text(kept: list[Element]) -> str:
    out: list[str] = []
    chosen = {id(e) for e in kept}
    article = kept[0].tag in ("article", "main")
    stack: list[Element | str] = list(reversed(kept))
    before: Element | str | None = None  # what was read last: a heading, a paragraph or text beside elements
    read = False  # a paragraph was
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            if x.strip() and not (isinstance(before, Element) and before.tag in (*HEADINGS, "p")):
                before = x
        elif not x.gone and (article or id(x) in chosen or not _is_menu(x, before, read)):
            if x.tag in HEADINGS or x.tag == "p":
                before = x
                read = read or x.tag == "p" and x.length > 0 and _density(x) < 0.5
            edge = x.tag in BLOCK
            if edge:
                out.append(" ")
                stack.append(" ")
            stack.extend(reversed(x.inner))
    return " ".join("".join(out).split())


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    root = parse(html)
    _spare(root)
    order = _order(root)
    _weigh(order)
    _score(order)
    return _text(_best(root, order))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row; pages: page_id, url, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column(2)]
            yield pa.record_batch({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    kind = pages.schema["page_id"].dataType.simpleString()
    return K.arrow(pages.select("page_id", "url", "html"), run, f"page_id {kind}, url string, text string, n_chars long")
