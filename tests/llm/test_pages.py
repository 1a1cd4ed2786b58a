import random

import pytest

from textloom.llm import html_text as H
from textloom.llm import queries as Q
from textloom.llm import url_filter as U
from helpers import rows

ARTICLE = "<article><h1>A head</h1><p>First, a paragraph of some length.</p><p>Second &amp; <b>bo</b>ld, again long enough.</p></article>"
TEXT = "A head First, a paragraph of some length. Second & bold, again long enough."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("just  text", "just text"),
        ("<p>one<p>two", "one two"),
        (f"<html><body><nav><a>x</a></nav>{ARTICLE}<footer>f</footer></body></html>", TEXT),
        (f"<body><div class='ad'>Buy, buy, buy, and buy some more of it.</div>{ARTICLE}<div id='comments'><p>A reader, who has much, much, much to say here.</p></div>", TEXT),
        (f"<script>var a = '<p>no</p>';</script><style>p{{}}</style>{ARTICLE.replace('article', 'div')}<aside>side</aside>", TEXT),
        (ARTICLE.replace("<p>Second", "<form><input></form><!-- no --><p>Second"), TEXT),
        ("<ul><li>one<li>two<ul><li>three</ul></ul>", "one two three"),
        ("<p>a<br>b</p>", "a b"),
        ("<p>x &lt;tag&gt; &#233; &nbsp; y</p>", "x <tag> é y"),
        ("<p>open <b>never closed<p>next</body>", "open never closed next"),
        ("</div></p>stray", "stray"),
        ("<p>a <", "a <"),
    ],
)
def test_extract(html, text):
    assert H.extract(html) == text


@pytest.mark.parametrize("names", ['class="content with-sidebar"', 'class="post share"', 'id="main" class="has-header"', 'class="with-sidebar"'])
def test_an_unlikely_word_does_not_drop_the_article(names):
    inner = ARTICLE.removeprefix("<article>").removesuffix("</article>")
    around = "<div class='ad'>Buy, buy, buy some more.</div>", "<div class='comments post-body'><p>A reader, who has much, much to say.</p></div>"
    assert H.extract(f"<body>{around[0]}<div {names}>{inner}</div>{around[1]}</body>") == TEXT
    assert H.extract(f"<body><div {names}>{around[0]}{inner}<div class='sidebar'><p>Also, on this, and that.</p></div></div></body>") == TEXT


@pytest.mark.parametrize(
    "names", ["class='content has-sidebar'", "id='page' class='with-sidebar comments-open'", "class='warning'", "class='related-work'", "class='comments-open no-ads'", "id='shareholders'"]
)
@pytest.mark.parametrize("tag", ["div", "section"])
def test_names_that_say_more_only_move_points(tag, names):
    inner = ARTICLE.removeprefix("<article>").removesuffix("</article>")
    assert H.extract(f"<body><nav><a href='/'>x</a></nav><{tag} {names}>{inner}</{tag}><div class='ad'>Buy, buy.</div></body>") == TEXT
    assert H.extract(f"<body><article><p>Before, it.</p><{tag} {names}>{inner}</{tag}</article></body>") == f"Before, it. {TEXT}"


@pytest.mark.parametrize("names", ["ad", "ad-box", "left-sidebar", "sidebarRight", "site-notice", "main_nav", "commentlist", "comments-body", "cookie-notice", "share-buttons", "newsletterSignup"])
def test_names_that_say_nothing_else_drop_their_element(names):
    box = f"<div class='{names}'><p>Buy, buy, buy, and buy some more of all of it.</p></div>"
    assert H.extract(f"<body>{ARTICLE.replace('<p>Second', box + '<p>Second')}{box}</body>") == TEXT


def test_lists_in_an_article_stay():
    links = "<h2>Further reading</h2><ul><li><a href='/a'>One book</a></li><li><a href='/b'>Another book</a></li></ul><table><tr><td><a href='/c'>c</a><td><a href='/d'>d</a></table>"
    assert H.extract(f"<body>{ARTICLE.replace('</article>', links + '</article>')}</body>") == f"{TEXT} Further reading One book Another book c d"
    menu = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul>"
    assert H.extract(f"<body>{ARTICLE.replace('article', 'div').replace('<h1>', menu + '<h1>')}</body>") == TEXT


@pytest.mark.parametrize("names", ["user-comments", "comments-thread", "post-comments", "reader-comments", "reviews", "comment", "discussionThread"])
def test_reader_comments_go_whatever_else_they_are_called(names):
    box = f"<div class='{names}'><p>A reader, who has much, much, much to say here, and on and on.</p></div>"
    assert H.extract(f"<body>{ARTICLE.replace('</article>', box + '</article>')}{box}</body>") == TEXT
    assert H.extract(f"<body>{ARTICLE.replace('article', 'div')}{box}</body>") == TEXT


def test_all_articles_that_score():
    other = ARTICLE.replace("A head", "Another").replace("First", "Third")
    assert H.extract(f"<body>{ARTICLE}{other}</body>") == f"{TEXT} {TEXT.replace('A head', 'Another').replace('First', 'Third')}"
    assert H.extract(f"<body><div>{ARTICLE}</div><div><article><a href='/'>One more</a></article></div></body>") == TEXT
    assert H.extract(f"<body>{ARTICLE.replace('</article>', other + '</article>')}</body>").startswith(TEXT)


def test_a_lead_paragraph_is_no_teaser_box():
    assert H.extract(ARTICLE.replace("<p>First", "<p class='teaser'>First")) == TEXT
    assert H.extract(f"<body>{ARTICLE}<div class='teaser'><p>Also, on this, and on that, and more.</p></div></body>") == TEXT


def test_sources_at_the_end_of_a_text():
    inner = ARTICLE.removeprefix("<article>").removesuffix("</article>")
    for sources, text in (("<div><a href='/a'>One book</a> <a href='/b'>Another book</a></div>", "One book Another book"), ("<h2>Links</h2><ul><li><a href='/a'>A</a></li><li><a href='/b'>B</a></li></ul>", "Links A B"), ("<p>Sources:</p><ul><li><a href='/a'>A</a></li><li><a href='/b'>B</a></li></ul>", "Sources: A B")):
        assert H.extract(f"<body><div>{inner}{sources}</div></body>") == f"{TEXT} {text}"
    menu = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul>"
    assert H.extract(f"<body><div>{menu}{inner}{menu}</div></body>") == TEXT


class Plain:
    """The scoring again, by recursion over the tree and without shared state: what an element holds is asked for each time."""

    def __init__(self, root):
        self.root = root

    def kids(self, e):
        return [x for x in e.inner if isinstance(x, H.Element) and not x.gone]

    def below(self, e):
        return [e, *(y for x in self.kids(e) for y in self.below(x))]

    def length(self, e):
        return sum(len(" ".join(x.split())) for x in e.inner if isinstance(x, str)) + sum(self.length(x) for x in self.kids(e))

    def linked(self, e):
        return self.length(e) if e.tag == "a" else sum(self.linked(x) for x in self.kids(e))

    def commas(self, e):
        return sum(x.count(c) for x in e.inner if isinstance(x, str) for c in ",，、") + sum(self.commas(x) for x in self.kids(e))

    def density(self, e):
        return min(1.0, self.linked(e) / self.length(e)) if self.length(e) else 0.0

    def points(self, e):
        """What a paragraph passes, and to whom at which share."""
        if e.tag not in H.PARAGRAPHS or not self.length(e) or any(x.tag in H.BLOCK and x.tag != "br" for x in self.kids(e)):
            return 0, []
        n = self.length(e)
        own = e.tag not in ("p", "li", "td", "dd", "pre", "blockquote", "figcaption")
        chain, up = [], e if own else e.parent
        for share in (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12):
            if up is not None:
                chain.append((up, share))
                up = up.parent
        return (min(n / 25, 1) + self.commas(e) + min(n // 100, 3)) * (1 - self.density(e)), chain

    def score(self, e):
        got = [(p * share) for x in self.below(self.root) for p, chain in [self.points(x)] for to, share in chain if to is e]
        named = any(to is e for x in self.below(self.root) for to, _ in self.points(x)[1])
        return (sum(got) + (H.START.get(e.tag, 0) + 25 * e.good if named else 0)) * (1 - self.density(e))


def random_page(r, depth=0):
    tag = r.choice(["div", "p", "section", "ul", "td", "blockquote", "h2", "span", "a", "li", "article", "table"])
    words = " ".join(r.choice(["alpha", "beta,", "gamma", "delta;", "long word,"]) for _ in range(r.choice((0, 1, 4, 30))))
    name = r.choice(["", "", "", " class='content'", " id='related-work'", " class='x y'", " class='post'", " class='sidebar'", " class='user-comments'"])
    inner = "".join(random_page(r, depth + 1) for _ in range(r.randint(0, 4))) if depth < 4 else ""
    return f"<{tag}{name}>{words}{inner}{'tail,' if r.random() < 0.2 else ''}</{tag}>"


@pytest.mark.parametrize("seed", range(12))
def test_scores_by_another_road(seed):
    r = random.Random(seed)
    root = H.parse("<body>" + "".join(random_page(r) for _ in range(3)) + "</body>")
    H._spare(root)
    order = H._order(root)
    H._weigh(order)
    H._score(order)
    plain = Plain(root)
    assert [id(e) for e in order] == [id(e) for e in plain.below(root)]
    for e in order:
        assert (e.length, e.linked, e.commas) == (plain.length(e), plain.linked(e), plain.commas(e))
        assert abs(e.score - plain.score(e)) < 1e-9
    kept = H._best(root, order)
    best = max(order, key=plain.score)
    if plain.score(best) > 1e-9 and all(abs(plain.score(best) - plain.score(e)) > 1e-9 for e in order if e is not best):
        assert any(H._holds(k, best) for k in kept)


def test_short_paragraphs_score():
    assert H.extract("<body><div><a href='/'>Home</a> <a href='/x'>More of it</a></div><div><p>Short.</p><p>Shorter.</p></div></body>") == "Short. Shorter."


def test_deep_and_long_pages():
    assert H.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert H.extract("</b>" * 20000 + "<p>x") == "x"
    words = " ".join(f"w{i}" for i in range(50_000))
    assert H.extract(f"<article><p>{words}</p></article>") == words


def test_pages_of_the_table(spark, small):
    """The pages have one article each: its blocks, by another road."""
    import re
    from html import unescape

    got = {r.page_id: r for r in Q.op8_html_text(spark, small).collect()}
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        want = " ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", inner))).split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


def test_main_text_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>a", "x"), (1, "u", None, "x")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in H.main_text(pages).collect()) == [(0, "", "a", 1), (1, "u", "", 0), (1, "u", "", 0)]
    assert H.main_text(pages.limit(0)).count() == 0


URLS = [None, "", "no scheme", "http://", "http://COM/x", "http://example.com", "http://example.com/en/", "https://a.b.example.com/en/x?q#f", "http://www.example.com/en/", "http://net/es/1", "http://x.net/fr/", "http://net/de/", "ftp://notexample.com/en/", "http://h://b/c", "//x.com/", "http://com./", "http://É.COM/é"]


def plain(url, rules=U.RULES):
    """Rules one by one."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        cut = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
        path = rest[:cut]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(None, URLS[6], "clash")], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages).collect()}
    assert got == {i: plain(u) for i, u in enumerate(URLS)} | {None: plain(URLS[6])}
    assert U.judge(pages.limit(0)).count() == 0


def test_url_sql(spark, small, duck):
    assert rows(Q.op9_url_filter(spark, small).toPandas()) == rows(duck.sql(Q.ORACLE_SQL["op9_url_filter"]).df())


def test_cascade_is_exact(spark, monkeypatch):
    """With filters of two bits a key many levels are needed, and membership stays exact on the universe."""
    monkeypatch.setattr(U, "BITS", 2)
    monkeypatch.setattr(U, "HASHES", 2)
    r = random.Random(9)
    keys = [f"k{i}" for i in range(3000)]
    listed = set(r.sample(keys, 700))
    cascade = U.build(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(k,) for k in listed | {"absent"}], "key string"))
    assert len(cascade.levels) > 3
    assert {k for k in keys if cascade.has(k)} == listed
    none = U.build(spark.createDataFrame([("a",)], "key string"), spark.createDataFrame([("b",)], "key string"))
    assert not none.levels and not none.has("a")


def test_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(U, "MAX_BYTES", 8)
    keys = spark.createDataFrame([(f"k{i}",) for i in range(100)], "key string")
    with pytest.raises(ValueError):
        U.build(keys, keys)
