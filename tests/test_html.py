import random
import re
import time
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

from siteroster.functions import fixed_values as V
from siteroster.functions import html as H
from siteroster.functions.text import word_count
from siteroster.operators.pages import page_ok, page_size_guard, parse_pages
from tests.conftest import DATA


class Visible(HTMLParser):
    """Text nodes outside of hidden elements, with comments and declarations as text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.stack, self.hidden = [], [], set(V.CONTENT_TAGS) | set(V.NAV_TAGS)

    def handle_starttag(self, tag, attrs):
        if tag not in V.VOID_TAGS:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden & set(self.stack):
            self.nodes.append(data)

    def handle_comment(self, data):
        self.handle_data(data)

    def handle_decl(self, decl):
        self.handle_data(re.sub("(?i)^doctype ", "", decl))


def visible(html):
    parser = Visible()
    parser.feed(html)
    parser.close()
    text = " ".join(" ".join(n.strip() for n in parser.nodes if n.strip()).split())
    return re.sub(r"\(\s*\)", "", re.sub(r"\[\s*\]", "", text))


def test_pages_agree_with_a_real_parser(spark):
    pages = pd.read_parquet(f"{DATA}/sf0.01/pages.parquet")
    expected = {i: visible(h) for i, h in zip(pages["page_id"], pages["html"])}
    rows = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").select("page_id", H.page_text("html").alias("t")).collect()
    assert {r.page_id: r.t for r in rows} == expected


def test_text_goldens(evaluate):
    cases = {
        "a<b>b</b>": "a b",
        "<!DOCTYPE html><p>x</p>": "html x",
        "x<!-- secret <b>y</b> -->z": "x secret <b>y</b> z",
        "<nav>menu<nav>inner</nav>rest</nav>body": "body",
        "<header><p>top</p></header>mid<footer>low": "mid",
        "<svg/>after <iframe src='x'/>it": "after it",
        "<script>if (a < b) { '</p>' }</script>code": "code",
        "<style>p{}</style ><noscript>no</noscript>yes": "yes",
        '<a title="x > y" href=z>link</a>': "link",
        "&lt;b&gt; &amp;lt; &eacute;&#233;&#xe9; &euro; &bogus; R&D": "<b> &lt; \xe9\xe9\xe9 € &bogus R&D",
        "a [ ] b ( ) c": "a  b  c",
        "t\xa0　w\x1cx": "t w x",
        "": "",
    }
    assert evaluate(list(cases), H.page_text) == list(cases.values())
    assert evaluate([None], H.page_text) == [""]
    assert evaluate(["<nav>menu</nav>x<!-- c -->"], lambda v: H.page_text(v, remove_nav=False, keep_comments=False)) == ["menu x"]


def test_large_pages_do_not_exhaust_the_stack(evaluate):
    html = "<nav>" + "<li>x</li>" * 50000 + "</nav><p>" + "word <i>w</i> " * 50000 + "</p>"
    assert evaluate([html], lambda v: word_count(H.page_text(v))) == [100000]


def test_references_agree_with_the_standard_library(evaluate):
    texts = ["&amp;", "&#39;", "&#x27;", "&#128;", "&#8364;", "&nbsp;x", "&lang;", "&CounterClockwiseContourIntegral;", "&#0;", "&#xD800;", "&amp"]
    assert evaluate(texts, lambda v: H.decode_references(v, "keep")) == [unescape(t) for t in texts]


def test_titles(evaluate):
    pages = ["<title> A &amp; B </title>", "<title><b>x</b>y</title><meta property='og:title' content=' OG '>",
             "<title></title><h1><em>In</em></h1>", "<h1>a<b>b</b></h1>", "<!-- <title>no</title> --><h1>yes</h1>", "<title> </title>"]
    assert evaluate(pages, H.page_title) == ["A & B", "OG", "In", None, "yes", ""]


def test_links(spark):
    html = ('<a href="/x">1</a><A HREF=\'y?a=1&amp;b=2\'>2</A><a href=#t>3</a><a href="">4</a><a href="JavaScript:1">5</a>'
            '<a data-href="no">6</a><a href="/x">7</a><abbr href="no">8</abbr><a name=n href=http://o.net/>9</a><a href="tel:1">10</a>'
            '<!-- <a href="/hidden"> --><a href="javascript:2">11</a><a href="mailto:a@b.co">12</a>')
    df = spark.createDataFrame([("http://h.com/d/p", html)], "url string, html string")
    got = df.select(H.page_links("html", "url"), H.page_links("html")).first()
    assert got[0] == ["http://h.com/x", "http://h.com/d/y?a=1&b=2", "JavaScript:1", "http://o.net/", "tel:1"]
    assert got[1] == ["/x", "y?a=1&b=2", "JavaScript:1", "http://o.net/", "tel:1"]


def test_headings_go_by_level(evaluate):
    html = "<h2>second <b>level</b> one</h2><h1>the first level</h1><h2>short</h2><h6>sixth level head</h6><h2>&nbsp;second two ok&nbsp;</h2>"
    assert evaluate([html], H.page_headings) == [["the first level", "secondlevelone", "second two ok", "sixth level head"]]


def test_metadata(spark):
    html = ('<meta name="a" content="1"><META content="2" NAME=a><meta property="og:x" content="&lt;3"><meta name="twitter:y" content="4">'
            '<meta name="b"><meta name="" property="c" content="5"><meta charset=utf-8><meta property="og:description" content=" OD ">')
    df = spark.createDataFrame([(html,)], "html string").withColumn("e", H.meta_entries("html"))
    maps, desc = df.select(H.meta_maps("e"), H.meta_description("e")).first()
    assert maps.meta_tags == {"a": "2", "c": "5"} and maps.open_graph == {"og:x": "<3", "og:description": " OD "}
    assert maps.twitter_card == {"twitter:y": "4"} and desc == "OD"


def test_json_ld(evaluate):
    html = ('<script type="application/ld+json">{"a": 1}</script><script type="application/ld+json">{bad}</script>'
            '<script>{"b": 2}</script><script type="application/ld+json">[1] x</script><script id=z type=application/ld+json>[3]</script>')
    assert evaluate([html], H.json_ld) == [['{"a": 1}', "[3]"]]


def test_parse_pages_and_guards(spark):
    rows = [("http://a/", "<html><body><h1>Test</h1></body></html>", 200), ("http://b/", "x", 404), ("http://c/", "", 200)]
    pages = spark.createDataFrame(rows, "url string, html string, status_code int")
    assert [r.url for r in page_ok(pages).collect()] == ["http://a/"]
    parsed = parse_pages(page_ok(pages)).first()
    assert (parsed.text, parsed.title, parsed.word_count, parsed.links, parsed.headings) == ("Test", "Test", 1, [], [])
    big = page_size_guard(pages, 10).orderBy("url").collect()
    assert [(r.html, r.error) for r in big] == [("", "Page size exceeds limit (39 bytes)"), ("x", None), ("", None)]


def test_long_reference_like_runs_stay_whole(evaluate):
    long = "x&" + "ab9" * 50 + " end"
    assert evaluate([f"<p>{long}</p>"], H.page_text) == [long]


def test_attributes_are_read_one_by_one(spark):
    html = ('<a data-x="see href=/bad now" href="/good">1</a><a title=it\'s href = /two>2</a><a disabled href=\'/three\' x>3</a>'
            '<meta content="set name=foo please" name="description"><meta content=plain name=description>')
    df = spark.createDataFrame([(html,)], "html string").withColumn("e", H.meta_entries("html"))
    links, desc = df.select(H.page_links("html"), H.meta_description("e")).first()
    assert links == ["/good", "/two", "/three"] and desc == "set name=foo please"


def test_quotes_outside_of_values_open_nothing(evaluate):
    assert evaluate(["<p title=it's>hello don't</p><p>z</p>", '<a "x>y</a> z', '<a t = "a>b">c'], H.page_text) == ["hello don't z", "y z", "c"]


def test_hidden_blocks_end_where_a_tree_ends_them(evaluate):
    cases = {
        "<div><nav>menu</div><p>body a@b.org</p>": "body a@b.org",
        "<menu>" * 50 + "deep" + "</menu>" * 50 + "body a@b.org": "body a@b.org",
        '<div data-t="<nav>">body a@b.org</div><p>more</p>': "body a@b.org more",
        "<nav>a<div>b</nav>c</div>d": "c d",
        "a</div></nav>b<nav>c<div>d</div>e": "a b",
        "<p>x<nav><p>y</p>z</nav>v</p>w<aside>u</aside>": "x v w",
        '<i title="<script>">y</i><!-- <script> -->z': "y <script> z",
        "\ufdd1<b>\ufdd2</b><!-- \ufdd3 -->": "\ufdd1 \ufdd2 \ufdd3",
        "<nav/>x<br><wbr/><img src=a>y</br>": "x y",
    }
    assert evaluate(list(cases), H.page_text) == list(cases.values())


def broken(html, rng):
    """A page with end tags taken out, blocks nested fifty deep, or tags put into attributes."""
    for _ in range(rng.randint(1, 4)):
        kind, marks = rng.randint(0, 3), [m.start() for m in re.finditer("<", html)]
        at = rng.choice(marks) if marks else 0
        if kind == 0:
            ends = [m.span() for m in re.finditer(r"</(?!script|style)\w+>", html)]
            if ends:
                a, b = rng.choice(ends)
                html = html[:a] + html[b:]
        elif kind == 1 and "<script" not in html[at:] and "<style" not in html[at:]:
            tag = rng.choice([*V.NAV_TAGS, "div", "svg"])
            html = html[:at] + f"<{tag}>w " * 50 + "deep" + f"</{tag}>" * rng.choice([49, 50, 51]) + html[at:]
        elif kind == 2:
            html = re.sub("<(p|div)>", lambda m: f'<{m[1]} data-t="{rng.choice(["<nav>", "</div>", "<!-- x"])}">', html, count=2)
        elif "<script" not in html[at:] and "<style" not in html[at:]:
            html = html[:at] + rng.choice(["<nav>", "</div>", "<aside><p>", "</p></section>", "<li>"]) + html[at:]
    return html


def test_broken_pages_agree_with_a_real_parser(evaluate):
    rng = random.Random(7)
    pages = [h for h in pd.read_parquet(f"{DATA}/sf0.01/pages.parquet")["html"] if len(h) < 20000][:1000]
    pages = [broken(h, rng) for h in pages]
    assert evaluate(pages, H.page_text) == [visible(h) for h in pages]


def test_long_runs_of_unclosed_tags_take_no_square_of_time(evaluate):
    begin = time.monotonic()
    page = "<nav>x</nav>" + "<p>" * 100000 + "<li>w" * 50000
    assert evaluate([page], lambda v: word_count(H.page_text(v))) == [50000]
    assert time.monotonic() - begin < 20


class Tree(HTMLParser):
    """Elements of a page with the text nodes inside, each trimmed."""

    def __init__(self, names):
        super().__init__(convert_charrefs=True)
        self.names, self.open, self.found = names, [], []

    def handle_starttag(self, tag, attrs):
        if tag not in V.VOID_TAGS:
            self.open.append((tag, []))
            if tag in self.names:
                self.found.append(self.open[-1])

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in [t for t, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if data.strip() and not {"script", "style"} & {t for t, _ in self.open}:
            for _, texts in self.open:
                texts.append(data.strip())


def elements(html, *names, least=10):
    tree = Tree(names)
    tree.feed(html)
    tree.close()
    texts = [(t, "".join(x)) for t, x in tree.found]
    return [x for n in names for t, x in texts if t == n and len(x) >= least]


def test_elements_that_nest_or_lack_an_end(evaluate):
    cases = {
        "<p>first paragraph<p>second paragraph": (["first paragraphsecond paragraph", "second paragraph"], []),
        "<div>outer text start<div>inner text long</div>tail text long</div>": ([], ["outer text startinner text longtail text long", "inner text long"]),
        "<div><p>one long text</div>after<p>short</p>": (["one long text"], ["one long text"]),
        "<P>upper <B>case</B> ends</p ><p/>x<p>tiny</p>": (["uppercaseends"], []),
        "</p></div><p>a &amp; b &lt;c&gt; and more</p>": (["a & b <c> and more"], []),
        "<p><!-- <p>not here at all</p> -->something to read": (["something to read"], []),
        "": ([], []),
    }
    assert evaluate(list(cases), lambda v: H.element_texts(v, "p")) == [p for p, _ in cases.values()]
    assert evaluate(list(cases), lambda v: H.element_texts(v, "div")) == [d for _, d in cases.values()]
    assert evaluate([None], lambda v: H.element_texts(v, "p")) == [[]]
    assert evaluate(["<h1>The first heading<h2>The second one</h2><h3>x</h3>"], H.page_headings) == [["The first headingThe second onex", "The second one"]]


def test_elements_agree_with_a_real_parser(evaluate):
    rng = random.Random(9)
    pages = [h for h in pd.read_parquet(f"{DATA}/sf0.01/pages.parquet")["html"] if len(h) < 20000]
    pages = [re.sub(r"<!--.*?-->", "", broken(h, rng), flags=re.S) for h in pages]
    levels = [f"h{n}" for n in range(1, 7)]
    assert evaluate(pages, H.page_headings) == [elements(h, *levels) for h in pages]
    for tag in ("p", "div", "li"):
        assert evaluate(pages, lambda v: H.element_texts(v, tag)) == [elements(h, tag) for h in pages]


def test_deep_and_open_tags_take_no_square_of_time(evaluate):
    evaluate(["<nav>x</nav><p>y"], lambda v: H.page_text(v))
    evaluate(["<p>y"], lambda v: H.element_texts(v, "p"))
    begin = time.monotonic()
    assert evaluate(["<nav><b>x<i></i>" * 66000], H.page_text) == [""]
    assert evaluate(["<p>" * 333000, "<div>a</div>" * 80000], lambda v: H.element_texts(v, "p")) == [[], []]
    assert evaluate(["<h1>" * 250000], H.page_headings) == [[]]
    assert evaluate(["</p>" * 100000 + "<p>" * 100000 + "</div>" * 30000], lambda v: H.element_texts(v, "p")) == [[]]
    assert time.monotonic() - begin < 20


def test_unclosed_titles_and_scripts_take_no_square_of_time(evaluate):
    pages = ["<title>" * 100000 + "end", "<h1>" * 100000, '<script type="application/ld+json">' * 20000]
    evaluate(["<title>a</title>"], lambda v: F.struct(H.page_title(v), F.size(H.json_ld(v))))
    begin = time.monotonic()
    assert evaluate(pages, lambda v: F.struct(H.page_title(v), F.size(H.json_ld(v)))) == [(None, 0)] * 3
    assert time.monotonic() - begin < 30


def test_unclosed_linked_data_reaches_to_the_end(evaluate):
    assert evaluate(['<script type="application/ld+json">{"a": 1}', '<script type="application/ld+json">{"a": "<b>"}</script>x'], H.json_ld) == [
        ['{"a": 1}'], ['{"a": "<b>"}']]
    assert evaluate(["<title>a", "<title>b</title>c</title>", "<titles>x</titles><title>y</title>"], H.page_title) == [None, "b", "y"]


def test_tokens_begin_with_one_sign(evaluate):
    """The pattern has the one sign in front of its alternatives, and finds what they find each on its own."""
    assert H._TOKEN.startswith("(?is)<(?:") and "|<" not in H._TOKEN.replace("(?:<", "")
    apart = (rf"(?is)<!--.*?-->|<(script|style)\b{H._ATTRS}>[^<]*+(?:<(?!/\1\b)[^<]*+)*+(?:</\1\s*>|\z)"
             rf"|<[!?][^>]*+>|{H._TAG}|{H._ODD_TAG}")
    rng = random.Random(3)
    parts = ["<", ">", "<!--", "-->", "<!", "<?x", "<SCRIPT", "<style a='>'>", "</script >", "</style>", "<a href=\"", "\"", "</p>", "< b", "=", "'", "x ", "\n"]
    pages = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(400)]
    found = [evaluate(pages, lambda h, t=t: F.regexp_extract_all(h, F.lit(t), F.lit(0))) for t in (H._TOKEN, apart)]
    assert found[0] == found[1]
