from urllib.parse import urljoin, urlsplit

from pyspark.sql import functions as F

from siteroster.functions import urls as U


def test_extract_urls(evaluate):
    texts = [
        "Check out https://google.com and http://example.org", "Visit www.openai.com for info",
        "https://site-a.com,\n(http://site-b.org)\n[www.site-c.net]", "https://google.com https://google.com",
        "https://example.com/report.pdf https://example.com/image.png", "", None]
    assert evaluate(texts, U.extract_urls) == [
        ["http://example.org", "https://google.com"], ["https://www.openai.com"],
        ["http://site-b.org", "https://site-a.com", "https://www.site-c.net"], ["https://google.com"], [], [], []]


def test_short_first_label_loses_its_path(evaluate):
    # and so slips past the filter on file endings
    assert evaluate(["see https://t.co/abc and https://x.org/a.pdf"], U.extract_urls) == [
        ["https://t.co", "https://x.org"]]


def test_long_hosts_do_not_exhaust_the_stack(evaluate):
    text = "https://" + "a." * 50000 + "com"
    assert evaluate([text], U.extract_urls) == [[text]]


def test_parts_agree_with_the_standard_library(evaluate):
    urls = ["https://A.b:80/p;x/q;y?z=1#f", "http://h", "//h/p?q", "mailto:a@b", "/only/path", "", "HTTP://User@H/?a?b#c#d",
            "ftp://x/y", "x.com/a b", "https://h?q", "http://h#f"]
    expected = [(s.scheme, s.netloc, s.path, s.query, s.fragment) for s in map(urlsplit, urls)]
    got = evaluate(urls, lambda v: F.struct(U.scheme(v), U.netloc(v), U.full_path(v), U.query(v), U.fragment(v)))
    assert [tuple(r) for r in got] == expected


def test_resolve_agrees_with_the_standard_library(spark):
    bases = ["http://a.com", "http://a.com/", "http://a.com/b/c/d?x=1#y", "https://A.com/b/", "http://a.com/b/c/../d"]
    hrefs = ["g", "./g", "g/", "/g", "//h/g", "?y", "g?y", "#s", "g#s", "..", "../", "../g", "../..", "../../../g", ".", "./",
             "/./g", "/../g", "g/./h", "g/../h", "tel:1", "HTTPS://H/x", "http:g", "a//b", " sp", "x;p", "...", "..g", "g..", ""]
    pairs = [(b, h) for b in bases for h in hrefs]
    df = spark.createDataFrame(pairs, "base string, href string").select("base", "href", U.resolve_url("base", "href").alias("t"))
    wrong = [(r.base, r.href, r.t, urljoin(r.base, r.href)) for r in df.collect() if r.t != urljoin(r.base, r.href)]
    assert wrong == []


def test_normalize_and_domains(evaluate):
    assert evaluate(["HTTPS://Shop.COM/a/b/;v=1?q=2#x", "http://h/"], U.normalize_url) == ["https://shop.com/a/b?q=2", "http://h"]
    assert evaluate(["a.b.c.de", "local", ""], U.base_domain) == ["c.de", "local", ""]
    assert evaluate(["http://a", "ftp://a", "a.com", None, "http:///x"], U.is_valid_url) == [True, False, False, False, False]
