import json
import random
from datetime import datetime, timedelta
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from siteroster.operators import budgets as B
from siteroster.operators import requests as R
from siteroster.operators.report import contact_report
from siteroster.operators.robots import robots_delay, robots_filter, robots_rules
from siteroster.operators.walk import crawl_report, page_facts, site_walk

random.seed(3)


# --- walks --------------------------------------------------------------------------------------

def plain_walk(seed, mode, pages, least=0.7, respect=True, refused=frozenset(), max_pages=15, max_emails=5):
    """First in, first out; ``pages`` maps url -> (confidences, links). Rows are (url, ok, addresses taken)."""
    queue, seen, mails = [seed], [], 0
    while queue and len(seen) < max_pages and mails < max_emails:
        url = queue.pop(0)
        ok = url in pages and not (respect and url in refused)
        sure, links = pages[url] if ok else ([], [])
        taken = min(sum(c >= least for c in sure), max_emails - mails)
        seen.append((url, ok, taken))
        mails += taken
        known = {u for u, _, _ in seen} | set(queue)
        root = "{0.scheme}://{0.netloc}".format(urlsplit(url))
        if len(seen) == 1 and taken == 0 and root not in known:
            queue.append(root)
        if mode == "deep" and mails < max_emails:
            for link in links:
                if urlsplit(link).netloc == urlsplit(url).netloc and link not in {u for u, _, _ in seen} | set(queue):
                    queue.append(link)
    return seen


def walked(visits):
    got = {}
    for r in visits.orderBy("visit").collect():
        got.setdefault((r.job_id, r.seed), []).append((r.url, r.ok, r.taken))
    return got


def plain_facts(df):
    """Pages of a test bring their facts along, as JSON."""
    return df.select("url", F.from_json("html", "c array<double>, l array<string>").alias("f")).select(
        "url", F.col("f.c").alias("confidences"), F.col("f.l").alias("links"))


def as_pages(spark, pages):
    rows = [(u, json.dumps({"c": c, "l": links}), 200) for u, (c, links) in pages.items()]
    return spark.createDataFrame(rows, "url string, html string, status_code int")


def test_walk_agrees_with_a_plain_queue(spark):
    pages, seeds = {}, []
    for site in range(60):
        host, size = f"http://h{site}.com", random.choice([3, 8, 30])
        names = [host] + [f"{host}/p{i}" for i in range(size)]
        for name in names:
            if random.random() < 0.85:
                links = [random.choice(names + [host + "/"]) for _ in range(random.choice([0, 2, 5, 30]))]
                pages[name] = ([1.0] * random.choice([0, 0, 0, 0, 1, 2, 7]), list(dict.fromkeys(links)))
        seeds += [(f"j{site}", random.choice(names), random.choice(["deep", "deep", "quick"])) for _ in range(3)]
    seeds = list({(j, s): (j, s, m) for j, s, m in seeds}.values())
    visits = site_walk(spark.createDataFrame(seeds, "job_id string, seed string, mode string"), as_pages(spark, pages), facts=plain_facts)
    assert walked(visits) == {(j, s): plain_walk(s, m, pages) for j, s, m in seeds}


def test_many_seeds_asking_for_one_page(spark):
    pages = as_pages(spark, {"http://a.com": ([1.0], []), "http://b.com": ([], [])})
    seeds = spark.createDataFrame([(f"j{i}", "http://a.com/x" if i % 3 else "http://b.com", "quick") for i in range(300)], "job_id string, seed string, mode string")
    visits = site_walk(seeds, pages, hot_rows=20, facts=plain_facts)
    assert visits.filter("url = 'http://a.com' AND ok AND visit = 2").count() == 200 and visits.count() == 500


def shop(rng, host):
    """A site of real pages: url -> (html, addresses with confidence, phone?, links)."""
    names, out = [host] + [f"{host}/p{i}" for i in range(rng.choice([2, 6, 20]))], {}
    for url in names:
        if rng.random() < 0.1:
            continue
        # gmail loses 0.3, short names 0.1
        mails = rng.sample([("sales@x.org", 1.0), ("ab@x.org", 0.9), ("office@gmail.com", 0.7), ("me@gmail.com", 0.6), ("info@example.com", None)], rng.choice([0, 0, 1, 2, 5]))
        linked = rng.sample([("office@gmail.com", 1.0), ("desk@x.org", 1.0)], rng.choice([0, 0, 0, 1]))
        links, phone = rng.sample(names, min(len(names), rng.choice([0, 1, 3]))), rng.random() < 0.4
        html = (f"<nav>menu</nav><p>Write to {' or '.join(m for m, _ in mails)} today</p>" + ("<p>Call +1 (555) 010-2030</p>" if phone else "")
                + "".join(f'<a href="mailto:{m}">mail</a>' for m, _ in linked) + "".join(f'<a href="{u}">x</a>' for u in links))
        sure = {m: c for m, c in mails if c} | dict(linked)
        out[url] = (html, list(sure.values()), phone, links)
    return out


def test_jobs_agree_with_a_plain_run(spark):
    """Threshold, mode, robots switch and validity of 500 requests, over captures of which the latest holds."""
    rng = random.Random(5)
    sites = {f"https://shop{i}.com": shop(rng, f"https://shop{i}.com") for i in range(25)}
    robots = [(f"shop{i}.com", 200, "User-agent: *\nDisallow: /p1") for i in range(0, 25, 2)]
    rows = [(u, p[0], 200, 2) for s in sites.values() for u, p in s.items()]
    rows += [(u, "<p>older stale@x.org</p>", 200, rng.choice([0, 1])) for u, *_ in rows] + [("https://shop1.com/gone", "<p>was@x.org</p>", 200, 1), ("https://shop1.com/gone", "", 404, 3)]
    pages = spark.createDataFrame(rows, "url string, html string, status_code int, captured int")
    requests, expected = [], {}
    for i in range(500):
        seeds = sorted({f"https://shop{rng.randrange(25)}.com{rng.choice(['', '/p1', '/p3', '/p99'])}" for _ in range(rng.choice([0, 1, 2]))})
        mode, least = rng.choice(["quick", "deep", "custom", None, "turbo"]), rng.choice([0.0, 0.65, 0.7, 0.95, 1.0, None, 1.5])
        respect, text = rng.choice([True, False, None]), "see " + " and ".join(seeds) if seeds else rng.choice(["none here", "abc"])
        requests.append((f"j{i}", text, mode, ["csv"], (None, None, None, respect, None), (None, least, None)))
        errors = [n for n, bad in (("input_data", len(text) < 5), ("mode", mode == "turbo"), ("ai_settings.min_confidence", least == 1.5)) if bad]
        n = 0
        for seed in seeds:
            host = "https://" + urlsplit(seed).netloc
            refused = {u for u in sites[host] if urlsplit(u).path.startswith("/p1")} if int(host[12:-4]) % 2 == 0 else set()
            facts = {u: (c, links) for u, (_, c, _, links) in sites[host].items()}
            for url, ok, taken in plain_walk(seed, mode or "quick", facts, 0.7 if least is None else least, respect is not False, refused):
                n += taken or (ok and sites[host][url][2])
        if errors:
            expected[f"j{i}"] = (0, "rejected", ",".join(errors))
        else:
            expected[f"j{i}"] = (n, "completed", None) if n else (0, "failed", "No contacts could be extracted from the provided URLs." if seeds else "No valid URLs found in input data.")
    found = R.run_jobs(spark.createDataFrame(requests, R.REQUEST_SCHEMA), pages, spark.createDataFrame(robots, "host string, status_code int, body string"), "captured")
    assert {r.job_id: (r.contacts_found, r.status, r.error) for r in found.collect()} == expected
    assert len({e[1] for e in expected.values()}) == 3


def test_only_wanted_pages_are_parsed(spark):
    """Pages of hosts without a seed are never parsed, nor twice what several rounds ask for, and nothing but addresses and links is read."""
    counted = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(html):
        counted.add(1)
        return html
    pages = {u: p for i in range(6) for u, p in shop(random.Random(i), f"https://h{i}.com").items()}
    df = spark.createDataFrame([(u, p[0], 200) for u, p in pages.items()], "url string, html string, status_code int")
    seeds = [("a", "https://h2.com", "deep"), ("b", "https://h2.com/p1", "deep"), ("c", "https://h2.com/p0", "quick")]
    asked = {u for _, s, m in seeds for u, ok, _ in plain_walk(s, m, {u: (p[1], p[3]) for u, p in pages.items()}) if ok}

    def counting(raw):
        plan = page_facts(raw)._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "facebook" not in plan and "hotel" not in plan and r"\p{nd}" not in plan
        return page_facts(raw.withColumn("html", seen("html")))
    visits = site_walk(spark.createDataFrame(seeds, "job_id string, seed string, mode string"), df, facts=counting)
    assert asked <= {r.url for r in visits.collect()}
    # a round looks up all links that it may still have room for, in one piece
    assert len(asked) <= counted.value <= sum(u.startswith("https://h2.com") for u in pages)


SITE = {
    "https://s.com/start": ("<p>closed</p>", 500),
    "https://s.com": ('<p>Hotel rooms. Call +1 (555) 010-2030</p><a href="/a">a</a><a href="/b">b</a><a href="/a">a</a><a href="https://f.net/">f</a>', 200),
    "https://s.com/a": ('<p>desk@s.com</p><a href="/">slash</a><a href="/b">b</a><a href="/c">c</a>', 200),
    "https://s.com/b": ("<p>one@s.com two@s.com three@s.com desk@s.com ab@gmail.com four@s.com</p>", 200),
    "https://s.com/c": ("<p>late@s.com</p>", 200),
    "https://f.net/": ("<p>foreign@f.net</p>", 200),
}


def test_crawl_report_golden(spark):
    pages = spark.createDataFrame([(u, h, s) for u, (h, s) in SITE.items()], "url string, html string, status_code int")
    seeds = spark.createDataFrame([("j", "https://s.com/start", "deep")], "job_id string, seed string, mode string")
    rows = crawl_report(pages, seeds).orderBy("visit", "email").collect()
    # start fails, its root is phone-only (no address counted), then /a, then /b up to five addresses; /c is never seen
    assert [(r.visit, r.email, r.confidence) for r in rows] == [(2, "", 0.0)] + [(3, "desk@s.com", 1.0)] + [
        (4, e, 1.0) for e in ("desk@s.com", "one@s.com", "three@s.com", "two@s.com")]
    assert rows[0].phone_numbers == "+1 (555) 010-2030" and rows[0].domain == "s.com" and rows[0].business_label == "hotel"


def test_contact_report_shape(spark):
    pages = spark.createDataFrame([("https://x.com/1", '<p>ab@gmail.com and low@x.io</p><a href="mailto:ab@gmail.com">', 200),
                                   ("https://x.com/2", "<p>nothing</p>", 200), ("https://x.com/3", "gone@x.io", 404)], "url string, html string, status_code int")
    rows = contact_report(pages).orderBy("email").collect()
    assert [(r.email, r.confidence, r.context[:9]) for r in rows] == [("ab@gmail.com", 1.0, "Extracted"), ("low@x.io", 1.0, "...ab@gma")]
    assert [r.facebook for r in rows] == ["", ""]
    assert contact_report(pages, 0.0, max_emails=1).count() == 1


# --- robots -------------------------------------------------------------------------------------

BODIES = [
    "User-agent: *\nDisallow: /a\nAllow: /a/b\nCrawl-delay: 3",
    "User-agent: *\nAllow: /a/b\nDisallow: /a",
    "User-agent: x\nUser-agent: Mozilla\n\nDisallow: /",
    "User-agent: moz\nDisallow: /a # note\n\nUser-agent: *\nDisallow: /\nCrawl-delay: 1",
    "Disallow: /\nUser-agent: *\nDisallow:",
    "User-agent: *\nDisallow: *\n",
    "User-agent: *\nDisallow: /b\n\nUser-agent: *\nDisallow: /\n",
    "User-agent: bot\nUser-agent: *\nDisallow: /a/b?q=1\nCrawl-delay: 2.5",
    "#only a note\r\nUser-agent : mozilla\r\nALLOW: /a/b\r\nDisallow: /%61\r\nCrawl-delay: 7",
    "", "nonsense", "User-agent: mozilla\nCrawl-delay: 4",
]
PATHS = ["", "/", "/a", "/a/b", "/a/b?q=1", "/b", "/c;x"]


def test_robots_agree_with_the_standard_library(spark):
    robots = spark.createDataFrame([(f"h{i}.com", 200, b) for i, b in enumerate(BODIES)] + [("gone.com", 404, BODIES[5])],
                                   "host string, status_code int, body string")
    hosts = [f"h{i}.com" for i in range(len(BODIES))] + ["gone.com", "none.com"]
    urls = spark.createDataFrame([(f"https://{h}{p}",) for h in hosts for p in PATHS], "url string")
    got = {r.url: r.allowed for r in robots_filter(urls, robots).collect()}
    delays = {r.host: r.crawl_delay for r in robots_delay(spark.createDataFrame([(h,) for h in hosts], "host string"), robots).collect()}
    for i, body in enumerate(BODIES):
        parser = RobotFileParser()
        parser.parse(body.splitlines())
        for p in PATHS:
            assert got[f"https://h{i}.com{p}"] == parser.can_fetch("Mozilla/5.0 (X)", f"https://h{i}.com{p}"), (i, p)
        delay = parser.crawl_delay("Mozilla/5.0 (X)")
        assert delays[f"h{i}.com"] == (float(delay) if delay else None), i
    assert all(got[f"https://{h}{p}"] for h in ("gone.com", "none.com") for p in PATHS)


def test_latest_robots_file_of_a_host_holds(spark):
    files = [("a.com", 200, "User-agent: *\nDisallow: /old", 1), ("a.com", 200, "User-agent: *\nDisallow: /new", 2),
             ("a.com", 404, "User-agent: *\nDisallow: /", 3), ("b.com", 200, "", None), ("b.com", 200, "User-agent: *\nDisallow: /", 0)]
    robots = spark.createDataFrame(files, "host string, status_code int, body string, fetched_at int")
    got = {r.host: [(x.path, x.allow) for x in r.rules] for r in robots_rules(robots).collect()}
    assert got == {"a.com": [("/new", False)], "b.com": [("/", False)]}
    plain = {r.host: [x.path for x in r.rules] for r in robots_rules(robots.drop("fetched_at")).collect()}
    assert plain == {"a.com": ["/old"], "b.com": ["/"]}


# --- budgets ------------------------------------------------------------------------------------

def make_log(n=1500, kinds=("success",) * 6 + ("failure", "blocked")):
    t, rows = datetime(2024, 1, 1), []
    for i in range(n):
        t += timedelta(milliseconds=random.choice([0, 200, 700, 1500, 4000]))
        rows.append((i, t, random.choice(["hot.com"] * 5 + [f"d{k}.com" for k in range(8)]),
                     random.choice(kinds), random.randint(1000, 90000)))
    return rows


LIMITS = B.Limits(max_total_pages=900, max_execution_time_minutes=25, max_pages_per_domain=40, max_retry_attempts=4,
                  min_request_delay_seconds=1.0, max_page_size_mb=0.08, max_total_size_mb=25.0)


@pytest.mark.parametrize("extra", [(), ("start", "block") + ("unblock",) * 3])
def test_budgets_agree_with_a_plain_audit(spark, extra):
    rows = make_log(kinds=("success",) * 6 + ("failure", "blocked", *extra))
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, domain string, kind string, bytes long")
    got = {r.event_id: r.reason for r in B.budget_check(df, LIMITS).collect()}
    sizes = {r.event_id: r.reason for r in B.size_budget(df, LIMITS).collect()}
    waits = {r.event_id: r.wait for r in B.rate_gap(df, 1.0).collect()}
    start, total, size, domains = rows[0][1], 0, 0, {}
    for i, ts, domain, kind, n in rows:
        d = domains.setdefault(domain, {"pages": 0, "failed": 0, "last": None, "size": 0, "block": None})
        gap = (ts - d["last"]).total_seconds() if d["last"] else None
        if total >= 900:
            want = "Total page limit reached (900)"
        elif (ts - start).total_seconds() / 60 >= 25:
            want = "Execution time limit reached (25 minutes)"
        elif d["block"]:
            want = f"Domain blocked: {d['block']}"
        elif d["pages"] >= 40:
            want = "Domain page limit reached (40 pages)"
        elif gap is not None and gap < 1.0:
            want = f"Rate limit: wait {1.0 - gap:.1f}s"
        else:
            want = None
        assert got[i] == want, i
        assert waits[i] == (max(0.0, 1.0 - gap) if gap is not None else 0.0)
        mb = n / 1048576
        if mb > 0.08:
            want = f"Page size ({mb:.2f}MB) exceeds limit (0.08MB)"
        elif size / 1048576 + mb > 25.0:
            want = "Total size limit would be exceeded (25.0MB)"
        elif d["size"] / 1048576 + mb > 12.5:
            want = "Domain size limit would be exceeded (12.5MB)"
        else:
            want = None
        assert sizes[i] == want, i
        if kind in ("start", "success", "failure"):
            d["last"] = ts
        if kind == "success":
            total, size = total + 1, size + n
            d["pages"] += 1
            d["size"] += n
        d["failed"] += kind == "failure"
        if kind == "failure" and d["failed"] >= 4:
            d["block"] = f"Too many failures ({d['failed']})"
        elif kind in ("block", "unblock"):
            d["block"] = "Manual block" if kind == "block" else None
    stats = {r.domain: (r.pages_scraped, r.failed_requests, r.last_request_time, r.blocked) for r in B.domain_stats(df, LIMITS).collect()}
    assert stats == {k: (d["pages"], d["failed"], d["last"], d["block"] is not None) for k, d in domains.items()}
    assert len(set(got.values())) > 5


def test_log_summaries(spark):
    rows = make_log(400)
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, domain string, kind string, bytes long")
    failures = [r for r in rows if r[3] == "failure" and r[2] == "hot.com"]
    block = {r.domain: r for r in B.domain_block(df).collect()}["hot.com"]
    assert (block.block_event, block.reason) == (failures[2][0], f"Too many failures ({len(failures)})")
    stats = B.session_stats(df).first()
    assert stats.total_pages_scraped == sum(r[3] == "success" for r in rows) and stats.domains_accessed == len({r[2] for r in rows if r[3] != "blocked"})
    empty = df.filter("false")
    assert B.scrape_stats(empty).first().success_rate == 0.0 and B.session_stats(empty).first().total_pages_scraped == 0
    assert tuple(B.stop_check(df, B.Limits(max_total_pages=10)).first()) == (True, "Total page limit reached")
    bad = spark.createDataFrame([(i, datetime(2024, 1, 1), "d", "failure" if i else "success", 1) for i in range(10)],
                                "event_id int, ts timestamp, domain string, kind string, bytes long")
    assert tuple(B.stop_check(bad).first()) == (True, "High failure rate (90.0%)")
    assert B.first_stop(bad).first().event_id == 9
    assert tuple(B.stop_check(bad.filter("event_id < 9")).first()) == (False, None)
    assert B.first_stop(bad.filter("event_id < 9")).count() == 0


# --- requests -----------------------------------------------------------------------------------

def test_requests(spark):
    rows = [("a", "https://shop.com/x", "quick", ["csv"], (1, None, None, None, None), None), ("b", "", None, None, None, None),
            ("c", "no links", "slow", ["doc"], (51, 0, 61, True, "x"), (True, 1.1, True))]
    df = spark.createDataFrame(rows, R.REQUEST_SCHEMA)
    got = {r.job_id: r for r in R.validate_requests(df).collect()}
    assert got["a"].valid and got["a"].config.max_depth == 2 and got["a"].ai_settings.min_confidence == 0.7
    assert got["b"].errors == ["input_data"] and got["b"].output_formats == ["csv"] and got["b"].mode == "quick"
    assert got["c"].errors == ["mode", "output_formats", "config.max_urls_per_domain", "config.max_depth", "config.request_timeout",
                               "ai_settings.min_confidence"]
    report = spark.createDataFrame([("a", 2)], "job_id string, n long")
    jobs = {r.job_id: (r.contacts_found, r.status, r.error) for r in R.job_summary(df, report).collect()}
    assert jobs == {"a": (2, "completed", None), "b": (0, "rejected", "input_data"), "c": (0, "rejected", ",".join(got["c"].errors))}


def test_seeds(spark):
    rows = [("j", "see www.a-b.com, ftp://x.org", "deep", ["csv"], None, (None, 0.5, None)), ("k", "https://ccc.org/x", "turbo", ["csv"], None, None),
            ("l", "https://ccc.org/x", None, None, (None, None, None, False, None), None)]
    got = R.request_seeds(spark.createDataFrame(rows, R.REQUEST_SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [("j", "https://www.a-b.com", "deep", 0.5, True), ("l", "https://ccc.org/x", "quick", 0.7, False)]
