"""Registered queries: budgets, crawl logs, robots rules, site walks, report."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siteroster.functions.fixed_values import MANUAL_BLOCK, NO_CONTACTS_ERROR, NO_URLS_ERROR
from siteroster.functions.urls import url_root
from siteroster.operators import budgets as B
from siteroster.operators import requests as R
from siteroster.operators import robots as RB
from siteroster.operators import tables as O
from siteroster.operators.contacts import page_emails
from siteroster.operators.pages import page_ok
from siteroster.operators.report import NETWORKS, contact_report
from siteroster.operators.rows import unnest
from siteroster.operators.walk import crawl_report, site_walk, walk_addresses
from siteroster.plans import check_sql as Q
from siteroster.plans.contact_queries import _PAGE_CLEAN, page_clean
from siteroster.plans.derived import (
    ADMISSION_LOG, BLOCK_LOG, CONTACT_PAGES, CRAWL_LOG, OLD_PAGES, PAGE_SEEDS, RAW_PAGES, REQUESTS, ROBOTS_PAGES, SEEDS, SITE_ROBOTS,
    derive, table_sql,
)
from siteroster.plans.page_queries import ALL_PAGES, LINKS, all_pages
from siteroster.plans.registry import CHECKS, query
from siteroster.session import durable
from siteroster.sources.readers import read_table

_LOG = f"log AS ({table_sql(CRAWL_LOG)})"
_MIXED = f"log AS ({table_sql(ADMISSION_LOG)})"
_REAL = "kind IN ('start', 'success', 'failure')"
_ORD = "ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_OK, _BAD = "CASE WHEN kind = 'success' THEN 1 ELSE 0 END", "CASE WHEN kind = 'failure' THEN 1 ELSE 0 END"
_GOT = "CASE WHEN kind = 'success' THEN bytes ELSE 0 END"
_MB = "1048576"

# Limits chosen so that every rule speaks on a month of events.
LIMITS = B.Limits(max_total_pages=5000, max_execution_time_minutes=38000, max_pages_per_domain=12, max_retry_attempts=6,
                  min_request_delay_seconds=7200, max_page_size_mb=0.2, max_total_size_mb=60.0)


def log(spark, sf):
    return derive(spark, sf, CRAWL_LOG)


def mixed_log(spark, sf):
    return derive(spark, sf, ADMISSION_LOG)


def _latest(value: str, when: str) -> str:
    return f"last_value(CASE WHEN {when} THEN {value} END IGNORE NULLS) OVER (PARTITION BY domain {_ORD})"


@query("budget_check", f"""WITH {_MIXED}, s AS (SELECT *, coalesce(sum({_OK}) OVER ({_ORD}), 0) AS total, min(ts) OVER () AS start,
      coalesce(sum({_OK}) OVER (PARTITION BY domain {_ORD}), 0) AS pages, coalesce(sum({_BAD}) OVER (PARTITION BY domain {_ORD}), 0) AS failed,
      {_latest('ts', _REAL)} AS last, {_latest("(ts, event_id)", "kind = 'failure'")} AS bad_at,
      {_latest("(ts, event_id)", "kind IN ('block', 'unblock')")} AS set_at, {_latest("kind", "kind IN ('block', 'unblock')")} AS set_to FROM log),
    r AS (SELECT event_id, domain, CASE WHEN total >= 5000 THEN 'Total page limit reached (5000)'
      WHEN (epoch_us(ts) - epoch_us(start)) / 1000000 / 60 >= 38000 THEN 'Execution time limit reached (38000 minutes)'
      WHEN failed >= 6 AND (set_to IS NULL OR bad_at > set_at) THEN 'Domain blocked: Too many failures (' || failed || ')'
      WHEN set_to = 'block' THEN 'Domain blocked: ' || {Q.lit(MANUAL_BLOCK)}
      WHEN pages >= 12 THEN 'Domain page limit reached (12 pages)'
      WHEN 7200 - (epoch_us(ts) - epoch_us(last)) / 1000000 > 0 THEN
        'Rate limit: wait ' || printf('%.1f', 7200 - (epoch_us(ts) - epoch_us(last)) / 1000000) || 's' END AS reason FROM s)
    SELECT event_id, domain, reason IS NULL AS allowed, reason FROM r""")
def budget_check(spark, sf):
    return B.budget_check(mixed_log(spark, sf), LIMITS).select("event_id", "domain", "allowed", "reason")


@query("size_budget", f"""WITH {_LOG}, s AS (SELECT *, coalesce(sum({_GOT}) OVER ({_ORD}), 0) AS total,
      coalesce(sum({_GOT}) OVER (PARTITION BY domain {_ORD}), 0) AS own FROM log),
    r AS (SELECT event_id, CASE WHEN bytes / {_MB} > 0.2 THEN 'Page size (' || printf('%.2f', bytes / {_MB}) || 'MB) exceeds limit (0.2MB)'
      WHEN total / {_MB} + bytes / {_MB} > 60.0 THEN 'Total size limit would be exceeded (60.0MB)'
      WHEN own / {_MB} + bytes / {_MB} > 30.0 THEN 'Domain size limit would be exceeded (30.0MB)' END AS reason FROM s)
    SELECT event_id, reason IS NULL AS allowed, reason FROM r""")
def size_budget(spark, sf):
    return B.size_budget(log(spark, sf), LIMITS).select("event_id", "allowed", "reason")


@query("rate_gap", f"""WITH {_MIXED}, s AS (SELECT event_id, (epoch_us(ts) - epoch_us({_latest('ts', _REAL)})) / 1000000 AS gap FROM log)
    SELECT event_id, gap, coalesce(greatest(0, 7200 - gap), 0) AS wait FROM s""")
def rate_gap(spark, sf):
    return B.rate_gap(mixed_log(spark, sf), 7200).select("event_id", "gap", "wait")


@query("domain_block", f"""WITH {_LOG}, f AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY domain) AS failures
      FROM log WHERE kind = 'failure')
    SELECT domain, event_id AS block_event, strftime(ts, '%Y-%m-%d %H:%M:%S') AS blocked_at, failures, 'Too many failures (' || failures || ')' AS reason FROM f WHERE n = 3""")
def domain_block(spark, sf):
    return B.domain_block(log(spark, sf)).withColumn("blocked_at", F.date_format("blocked_at", "yyyy-MM-dd HH:mm:ss"))


@query("domain_unblock", f"""SELECT domain, arg_max(kind, (ts, event_id)) = 'block' AS blocked, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS since
    FROM ({table_sql(BLOCK_LOG)}) WHERE kind IN ('block', 'unblock') GROUP BY 1""")
def domain_unblock(spark, sf):
    return B.domain_unblock(derive(spark, sf, BLOCK_LOG)).withColumn("since", F.date_format("since", "yyyy-MM-dd HH:mm:ss"))


_DOMAIN_STATS = (f"SELECT domain, sum({_OK}) AS pages_scraped, sum({_GOT}) AS total_bytes, strftime(max(ts) FILTER (WHERE {_REAL}), '%Y-%m-%d %H:%M:%S') AS last_request_time, "
                 f"sum({_BAD}) AS failed_requests, coalesce(sum({_BAD}) >= 3 AND (max(CASE WHEN kind IN ('block', 'unblock') THEN (ts, event_id) END) IS NULL "
                 f"OR max(CASE WHEN kind = 'failure' THEN (ts, event_id) END) > max(CASE WHEN kind IN ('block', 'unblock') THEN (ts, event_id) END)), false) "
                 f"OR coalesce(arg_max(kind, (ts, event_id)) FILTER (WHERE kind IN ('block', 'unblock')) = 'block', false) AS blocked FROM log GROUP BY 1")


@query("domain_stats", f"WITH {_MIXED} {_DOMAIN_STATS}", longs="pages_scraped total_bytes failed_requests")
def domain_stats(spark, sf):
    return B.domain_stats(mixed_log(spark, sf)).withColumn("last_request_time", F.date_format("last_request_time", "yyyy-MM-dd HH:mm:ss"))


_SESSION = (f"session AS (SELECT sum({_OK}) AS pages, sum({_GOT}) AS bytes, sum({_BAD}) AS failed, count(*) FILTER (WHERE kind = 'blocked') AS blocked, "
            f"count(DISTINCT domain) FILTER (WHERE {_REAL}) AS domains, (max(epoch_us(ts)) - min(epoch_us(ts))) / 60000000 AS minutes FROM log)")


@query("session_stats", f"""WITH {_LOG}, {_SESSION} SELECT pages AS total_pages_scraped, bytes AS total_bytes_downloaded, pages AS successful_requests,
    failed AS failed_requests, blocked AS blocked_requests, domains AS domains_accessed, minutes AS elapsed_minutes FROM session""", longs="total_pages_scraped total_bytes_downloaded successful_requests failed_requests")
def session_stats(spark, sf):
    return B.session_stats(log(spark, sf)).drop("start_time")


WIDE = B.Limits(max_total_pages=100000, max_total_size_mb=4096.0, max_execution_time_minutes=40000)
_CAPACITY = (f"SELECT greatest(0, 100000 - pages) AS pages_remaining, greatest(0, 4096 - bytes / {_MB}) AS mb_remaining, greatest(0, 40000 - minutes) AS minutes_remaining, "
             f"pages / 100000 * 100 AS percent_pages_used, bytes / {_MB} / 4096 * 100 AS percent_size_used, minutes / 40000 * 100 AS percent_time_used FROM session")


@query("capacity", f"WITH {_LOG}, {_SESSION} {_CAPACITY}", longs="pages_remaining")
def capacity(spark, sf):
    return B.capacity(log(spark, sf), WIDE)


_HARD = ("CASE WHEN {p} >= 100000 THEN 'Total page limit reached' WHEN {b} / 1048576 >= 4096 THEN 'Total size limit reached' "
         "WHEN {m} >= 40000 THEN 'Execution time limit reached' WHEN {p} + {f} >= 10 AND {f} / ({p} + {f}) > 0.8 THEN "
         "'High failure rate (' || printf('%.1f', {f} / ({p} + {f}) * 100) || '%)' END")


@query("stop_check", f"WITH {_LOG}, {_SESSION}, r AS (SELECT {_HARD.format(p='pages', b='bytes', m='minutes', f='failed')} AS reason FROM session) "
                     f"SELECT reason IS NOT NULL AS should_stop, reason FROM r")
def stop_check(spark, sf):
    return B.stop_check(log(spark, sf), WIDE)


@query("stop_check_first", f"""WITH {_LOG}, s AS (SELECT event_id, ts, sum({_OK}) OVER w AS p, sum({_BAD}) OVER w AS f, sum({_GOT}) OVER w AS b,
      (epoch_us(ts) - epoch_us(min(ts) OVER ())) / 60000000 AS m FROM log WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    r AS (SELECT event_id, ts, CASE WHEN p >= 5000 THEN 'Total page limit reached' WHEN b / {_MB} >= 60 THEN 'Total size limit reached'
      WHEN m >= 38000 THEN 'Execution time limit reached' WHEN p + f >= 10 AND f / (p + f) > 0.8 THEN 'High failure rate' END AS reason FROM s)
    SELECT event_id, reason FROM r WHERE reason IS NOT NULL ORDER BY ts, event_id LIMIT 1""")
def stop_check_first(spark, sf):
    return B.first_stop(log(spark, sf), LIMITS).select("event_id", "reason")


def _rows(section: str, metrics: dict, source: str, name: str = "''") -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {name} AS name, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM {source}" for m, e in metrics.items())


@query("limit_summary", f"WITH {_LOG}, {_SESSION}, cap AS ({_CAPACITY}), dom AS ({_DOMAIN_STATS}) " + " UNION ALL ".join([
    _rows("config", {"max_total_pages": 100000, "max_pages_per_domain": 10, "max_total_size_mb": 4096, "max_execution_time_minutes": 40000}, "session"),
    _rows("stats", {"elapsed_minutes": "minutes", "total_pages_scraped": "pages", "total_mb_downloaded": f"bytes / {_MB}", "successful_requests": "pages",
                    "failed_requests": "failed", "blocked_requests": "blocked", "domains_accessed": "domains", "success_rate": "pages / greatest(1, pages + failed) * 100"}, "session"),
    _rows("capacity", {c: c for c in ("pages_remaining", "mb_remaining", "minutes_remaining", "percent_pages_used", "percent_size_used", "percent_time_used")}, "cap"),
    _rows("domains", {"pages": "pages_scraped", "mb": f"total_bytes / {_MB}", "failed": "failed_requests", "blocked": "blocked"}, "dom", "domain")]))
def limit_summary(spark, sf):
    return B.limit_summary(log(spark, sf), WIDE)


@query("scrape_stats", f"""WITH {_LOG}, s AS (SELECT sum({_OK}) AS good, sum({_BAD}) AS bad, sum(CASE WHEN kind IN ('success', 'failure') THEN bytes ELSE 0 END) AS b FROM log)
    SELECT good + bad AS total_requests, good AS successful_requests, bad AS failed_requests, CASE WHEN good + bad > 0 THEN good / (good + bad) * 100 ELSE 0 END AS success_rate,
    b AS total_bytes_downloaded, b / {_MB} AS total_mb_downloaded FROM s""", longs="total_requests successful_requests failed_requests total_bytes_downloaded")
def scrape_stats(spark, sf):
    return B.scrape_stats(log(spark, sf))


@query("cap_pages", """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 15""", ints="rank")
def cap_pages(spark, sf):
    return O.cap_rows(read_table(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 15).drop("ts")


_REPORT_PARTS = f"{_PAGE_CLEAN}, {Q.contact_ctes('pc', 'page_id', 'c', 'html')}, {Q.phone_ctes('pc', 'page_id', 'c')}"
_SHARED = f"{Q.phone_ctes('pc', 'page_id', 'c')}"
_LABELS = (f"nums AS (SELECT page_id, string_agg(phone, ', ' ORDER BY pos) AS numbers FROM phone_rows GROUP BY 1), "
           f"labels AS (SELECT pc.page_id, url, html, coalesce(numbers, '') AS phone_numbers, {Q.business_label('t')} AS business_label FROM pc "
           f"LEFT JOIN nums USING (page_id)), "
           f"wide AS (SELECT page_id, url, phone_numbers, business_label, {', '.join(f'coalesce({Q.social(chr(104) + chr(116) + chr(109) + chr(108), n)}, {Q.lit(str())}) AS {n}' for n in NETWORKS)} FROM labels)")
_NETS = ", ".join(NETWORKS)
_REPORT_ROWS = (
    f"rows AS (SELECT w.page_id, f.pos, f.email, w.url AS source_url, f.domain, f.confidence, left(f.context, 100) AS context, phone_numbers, business_label, {_NETS} "
    f"FROM wide w JOIN found f ON f.page_id = w.page_id UNION ALL "
    f"SELECT page_id, 0, '', url, {Q.part('url', 2)}, 0::DOUBLE, '', phone_numbers, business_label, {_NETS} FROM wide "
    f"WHERE phone_numbers <> '' AND page_id NOT IN (SELECT page_id FROM found))")
_COLUMNS = f"email, source_url, domain, confidence, context, phone_numbers, business_label, {_NETS}"


@query("contact_report", f"WITH {_REPORT_PARTS}, {_LABELS}, {_REPORT_ROWS} SELECT page_id, {_COLUMNS} FROM rows")
def report(spark, sf):
    return contact_report(all_pages(spark, sf), keep=["page_id"])


@query("cap_emails", f"WITH {_REPORT_PARTS} SELECT page_id, pos, email FROM found WHERE pos < 5", ints="pos")
def cap_emails(spark, sf):
    mails = unnest(page_emails(page_ok(all_pages(spark, sf)), 0.7), ["page_id"], "emails", "e").select("page_id", "pos", "e.email")
    return O.cap_rows(mails, ["page_id"], ["pos"], 5).drop("rank")


# --- robots --------------------------------------------------------------------------------------

def _robots(spark, sf):
    return derive(spark, sf, ROBOTS_PAGES).distinct()


_PATHQ = f"CASE WHEN {Q.part('url', 3)} = '' THEN '/' ELSE {Q.part('url', 3)} END"
_SHAPE = f"(length({Q.part('url', 2)}) % 5)"


@query("robots_filter", f"""SELECT page_id, CASE {_SHAPE} WHEN 0 THEN NOT starts_with({_PATHQ}, '/en/')
    WHEN 1 THEN starts_with({_PATHQ}, '/en/6') OR NOT (starts_with({_PATHQ}, '/en/') OR starts_with({_PATHQ}, '/fr/')) ELSE true END AS allowed FROM pages""")
def robots_filter(spark, sf):
    return RB.robots_filter(read_table(spark, sf, "pages").select("page_id", "url"), _robots(spark, sf)).select("page_id", "allowed")


@query("robots_blocked", f"""SELECT page_id, CASE WHEN ok THEN 200 ELSE 403 END AS status_code, CASE WHEN ok THEN length(html) ELSE 0 END AS chars,
    CASE WHEN NOT ok THEN 'Blocked by robots.txt' END AS error FROM (SELECT page_id, html, CASE {_SHAPE} WHEN 0 THEN NOT starts_with({_PATHQ}, '/en/')
    WHEN 1 THEN starts_with({_PATHQ}, '/en/6') OR NOT (starts_with({_PATHQ}, '/en/') OR starts_with({_PATHQ}, '/fr/')) ELSE true END AS ok FROM pages)""", ints="chars")
def robots_blocked(spark, sf):
    pages = read_table(spark, sf, "pages").withColumn("status_code", F.lit(200))
    return RB.blocked_pages(pages, _robots(spark, sf)).select("page_id", "status_code", F.char_length("html").alias("chars"), "error")


@query("robots_delay", f"SELECT DISTINCT {Q.part('url', 2)} AS host, CASE WHEN {_SHAPE} = 0 THEN 2::DOUBLE END AS crawl_delay FROM pages")
def robots_delay(spark, sf):
    robots = _robots(spark, sf)
    return RB.robots_delay(robots.select("host"), robots)


# --- walks ---------------------------------------------------------------------------------------

_CAPTURES = " UNION ALL ".join(f"SELECT page_id, url, html, status_code, {when} AS captured FROM ({table_sql(d)})"
                               for d, when in ((RAW_PAGES, "1"), (CONTACT_PAGES, "1"), (OLD_PAGES, "captured")))
_LATEST = f"(SELECT * FROM ({_CAPTURES}) QUALIFY row_number() OVER (PARTITION BY url ORDER BY captured DESC, html DESC) = 1)"
_ALLOWED = f"""CASE WHEN regexp_matches(url, '^https://site[0-9]+[.]com') THEN CASE CAST(regexp_extract(url, '^https://site([0-9]+)', 1) AS BIGINT) % 3
    WHEN 0 THEN NOT starts_with({_PATHQ}, '/p1') WHEN 1 THEN starts_with({_PATHQ}, '/p2') OR NOT starts_with({_PATHQ}, '/p') ELSE true END
    ELSE CASE {_SHAPE} WHEN 0 THEN NOT starts_with({_PATHQ}, '/en/') WHEN 1 THEN starts_with({_PATHQ}, '/en/6') OR NOT (starts_with({_PATHQ}, '/en/')
    OR starts_with({_PATHQ}, '/fr/')) ELSE true END END"""


def _links_of(source: str) -> str:
    return LINKS.replace(ALL_PAGES, source)


def _walk(seeds: str, threshold: float) -> str:
    """CTEs ending in ``walk``; ``seeds`` selects (job_id, seed, mode, min_conf, respect), each once; none is under ``threshold``."""
    return f"""{page_clean(_LATEST)}, {Q.contact_ctes('pc', 'page_id', 'c', 'html', threshold)}, {_SHARED},
    sure AS (SELECT page_id, list(c) AS confs FROM (SELECT page_id, email, max(confidence) AS c FROM both_kinds GROUP BY 1, 2) GROUP BY 1),
    linked AS (SELECT page_id, list(target ORDER BY pos) AS links FROM ({_links_of(_LATEST)}) WHERE {Q.part('target', 2)} = {Q.part('url', 2)} GROUP BY 1),
    facts AS MATERIALIZED (SELECT pc.page_id, pc.url, coalesce(confs, []::DOUBLE[]) AS confs, coalesce(links, []::VARCHAR[]) AS links, {_ALLOWED} AS allowed
      FROM pc LEFT JOIN sure USING (page_id) LEFT JOIN linked USING (page_id)),
    walk AS (
      SELECT job_id, seed, mode, min_conf, respect, [seed] AS queue, []::VARCHAR[] AS visited, 0::BIGINT AS mails, 0 AS visit, ''::VARCHAR AS url, false AS ok, 0::BIGINT AS taken
      FROM ({seeds})
      UNION ALL
      SELECT job_id, seed, mode, min_conf, respect, list_concat(list_concat(rest, fb), list_filter(CASE WHEN mode = 'deep' AND ok AND mails + taken < 5 THEN links ELSE []::VARCHAR[] END,
          lambda x: NOT list_contains(visited, x) AND x <> url AND NOT list_contains(rest, x) AND NOT list_contains(fb, x))),
        list_append(visited, url), mails + taken, visit + 1, url, ok, taken
      FROM (SELECT *, CASE WHEN visit = 0 AND taken = 0 AND root <> url AND NOT list_contains(visited, root) AND NOT list_contains(rest, root) THEN [root] ELSE []::VARCHAR[] END AS fb
        FROM (SELECT job_id, seed, mode, min_conf, respect, rest, visited, mails, visit, url, ok, root, links, CASE WHEN ok THEN least(len(list_filter(confs, lambda c: c >= min_conf)), 5 - mails) ELSE 0 END AS taken
          FROM (SELECT job_id, seed, mode, min_conf, respect, w.queue[2:] AS rest, visited, mails, visit, w.queue[1] AS url, f.url IS NOT NULL AND (f.allowed OR NOT respect) AS ok,
              regexp_extract(w.queue[1], '^(https?://[^/?#]*)', 1) AS root, f.links AS links, f.confs AS confs
            FROM walk w LEFT JOIN facts f ON f.url = w.queue[1] WHERE len(w.queue) > 0 AND visit < 15 AND mails < 5))))"""


_WALK = _walk(f"SELECT DISTINCT job_id, seed, mode, 0.7::DOUBLE AS min_conf, true AS respect FROM ({table_sql(SEEDS, PAGE_SEEDS)})", 0.7)


def captures(spark, sf):
    """The given pages and those of the shops, the latter from two times: (page_id, url, html, status_code, captured)."""
    once = derive(spark, sf, RAW_PAGES, CONTACT_PAGES, costly=True).withColumn("captured", F.lit(1))
    return once.unionByName(derive(spark, sf, OLD_PAGES, costly=True)).drop("page_id")


def _seeds(spark, sf):
    return derive(spark, sf, SEEDS, PAGE_SEEDS)


def _all_robots(spark, sf):
    return derive(spark, sf, ROBOTS_PAGES, SITE_ROBOTS).distinct()


def _visits(spark, sf):
    return site_walk(_seeds(spark, sf), captures(spark, sf), _all_robots(spark, sf), captured="captured")


@query("frontier_bfs", f"WITH RECURSIVE {_WALK} SELECT job_id, seed, visit, url, ok, taken FROM walk WHERE visit > 0", ints="taken")
def frontier_bfs(spark, sf):
    return _visits(spark, sf).drop("min_confidence")


@query("frontier_fallback", f"""WITH RECURSIVE {_WALK} SELECT job_id, seed, url, ok FROM (SELECT *, max(CASE WHEN visit = 1 THEN taken END) OVER (PARTITION BY job_id, seed) AS first_taken
    FROM walk WHERE visit > 0) WHERE visit = 2 AND first_taken = 0 AND url = regexp_extract(seed, '^(https?://[^/?#]*)', 1)""")
def frontier_fallback(spark, sf):
    """Visits of a root because the seed itself gave nothing; in every mode."""
    # a seed has 15 visits at most
    first = F.max(F.when(F.col("visit") == 1, F.col("taken"))).over(Window.partitionBy("job_id", "seed"))
    fallback = (F.col("visit") == 2) & (F.col("first_taken") == 0) & (F.col("url") == url_root("seed"))
    return _visits(spark, sf).withColumn("first_taken", first).filter(fallback).select("job_id", "seed", "url", "ok")


@query("crawl_report", f"""WITH RECURSIVE {_WALK}, {_LABELS}, {_REPORT_ROWS}
    SELECT job_id, seed, visit, {_COLUMNS} FROM walk JOIN rows ON source_url = walk.url WHERE visit > 0 AND ok AND (pos < taken OR email = '')""")
def crawl(spark, sf):
    return crawl_report(captures(spark, sf), _seeds(spark, sf), _all_robots(spark, sf), captured="captured")


@query("cap_pages_per_seed", f"""WITH RECURSIVE {_WALK} SELECT job_id, seed, max(visit) AS pages_visited, max(visit) = 15 AS capped, sum(taken) AS addresses
    FROM walk WHERE visit > 0 GROUP BY 1, 2""", ints="pages_visited", longs="addresses")
def cap_pages_per_seed(spark, sf):
    """Pages and addresses of each seed, and whether the cap on pages ended its walk or could have."""
    return _visits(spark, sf).groupBy("job_id", "seed").agg(
        F.max("visit").alias("pages_visited"), (F.max("visit") == 15).alias("capped"), F.sum("taken").alias("addresses"))


@query("cap_emails_per_seed", f"""WITH RECURSIVE {_WALK} SELECT job_id, seed, before + f.pos + 1 AS rank, visit, w.url, email FROM (
      SELECT *, coalesce(sum(taken) OVER (PARTITION BY job_id, seed ORDER BY visit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM walk WHERE visit > 0) w
    JOIN facts ON facts.url = w.url JOIN found f ON f.page_id = facts.page_id WHERE ok AND f.pos < taken""", longs="rank")
def cap_emails_per_seed(spark, sf):
    """The addresses that count against the cap of a seed, numbered in the order of its visits."""
    visits = durable(_visits(spark, sf), "visits")
    return walk_addresses(visits, captures(spark, sf), "captured")


# --- requests and jobs ----------------------------------------------------------------------------

_REQ = f"({table_sql(REQUESTS)})"


def _requests(spark, sf):
    return derive(spark, sf, REQUESTS).select(
        "job_id", "input_data", "mode", F.array(F.lit("csv"), F.col("format")).alias("output_formats"),
        F.struct(F.col("max_urls").alias("max_urls_per_domain"), "max_depth", F.col("timeout").alias("request_timeout"),
                 F.col("respect").alias("respect_robots_txt"), F.lit(None).cast("string").alias("user_agent_alias")).alias("config"),
        F.struct(F.lit(None).cast("boolean").alias("enabled"), F.col("min_conf").alias("min_confidence"),
                 F.lit(True).alias("categorize_emails")).alias("ai_settings"))


@query("request_validate", f"""SELECT job_id, coalesce(mode, 'quick') AS mode, coalesce(max_urls, 10) AS max_urls, errors, errors = '' AS valid FROM (SELECT *, concat_ws(',',
    CASE WHEN length(input_data) < 5 THEN 'input_data' END, CASE WHEN mode NOT IN ('quick', 'deep', 'custom') THEN 'mode' END,
    CASE WHEN format NOT IN ('csv', 'xlsx', 'json') THEN 'output_formats' END, CASE WHEN max_urls NOT BETWEEN 1 AND 50 THEN 'config.max_urls_per_domain' END,
    CASE WHEN max_depth NOT BETWEEN 1 AND 5 THEN 'config.max_depth' END, CASE WHEN timeout NOT BETWEEN 5 AND 60 THEN 'config.request_timeout' END,
    CASE WHEN min_conf NOT BETWEEN 0 AND 1 THEN 'ai_settings.min_confidence' END) AS errors FROM {_REQ})""")
def request_validate(spark, sf):
    done = R.validate_requests(_requests(spark, sf))
    return done.select("job_id", "mode", F.col("config.max_urls_per_domain").alias("max_urls"), F.concat_ws(",", "errors").alias("errors"), "valid")


_TARGETS = (f"list_filter(list_transform(regexp_extract_all(input_data, {Q.lit('(' + Q.URL + ')')}, 1), lambda u: {Q.clean_url('u')}), "
            f"lambda u: u IS NOT NULL)")
_VALID = """length(input_data) >= 5 AND coalesce(mode, 'quick') IN ('quick', 'deep', 'custom') AND format IN ('csv', 'xlsx', 'json')
    AND coalesce(max_urls, 10) BETWEEN 1 AND 50 AND max_depth BETWEEN 1 AND 5 AND timeout BETWEEN 5 AND 60 AND coalesce(min_conf, 0.7) BETWEEN 0 AND 1"""
_JOB_SEEDS = (f"SELECT DISTINCT job_id, seed, coalesce(mode, 'quick') AS mode, coalesce(min_conf, 0.7::DOUBLE) AS min_conf, coalesce(respect, true) AS respect "
              f"FROM (SELECT *, unnest({_TARGETS}) AS seed FROM {_REQ} WHERE {_VALID})")


@query("job_summary", f"""WITH RECURSIVE {_walk(_JOB_SEEDS, 0.0)},
    got AS (SELECT job_id, sum(CASE WHEN taken > 0 THEN taken WHEN page_id IN (SELECT page_id FROM phone_rows) THEN 1 ELSE 0 END) AS n
      FROM walk JOIN facts ON facts.url = walk.url WHERE visit > 0 AND ok GROUP BY 1),
    bad AS ({CHECKS['request_validate']}),
    job AS (SELECT r.job_id, errors, len({_TARGETS}) AS targets, coalesce(n, 0) AS n FROM {_REQ} r JOIN bad USING (job_id) LEFT JOIN got USING (job_id))
    SELECT job_id, n AS contacts_found, CASE WHEN errors <> '' THEN 'rejected' WHEN n > 0 THEN 'completed' ELSE 'failed' END AS status,
    CASE WHEN errors <> '' THEN errors WHEN targets = 0 THEN {Q.lit(NO_URLS_ERROR)} WHEN n = 0 THEN {Q.lit(NO_CONTACTS_ERROR)} END AS error FROM job""", longs="contacts_found")
def job_summary(spark, sf):
    """Each valid request walks from its own targets with its own settings; what the walk would report is counted."""
    return R.run_jobs(_requests(spark, sf), captures(spark, sf), _all_robots(spark, sf), "captured")
