"""Site walks over stored pages: which pages a polite first-in-first-out visitor would see.

Every seed carries its own short state (at most ``max_pages`` URLs, and the settings of its request), so a walk is a
few rounds of joins over all seeds at once, one round per link level. A walk never leaves the host of its seed: raw
pages of those hosts are laid out by URL once, each round parses only pages that some seed asks for and no round
has parsed, and only for what a walk needs of them. What was found is kept for the rounds after it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteroster.functions import contacts as C
from siteroster.functions import html as H
from siteroster.functions.fixed_values import DEEP_MODE, WALK_MAX_EMAILS, WALK_MAX_PAGES
from siteroster.functions.urls import netloc, url_root
from siteroster.operators.pages import page_ok
from siteroster.operators.report import page_parts, report_rows
from siteroster.operators.robots import apply_rules, robots_rules
from siteroster.operators.rows import once, unnest
from siteroster.operators.tables import HOT_ROWS, skew_safe_lookup
from siteroster.session import bucketed, durable

# Settings of a seed that names none.
MIN_CONFIDENCE, RESPECT_ROBOTS = 0.7, True

_STRINGS = "array<string>"
_SEEN = "array<struct<url:string,ok:boolean,taken:int>>"


def fact_reader(max_pages: int = WALK_MAX_PAGES) -> Callable[[DataFrame], DataFrame]:
    """A function from pages to what a walk needs of each: (url, confidences, links).

    ``confidences`` has one number per distinct address, the highest threshold that it still meets. Of the links only those
    to the page's own host matter, and of those the first ``2 * max_pages``: a walk holds at most
    ``max_pages`` URLs, so among that many distinct links it always finds all the new ones it still has room for.
    The expressions are built once for all rounds; that takes as long as a small round.
    """
    read = {"_clean": C.deobfuscate(H.page_text("html")), "_links": H.page_links("html", "url")}
    own_host = F.filter("_links", lambda x: netloc(x) == F.col("_host"))
    judged = {"confidences": C.address_confidences("_clean", "html"), "links": F.slice(own_host, 1, 2 * max_pages)}
    host = netloc("url")

    def facts(pages: DataFrame) -> DataFrame:
        return once(once(pages, read).withColumn("_host", host), judged).select("url", "confidences", "links")
    return facts


def page_facts(pages: DataFrame, max_pages: int = WALK_MAX_PAGES) -> DataFrame:
    return fact_reader(max_pages)(pages)


def latest_pages(pages: DataFrame, captured: str | None = None) -> DataFrame:
    """One row per url: the capture with the latest ``captured``, of equal ones that with the greatest html."""
    order = [F.col(captured).desc_nulls_last()] if captured else []
    newest = W.partitionBy("url").orderBy(*order, F.col("html").desc_nulls_last(), "status_code")
    return pages.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth")


def _visit(max_emails: int, max_pages: int) -> Column:
    """Walk over this round's pages in order; stop where a limit is reached."""
    start = F.struct(F.col("n_emails").alias("n"), F.size("seen").alias("p"), F.array().cast(
        "array<struct<url:string,ok:boolean,taken:int,links:array<string>>>").alias("got"))

    def step(acc: Column, page: Column) -> Column:
        take = F.least(F.coalesce(page["n_emails"], F.lit(0)), F.lit(max_emails) - acc["n"]).cast("int")
        row = F.struct(page["url"].alias("url"), page["n_emails"].isNotNull().alias("ok"), take.alias("taken"),
                       F.coalesce(page["links"], F.array().cast(_STRINGS)).alias("links"))
        after = F.struct((acc["n"] + take).alias("n"), (acc["p"] + 1).alias("p"),
                         F.concat(acc["got"], F.array(row)).alias("got"))
        return F.when((acc["n"] < max_emails) & (acc["p"] < max_pages), after).otherwise(acc)

    return F.aggregate("pages", start, step)


def _settings(seeds: DataFrame, min_confidence: float) -> DataFrame:
    """One row per job and seed, with missing settings filled in."""
    given = {c: F.coalesce(c, F.lit(v)) if c in seeds.columns else F.lit(v)
             for c, v in (("min_confidence", min_confidence), ("respect_robots", RESPECT_ROBOTS))}
    return seeds.select("job_id", "seed", "mode", *[c.alias(n) for n, c in given.items()]).distinct()


def site_walk(seeds: DataFrame, pages: DataFrame, robots: DataFrame | None = None, max_pages: int = WALK_MAX_PAGES,
              max_emails: int = WALK_MAX_EMAILS, min_confidence: float = MIN_CONFIDENCE, captured: str | None = None,
              agent: str = "mozilla", facts: Callable[[DataFrame], DataFrame] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pages visited per seed: (job_id, seed, min_confidence, visit, url, ok, taken).

    ``seeds`` is (job_id, seed, mode) and may have min_confidence and respect_robots, the settings of the request;
    ``pages`` are captures (url, html, status_code), of which the latest by ``captured`` holds; ``robots`` is what
    ``robots_rules`` takes. A page that is missing, failed, or refused to a seed that respects robots.txt is visited
    but not ok. ``taken`` is the number of addresses at the seed's threshold that the page may still give. When the first page
    is not ok or has no address, the root of its host is queued before its links. Links are followed in ``deep`` mode only.
    """
    state = durable(_settings(seeds, min_confidence).select(
        F.struct("job_id", "seed").alias("id"), "mode", "min_confidence", "respect_robots", F.array("seed").alias("queued"),
        F.array("seed").alias("next"), F.array().cast(_SEEN).alias("seen"), F.lit(0).alias("n_emails")), "walk")
    hosts = state.select(netloc("id.seed").alias("host")).distinct()
    rules = durable(robots_rules(robots, agent).join(hosts, "host", "left_semi"), "rules") if robots is not None else None
    own = pages.withColumn("host", netloc("url")).join(hosts, "host", "left_semi").drop("host")
    going = (F.size("next") > 0) & (F.col("n_emails") < max_emails) & (F.size("seen") < max_pages)
    finished, found, facts = [], [], facts or fact_reader(max_pages)
    with bucketed(page_ok(latest_pages(own, captured)), "url", "pages") as stored:
        # Each round visits at least one page of every seed it holds, hence the bound.
        for _ in range(max_pages):
            new = state.select(F.explode("next").alias("url")).distinct()
            if found:
                new = new.join(reduce(DataFrame.unionByName, found).select("url"), "url", "left_anti")
            # no page, and no host, can be asked for by more seeds than there are
            crowded = hot_rows if state.count() > hot_rows else None
            fresh = facts(stored.join(new, "url", "left_semi"))
            if rules is None:
                fresh = fresh.withColumn("allowed", F.lit(True))
            else:
                fresh = apply_rules(durable(fresh, "parsed") if crowded else fresh, rules, "url", ["url"], crowded)
            found.append(durable(fresh, "facts"))
            moved = durable(_round(state, reduce(DataFrame.unionByName, found), max_pages, max_emails, crowded), "walk")
            finished.append(moved.filter(~going))
            state = moved.filter(going)
            if state.isEmpty():
                break
    walks = reduce(DataFrame.unionByName, finished)
    return unnest(walks, ["id", "min_confidence"], "seen", "_s", "_p").select(
        "id.job_id", "id.seed", "min_confidence", (F.col("_p") + 1).alias("visit"), "_s.url", "_s.ok", "_s.taken")


def _round(state: DataFrame, facts: DataFrame, max_pages: int, max_emails: int, hot_rows: int | None) -> DataFrame:
    """Visit the next pages of every seed and queue the links they bring."""
    none = F.array().cast(_STRINGS)
    wanted = unnest(state, ["id", "min_confidence", "respect_robots"], "next", "url")
    reached = skew_safe_lookup(wanted, facts, "url", ["id", "pos"], hot_rows=hot_rows) if hot_rows else wanted.join(facts, "url", "left")
    usable = F.col("confidences").isNotNull() & (F.col("allowed") | ~F.col("respect_robots"))
    enough = F.size(F.filter("confidences", lambda c: c >= F.col("min_confidence")))
    judged = reached.select("id", "pos", "url", F.when(usable, enough).alias("n_emails"), F.when(usable, F.col("links")).alias("links"))
    gathered = judged.groupBy("id").agg(  # at most max_pages rows per seed
        F.sort_array(F.collect_list(F.struct("pos", "url", "n_emails", "links"))).alias("pages"))
    visited = once(state.join(gathered, "id"), {"_v": _visit(max_emails, max_pages)})
    got = F.col("_v.got")
    first = F.get(got, F.lit(0))
    root = url_root(first["url"])
    fallback = F.when((F.size("seen") == 0) & (F.coalesce(first["taken"], F.lit(0)) == 0)
                      & (root != first["url"]), F.array(root)).otherwise(none)
    links = F.when(F.lower("mode") == DEEP_MODE, F.flatten(F.transform(got, lambda p: p["links"]))).otherwise(none)
    fresh = F.array_except(F.concat(fallback, links), F.col("queued"))
    room = F.greatest(F.lit(max_pages) - F.size("queued"), F.lit(0))
    seen = F.concat("seen", F.transform(got, lambda p: F.struct(
        p["url"].alias("url"), p["ok"].alias("ok"), p["taken"].alias("taken"))))
    moved = once(visited, {"_next": F.slice(fresh, F.lit(1), room)})
    return moved.select("id", "mode", "min_confidence", "respect_robots", F.concat("queued", "_next").alias("queued"),
                        F.col("_next").alias("next"), seen.alias("seen"), F.col("_v.n").alias("n_emails"))


def _visited(visits: DataFrame, pages: DataFrame, captured: str | None) -> DataFrame:
    """The captures that visits have read."""
    return latest_pages(pages.join(visits.select("url").distinct(), "url", "left_semi"), captured)


def walk_report(visits: DataFrame, pages: DataFrame, captured: str | None = None) -> DataFrame:
    """Contact report of a walk: what each visited page may give, keyed by job and seed."""
    good = visits.filter("ok").select("job_id", "seed", "visit", "url", "taken", "min_confidence")
    parts = page_parts(_visited(good, pages, captured))
    joined = skew_safe_lookup(good, parts, "url", spread_by=["job_id", "seed"], how="inner", hot_rows=HOT_ROWS)
    sure = F.filter("text_hits", lambda h: h["confidence"] >= F.col("min_confidence"))
    return report_rows(once(joined, {"emails": C.merge_hits(sure, "link_hits")}), ["job_id", "seed", "visit"], "taken")


def walk_addresses(visits: DataFrame, pages: DataFrame, captured: str | None = None) -> DataFrame:
    """(job_id, seed, rank, visit, url, email): the addresses of each seed in the order of its visits, up to its cap.

    A page's rank begins after what the visits before it gave, so no seed's addresses are sorted.
    """
    before = F.sum("taken").over(W.partitionBy("job_id", "seed").orderBy("visit").rowsBetween(W.unboundedPreceding, -1))
    giving = visits.withColumn("_before", F.coalesce(before, F.lit(0))).filter("taken > 0")
    raw = page_ok(_visited(giving, pages, captured))
    clean = once(raw.select("url", "html"), {"_clean": C.deobfuscate(H.page_text("html"))})
    parts = once(clean, {"text_hits": C.email_hits("_clean"), "link_hits": C.mailto_hits("html")}).drop("_clean", "html")
    joined = skew_safe_lookup(giving, parts, "url", spread_by=["job_id", "seed"], how="inner", hot_rows=HOT_ROWS)
    sure = F.filter("text_hits", lambda h: h["confidence"] >= F.col("min_confidence"))
    merged = once(joined, {"emails": F.slice(C.merge_hits(sure, "link_hits"), F.lit(1), F.col("taken"))})
    return unnest(merged, ["job_id", "seed", "_before", "visit", "url"], "emails", "_e").select(
        "job_id", "seed", (F.col("_before") + F.col("pos") + 1).alias("rank"), "visit", "url", F.col("_e.email").alias("email"))


def walk_counts(visits: DataFrame, pages: DataFrame, captured: str | None = None) -> DataFrame:
    """(job_id, n): the rows that ``walk_report`` has for each job, without making them.

    An ok page gives the addresses taken from it, or one row for its phone numbers when it has no address.
    """
    silent = visits.filter("ok AND taken = 0")
    raw = page_ok(_visited(silent, pages, captured))
    phones = once(raw, {"_clean": C.deobfuscate(H.page_text("html"))}).select("url", (F.size(C.phone_numbers("_clean")) > 0).alias("_phones"))
    called = skew_safe_lookup(silent.select("job_id", "seed", "visit", "url"), phones.filter("_phones"), "url",
                              spread_by=["job_id", "seed"], how="inner", hot_rows=HOT_ROWS)
    rows = visits.filter("taken > 0").select("job_id", F.col("taken").cast("long").alias("n")).unionByName(
        called.select("job_id", F.lit(1).cast("long").alias("n")))
    return rows.groupBy("job_id").agg(F.sum("n").alias("n"))


def crawl_report(pages: DataFrame, seeds: DataFrame, robots: DataFrame | None = None, min_confidence: float = MIN_CONFIDENCE,
                 max_pages: int = WALK_MAX_PAGES, max_emails: int = WALK_MAX_EMAILS, captured: str | None = None) -> DataFrame:
    """Walk every seed over the stored pages and report the contacts found."""
    visits = durable(site_walk(seeds, pages, robots, max_pages, max_emails, min_confidence, captured), "visits")
    return walk_report(visits, pages, captured)
