"""Crawl budgets and crawl-log analytics over a log (event_id, ts, domain, kind, bytes).

``kind`` is success, failure, blocked, start, block or unblock. A refusal (``blocked``) is no request: it moves no
clock. ``unblock`` lifts a block until the next failure at or over the limit sets it again. Sequence questions go through
``running``, which keeps a hot domain (or the whole session) off a single task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteroster.functions.fixed_values import BYTES_PER_MB, MANUAL_BLOCK
from siteroster.operators.running import Looks, running
from siteroster.session import durable

ORDER = ["ts", "event_id"]


@dataclass(frozen=True)
class Limits:
    max_pages_per_domain: int = 10
    max_total_pages: int = 50
    max_page_size_mb: float = 10.0
    max_total_size_mb: float = 100.0
    max_execution_time_minutes: int = 10
    min_request_delay_seconds: float = 1.0
    max_retry_attempts: int = 3


def _is(kind: str) -> Column:
    return (F.col("kind") == kind).cast("long")


def _real(value: str) -> Column:
    """``value`` on rows that are requests, else NULL."""
    return F.when(F.col("kind").isin("start", "success", "failure"), F.col(value))


def _failed_at() -> Column:
    return F.when(F.col("kind") == "failure", F.struct(*ORDER))


def _switched() -> Column:
    """(order, kind) of a block or unblock by hand."""
    return F.when(F.col("kind").isin("block", "unblock"), F.struct(*ORDER, "kind"))


def _block_reason(failures: Column, failed_at: str, switched: str, limits: Limits) -> Column:
    """Why a domain is blocked, or NULL: a failure at the limit later than any switch, or a block as last switch."""
    since = F.struct(*[F.col(f"{switched}.{c}").alias(c) for c in ORDER])
    renewed = (failures >= limits.max_retry_attempts) & (F.col(switched).isNull() | (F.col(failed_at) > since))
    return (F.when(renewed, F.concat(F.lit("Too many failures ("), failures.cast("string"), F.lit(")")))
            .when(F.col(f"{switched}.kind") == "block", F.lit(MANUAL_BLOCK)))


def _success_bytes() -> Column:
    return F.when(F.col("kind") == "success", F.col("bytes")).otherwise(F.lit(0)).cast("long")


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _gap_seconds(later: str, earlier: str) -> Column:
    return (_micros(later) - _micros(earlier)) / F.lit(1e6)


def budget_check(log: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Would each request have been let through, given all that was logged before it? Adds
    ``allowed`` and ``reason``; the tests run in a fixed order and the first that fails speaks."""
    both = running(log, ORDER, ["domain"], sums={"_pages": _is("success"), "_failed": _is("failure")},
                   latest={"_last": _real("ts"), "_failed_at": _failed_at(), "_switched": _switched()},
                   overall=Looks(sums={"_total": _is("success")}, earliest={"_start": F.col("ts")}))
    minutes = _gap_seconds("ts", "_start") / 60
    wait = F.lit(float(limits.min_request_delay_seconds)) - _gap_seconds("ts", "_last")
    block = _block_reason(F.col("_failed"), "_failed_at", "_switched", limits)
    reason = (
        F.when(F.col("_total") >= limits.max_total_pages, F.lit(f"Total page limit reached ({limits.max_total_pages})"))
        .when(minutes >= limits.max_execution_time_minutes,
              F.lit(f"Execution time limit reached ({limits.max_execution_time_minutes} minutes)"))
        .when(block.isNotNull(), F.concat(F.lit("Domain blocked: "), block))
        .when(F.col("_pages") >= limits.max_pages_per_domain,
              F.lit(f"Domain page limit reached ({limits.max_pages_per_domain} pages)"))
        .when(wait > 0, F.concat(F.lit("Rate limit: wait "), F.format_string("%.1f", F.bround(wait, 1)), F.lit("s"))))
    return both.withColumn("reason", reason).select(*log.columns, F.col("reason").isNull().alias("allowed"), "reason")


def size_budget(log: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """May each download still fit the page, session and domain sizes? Adds ``allowed``, ``reason``."""
    both = running(log, ORDER, ["domain"], sums={"_domain": _success_bytes()}, overall=Looks(sums={"_total": _success_bytes()}))
    mb = F.col("bytes") / BYTES_PER_MB
    share = limits.max_total_size_mb * 0.5
    reason = (
        F.when(mb > limits.max_page_size_mb, F.concat(
            F.lit("Page size ("), F.format_string("%.2f", F.bround(mb, 2)),
            F.lit(f"MB) exceeds limit ({limits.max_page_size_mb}MB)")))
        .when(F.col("_total") / BYTES_PER_MB + mb > limits.max_total_size_mb,
              F.lit(f"Total size limit would be exceeded ({limits.max_total_size_mb}MB)"))
        .when(F.col("_domain") / BYTES_PER_MB + mb > share,
              F.lit(f"Domain size limit would be exceeded ({share}MB)")))
    return both.withColumn("reason", reason).select(*log.columns, F.col("reason").isNull().alias("allowed"), "reason")


def rate_gap(log: DataFrame, min_delay_seconds: float = 1.0) -> DataFrame:
    """Seconds each request should have waited for its domain. Adds ``gap`` and ``wait``."""
    seen = running(log, ORDER, ["domain"], latest={"_last": _real("ts")})
    gap = _gap_seconds("ts", "_last")
    return seen.withColumn("gap", gap).withColumn(
        "wait", F.coalesce(F.greatest(F.lit(0.0), F.lit(float(min_delay_seconds)) - F.col("gap")), F.lit(0.0))).drop("_last")


def domain_block(log: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Blocked domains: (domain, blocked_at, block_event, failures, reason).

    The reason names the count at the end of the log, as each later failure renews the block.
    """
    n = limits.max_retry_attempts
    failures = log.filter("kind = 'failure'").select("domain", "ts", "event_id")
    w = W.partitionBy("domain").orderBy(*ORDER)
    # ranks over n are cut before the shuffle, so a hot domain sends n rows per input partition
    nth = failures.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).filter(F.col("_rn") == n)
    counts = failures.groupBy("domain").agg(F.count(F.lit(1)).alias("failures"))
    return nth.join(counts, "domain").select(
        "domain", F.col("ts").alias("blocked_at"), F.col("event_id").alias("block_event"), "failures",
        F.concat(F.lit("Too many failures ("), F.col("failures").cast("string"), F.lit(")")).alias("reason"))


def domain_unblock(log: DataFrame) -> DataFrame:
    """Block state per domain after its last block or unblock event."""
    events = log.filter("kind IN ('block', 'unblock')")
    last = events.groupBy("domain").agg(F.max(F.struct(*ORDER, "kind")).alias("l"))
    return last.select("domain", (F.col("l.kind") == "block").alias("blocked"), F.col("l.ts").alias("since"))


def domain_stats(log: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """pages, bytes, failures, last request and block state per domain."""
    return _domain_stats(_per_domain(log), limits)


def _domain_stats(domains: DataFrame, limits: Limits) -> DataFrame:
    block = _block_reason(F.col("bad"), "_failed_at", "_switched", limits)
    return domains.select("domain", F.col("good").alias("pages_scraped"), F.col("size").alias("total_bytes"), F.col("last").alias("last_request_time"),
                          F.col("bad").alias("failed_requests"), block.isNotNull().alias("blocked"))


def session_stats(log: DataFrame) -> DataFrame:
    """One row of totals for the whole log."""
    return _session(_per_domain(log))


def _per_domain(log: DataFrame) -> DataFrame:
    """One row per domain with all that totals of a domain or of the log are made of."""
    return log.groupBy("domain").agg(
        F.sum(_is("success")).alias("good"), F.sum(_is("failure")).alias("bad"), F.sum(_is("blocked")).alias("refused"),
        F.sum(_success_bytes()).alias("size"), F.max(_real("ts")).alias("last"), F.max(_failed_at()).alias("_failed_at"),
        F.max(_switched()).alias("_switched"), F.min("ts").alias("begin"), F.max("ts").alias("end"))


def _session(domains: DataFrame) -> DataFrame:
    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))
    return domains.agg(
        F.min("begin").alias("start_time"), total("good").alias("total_pages_scraped"), total("size").alias("total_bytes_downloaded"),
        total("good").alias("successful_requests"), total("bad").alias("failed_requests"), total("refused").alias("blocked_requests"),
        F.count(F.when(F.col("last").isNotNull(), F.col("domain"))).alias("domains_accessed"),
        F.coalesce((F.max(_micros("end")) - F.min(_micros("begin"))) / F.lit(6e7), F.lit(0.0)).alias("elapsed_minutes"))


def capacity(log: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """What is left of pages, megabytes and minutes, and the shares used."""
    return _capacity(session_stats(log), limits)


def _capacity(totals: DataFrame, limits: Limits) -> DataFrame:
    mb = F.col("total_bytes_downloaded") / BYTES_PER_MB
    pages, minutes = F.col("total_pages_scraped"), F.col("elapsed_minutes")
    return totals.select(
        F.greatest(F.lit(0).cast("long"), F.lit(limits.max_total_pages) - pages).alias("pages_remaining"),
        F.greatest(F.lit(0.0), F.lit(float(limits.max_total_size_mb)) - mb).alias("mb_remaining"),
        F.greatest(F.lit(0.0), F.lit(float(limits.max_execution_time_minutes)) - minutes).alias("minutes_remaining"),
        (pages / limits.max_total_pages * 100).alias("percent_pages_used"),
        (mb / limits.max_total_size_mb * 100).alias("percent_size_used"),
        (minutes / limits.max_execution_time_minutes * 100).alias("percent_time_used"))


def _stop_reason(pages: Column, size: Column, minutes: Column, good: Column, bad: Column, limits: Limits) -> Column:
    rate = bad / (good + bad)
    return (F.when(pages >= limits.max_total_pages, F.lit("Total page limit reached"))
            .when(size / BYTES_PER_MB >= limits.max_total_size_mb, F.lit("Total size limit reached"))
            .when(minutes >= limits.max_execution_time_minutes, F.lit("Execution time limit reached"))
            .when((good + bad >= 10) & (rate > 0.8), F.concat(
                F.lit("High failure rate ("), F.format_string("%.1f", F.bround(rate * 100, 1)), F.lit("%)"))))


def stop_check(log: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Should the session stop, seen from the end of the log? (should_stop, reason)"""
    reason = _stop_reason(F.col("total_pages_scraped"), F.col("total_bytes_downloaded"), F.col("elapsed_minutes"),
                          F.col("successful_requests"), F.col("failed_requests"), limits)
    return session_stats(log).select(reason.alias("reason")).select(F.col("reason").isNotNull().alias("should_stop"), "reason")


def first_stop(log: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """First event after which the session should have stopped: (event_id, ts, reason)."""
    seen = running(log, ORDER, sums={"_good": _is("success"), "_bad": _is("failure"), "_size": _success_bytes()},
                   earliest={"_start": F.col("ts")})
    good, bad = F.col("_good") + _is("success"), F.col("_bad") + _is("failure")
    reason = _stop_reason(good, F.col("_size") + _success_bytes(), _gap_seconds("ts", "_start") / 60, good, bad, limits)
    stops = seen.withColumn("reason", reason).filter("reason IS NOT NULL")
    first = stops.agg(F.min(F.struct(*ORDER, "reason")).alias("s")).filter("s IS NOT NULL")
    return first.select("s.event_id", "s.ts", "s.reason")


def limit_summary(log: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Settings, totals, capacity and every domain as rows (section, name, metric, value).

    Long form instead of one nested row: the number of domains grows with the log.
    """
    def melt(df: DataFrame, section: str, metrics: list[str], name: Column) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
        return df.select(F.lit(section).alias("section"), name.alias("name"), pairs.alias("p")).select("section", "name", "p.*")

    # the log is read once; its domains are few beside its rows
    known = durable(_per_domain(log), "domains")
    session = _session(known)
    settings = ["max_total_pages", "max_pages_per_domain", "max_total_size_mb", "max_execution_time_minutes"]
    totals = session.withColumns({
        "total_mb_downloaded": F.col("total_bytes_downloaded") / BYTES_PER_MB,
        "success_rate": F.col("successful_requests") / F.greatest(
            F.lit(1).cast("long"), F.col("successful_requests") + F.col("failed_requests")) * 100})
    stats = ["elapsed_minutes", "total_pages_scraped", "total_mb_downloaded", "successful_requests", "failed_requests",
             "blocked_requests", "domains_accessed", "success_rate"]
    left = _capacity(session, limits)
    domains = _domain_stats(known, limits).select(
        "domain", F.col("pages_scraped").alias("pages"), (F.col("total_bytes") / BYTES_PER_MB).alias("mb"),
        F.col("failed_requests").alias("failed"), "blocked")
    none = F.lit("")
    config = log.sparkSession.range(1).select(*[F.lit(float(getattr(limits, s))).alias(s) for s in settings])
    return (melt(config, "config", settings, none)
            .unionByName(melt(totals, "stats", stats, none))
            .unionByName(melt(left, "capacity", left.columns, none))
            .unionByName(melt(domains, "domains", ["pages", "mb", "failed", "blocked"], F.col("domain"))))


def scrape_stats(log: DataFrame) -> DataFrame:
    """Request totals and success rate of a fetch log; every success or failure is a request."""
    good = F.coalesce(F.sum(_is("success")), F.lit(0))
    bad = F.coalesce(F.sum(_is("failure")), F.lit(0))
    done = log.agg(good.alias("successful_requests"), bad.alias("failed_requests"),
                   F.coalesce(F.sum(F.when(F.col("kind").isin("success", "failure"), F.col("bytes"))), F.lit(0)).alias("total_bytes_downloaded"))
    total = F.col("successful_requests") + F.col("failed_requests")
    return done.select(
        total.alias("total_requests"), "successful_requests", "failed_requests",
        F.when(total > 0, F.col("successful_requests") / total * 100).otherwise(0.0).alias("success_rate"),
        "total_bytes_downloaded", (F.col("total_bytes_downloaded") / BYTES_PER_MB).alias("total_mb_downloaded"))
