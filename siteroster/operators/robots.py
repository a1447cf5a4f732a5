"""Stored robots.txt bodies as rules, and their use on URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteroster.functions.text import strip
from siteroster.functions.urls import full_path, netloc, query
from siteroster.operators.tables import HOT_ROWS, skew_safe_lookup


def _unquote(c):
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def robots_rules(robots: DataFrame, agent: str = "mozilla") -> DataFrame:
    """Rules that hold for one agent: a row (host, rules, delay) per host with a usable file.

    ``robots`` is (host, status_code, body) and may have ``fetched_at``: of several usable files of a host the latest
    holds (without times, or at equal ones, the greatest body). Groups follow the usual reading: agent lines in a row
    share the rules after them, an empty line ends a group, a group naming the agent wins over ``*``.
    """
    token = agent.split("/")[0].lower()
    usable = robots.filter("status_code = 200 AND body IS NOT NULL")
    age = ["fetched_at"] if "fetched_at" in robots.columns else []
    lines = (usable.groupBy("host").agg(F.max(F.struct(*age, "body"))["body"].alias("body"))
             .select("host", F.posexplode_outer(F.split("body", r"\r\n|\r|\n", -1)).alias("pos", "raw")))
    text = strip(F.regexp_replace("raw", "#.*", ""))
    parsed = lines.select(
        "host", "pos", (F.col("raw") == "").alias("blank"),
        F.lower(strip(F.regexp_extract(text, "^([^:]*):", 1))).alias("name"),
        _unquote(strip(F.regexp_replace(text, "^[^:]*:", ""))).alias("value"))
    kind = (F.when(F.col("blank"), "end").when(F.col("name") == "user-agent", "agent")
            .when(F.col("name").isin("disallow", "allow", "crawl-delay", "request-rate"), "rule"))
    # The lines of one host are one file, so these windows stay as small as that file.
    by_line = W.partitionBy("host").orderBy("pos")
    known = parsed.withColumn("kind", kind).filter("kind IS NOT NULL")
    starts = known.withColumn("_start", ((F.col("kind") == "agent") & (
        F.coalesce(F.lag("kind").over(by_line), F.lit("end")) != "agent")).cast("int"))
    up_to = by_line.rowsBetween(W.unboundedPreceding, 0)
    grouped = starts.select(
        "*", F.sum("_start").over(up_to).alias("grp"),
        F.max(F.when(F.col("kind") == "agent", F.col("pos"))).over(up_to).alias("_agent"),
        F.max(F.when(F.col("kind") == "end", F.col("pos"))).over(up_to).alias("_end"))
    alive = grouped.filter(F.col("_agent").isNotNull() & (
        F.col("_end").isNull() | (F.col("_agent") > F.col("_end"))))
    name = F.lower("value")
    is_rule = F.col("kind") == "rule"
    groups = alive.groupBy("host", "grp").agg(
        F.max(is_rule).alias("has_rules"),
        F.max((F.col("kind") == "agent") & (F.col("value") == "*")).alias("any_agent"),
        F.max((F.col("kind") == "agent") & F.lit(token).contains(name)).alias("named"),
        F.sort_array(F.collect_list(F.when(F.col("name").isin("disallow", "allow"), F.struct(
            "pos", ((F.col("name") == "allow") | (F.col("value") == "")).alias("allow"),
            F.col("value").alias("path"))))).alias("rules"),
        F.max_by(F.when(F.col("name") == "crawl-delay", F.col("value")),
                 F.when((F.col("name") == "crawl-delay") & F.col("value").rlike("^[0-9]+$"), F.col("pos")))
        .alias("delay"))
    rank = F.when(F.col("named") & ~F.col("any_agent"), 0).when(F.col("any_agent"), 1)
    fit = groups.filter("has_rules").withColumn("_rank", rank).filter("_rank IS NOT NULL")
    chosen = fit.groupBy("host").agg(F.min_by(
        F.struct("rules", F.col("delay").cast("double").alias("delay")), F.struct("_rank", "grp")).alias("g"))
    return chosen.select("host", "g.rules", "g.delay")


def robots_filter(urls: DataFrame, robots: DataFrame, url: str = "url", agent: str = "mozilla",
                  spread_by: list[str] | None = None) -> DataFrame:
    """Add ``allowed``: the first rule whose path starts the URL's decides; no file or no rule allows.

    Wildcards have no meaning in paths, so a rule for ``*`` fits nothing.

    ``spread_by`` names columns that tell rows of one host apart; by default the plain ones.
    """
    spread_by = spread_by or [f.name for f in urls.schema.fields if f.name != "html" and f.dataType.typeName() in (
        "string", "long", "integer", "timestamp", "timestamp_ntz", "date")]
    return apply_rules(urls, robots_rules(robots, agent), url, spread_by)


def apply_rules(urls: DataFrame, rules: DataFrame, url: str, spread_by: list[str], hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """``robots_filter`` with rules that are read already; without ``hot_rows`` no host is looked at for its size."""
    rules = rules.select(F.col("host").alias("_host"), "rules")
    target = _unquote(F.concat(full_path(url), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise("")))
    keyed = urls.withColumns({"_host": netloc(url), "_target": F.when(target == "", F.lit("/")).otherwise(target)})
    joined = skew_safe_lookup(keyed, rules, "_host", spread_by, hot_rows=hot_rows) if hot_rows else keyed.join(rules, "_host", "left")
    first = F.get(F.filter("rules", lambda r: F.col("_target").startswith(r["path"])), F.lit(0))
    return joined.withColumn("allowed", F.coalesce(first["allow"], F.lit(True))).drop("_host", "_target", "rules")


def robots_delay(hosts: DataFrame, robots: DataFrame, agent: str = "mozilla", host: str = "host") -> DataFrame:
    """Add ``crawl_delay`` in seconds per host; NULL when none is set or it is zero."""
    rules = robots_rules(robots, agent).select(F.col("host").alias(host), F.nullif("delay", F.lit(0.0)).alias("crawl_delay"))
    return hosts.join(rules, host, "left")


def blocked_pages(pages: DataFrame, robots: DataFrame, agent: str = "mozilla") -> DataFrame:
    """Pages as a fetcher that obeys robots.txt would hand them on: refused ones become 403."""
    checked = robots_filter(pages, robots, "url", agent)
    out = ~F.col("allowed")
    known = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    return checked.withColumns({
        "html": F.when(out, F.lit("")).otherwise(F.col("html")),
        "status_code": F.when(out, 403).otherwise(F.col("status_code")),
        "error": F.when(out, F.lit("Blocked by robots.txt")).otherwise(known)}).drop("allowed")
