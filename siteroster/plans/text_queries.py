"""Registered queries: URLs and column helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteroster.functions import text as T
from siteroster.functions import urls as U
from siteroster.operators import tables as O
from siteroster.operators.rows import fan_out, unnest
from siteroster.plans import check_sql as Q
from siteroster.plans.derived import ADDRESSES, URL_TEXTS, derive, table_sql
from siteroster.plans.registry import query
from siteroster.sources.readers import read_table

_TEXTS = f"({table_sql(URL_TEXTS)})"
_CLEANED = Q.clean_url("u")


@query("url_extract", f"""
    SELECT DISTINCT page_id, url FROM (SELECT page_id, {_CLEANED} AS url FROM (
      SELECT page_id, unnest(regexp_extract_all(text, {Q.lit('(' + Q.URL + ')')}, 1)) AS u FROM {_TEXTS}))
    WHERE url IS NOT NULL""")
def url_extract(spark, sf):
    return unnest(derive(spark, sf, URL_TEXTS), ["page_id"], U.extract_urls("text"), "url").drop("pos")


@query("url_clean", f"SELECT page_id, raw, {Q.clean_url('raw')} AS url FROM "
                    f"(SELECT page_id, '([' || url || '],' AS raw FROM pages UNION ALL "
                    f"SELECT page_id, '<www.' || split_part(url, '/', 3) || '/doc.Pdf;v=1>' FROM pages UNION ALL "
                    f"SELECT page_id, substr(url, 2) FROM pages)")
def url_clean(spark, sf):
    pages = read_table(spark, sf, "pages")
    raw = F.explode(F.array(F.concat(F.lit("(["), "url", F.lit("],")),
                            F.concat(F.lit("<www."), F.split_part("url", F.lit("/"), F.lit(3)), F.lit("/doc.Pdf;v=1>")),
                            F.substring("url", F.lit(2), F.length("url"))))
    return pages.select("page_id", raw.alias("raw")).withColumn("url", U.clean_url("raw"))


@query("url_valid", f"SELECT page_id, url, {Q.valid_url('url')} AS valid FROM (SELECT page_id, url FROM pages UNION ALL "
                    f"SELECT page_id, 'ftp' || substr(url, 5) FROM pages UNION ALL SELECT page_id, 'HTTP:' || url FROM pages "
                    f"UNION ALL SELECT page_id, split_part(url, '//', 2) FROM pages)")
def url_valid(spark, sf):
    variants = F.explode(F.array("url", F.concat(F.lit("ftp"), F.substring("url", F.lit(5), F.length("url"))), F.concat(F.lit("HTTP:"), "url"),
                                 F.split_part("url", F.lit("//"), F.lit(2))))
    return read_table(spark, sf, "pages").select("page_id", variants.alias("url")).withColumn("valid", U.is_valid_url("url"))


@query("url_domain", f"SELECT page_id, lower({Q.part('url', 2)}) AS domain FROM (SELECT page_id, upper(url) || ':80' AS url FROM pages "
                     f"UNION ALL SELECT page_id, url FROM pages)")
def url_domain(spark, sf):
    both = F.explode(F.array(F.concat(F.upper("url"), F.lit(":80")), "url"))
    return read_table(spark, sf, "pages").select("page_id", both.alias("url")).select("page_id", U.url_domain("url").alias("domain"))


@query("url_base_domain", f"SELECT page_id, host, array_to_string(string_split(host, '.')[-2:], '.') AS base FROM "
                          f"(SELECT page_id, lower({Q.part('url', 2)}) AS host FROM pages UNION ALL SELECT page_id, 'local' || page_id FROM pages)")
def url_base_domain(spark, sf):
    hosts = F.explode(F.array(U.url_domain("url"), F.concat(F.lit("local"), F.col("page_id").cast("string"))))
    return read_table(spark, sf, "pages").select("page_id", hosts.alias("host")).withColumn("base", U.base_domain("host"))


@query("url_normalize", f"""
    SELECT page_id, url, {Q.scheme('url')} || '://' || lower({Q.part('url', 2)}) || rtrim({Q.path('url')}, '/')
      || CASE WHEN {Q.part('url', 4)} <> '' THEN '?' || {Q.part('url', 4)} ELSE '' END AS normal
    FROM (SELECT page_id, url FROM pages UNION ALL
          SELECT page_id, 'HTTPS://WWW.Shop' || page_id || '.COM/A/B;v=' || page_id || '//' FROM pages UNION ALL
          SELECT page_id, 'http://A' || page_id || '.de/x;p=1?q=' || page_id || '#f' FROM pages)""")
def url_normalize(spark, sf):
    n = F.col("page_id").cast("string")
    urls = F.explode(F.array("url", F.concat(F.lit("HTTPS://WWW.Shop"), n, F.lit(".COM/A/B;v="), n, F.lit("//")),
                             F.concat(F.lit("http://A"), n, F.lit(".de/x;p=1?q="), n, F.lit("#f"))))
    return read_table(spark, sf, "pages").select("page_id", urls.alias("url")).withColumn("normal", U.normalize_url("url"))


@query("url_root", "SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS root FROM pages")
def url_root(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", U.url_root("url").alias("root"))


_HREFS = ("SELECT page_id, url, unnest(['/p' || page_id, 'rel/' || page_id, '?q=' || page_id, '//cdn.net/' || page_id, 'tel:' || page_id, "
          "'https://abs.org/' || page_id, 'x#f']) AS href FROM pages")


@query("url_resolve", f"SELECT page_id, href, {Q.resolve('url', 'href')} AS target FROM ({_HREFS})")
def url_resolve(spark, sf):
    n = F.col("page_id").cast("string")
    hrefs = F.array(F.concat(F.lit("/p"), n), F.concat(F.lit("rel/"), n), F.concat(F.lit("?q="), n), F.concat(F.lit("//cdn.net/"), n),
                    F.concat(F.lit("tel:"), n), F.concat(F.lit("https://abs.org/"), n), F.lit("x#f"))
    return read_table(spark, sf, "pages").select("page_id", "url", F.explode(hrefs).alias("href")).select(
        "page_id", "href", U.resolve_url("url", "href").alias("target"))


# --- column helpers --------------------------------------------------------------------------

_NOISY = "chr(160) || text || chr(9) || chr(10) || ' ' || chr(8195) || lang || chr(10)"


def _noisy(spark, sf):
    return fan_out(read_table(spark, sf, "documents")).select("doc_id", F.concat(
        F.lit("\xa0"), "text", F.lit("\t\n  "), "lang", F.lit("\n")).alias("text"))


@query("clean_text", f"SELECT doc_id, {Q.squeeze('t')} AS text, {Q.strip('t')} AS kept FROM (SELECT doc_id, {_NOISY} AS t FROM documents)")
def clean_text(spark, sf):
    nul = F.concat(F.lit("\x00"), "text")
    return _noisy(spark, sf).select("doc_id", T.clean_text(nul).alias("text"), T.clean_text(nul, False).alias("kept"))


@query("normalize_ws", f"SELECT doc_id, {Q.squeeze('t')} AS text FROM (SELECT doc_id, {_NOISY} AS t FROM documents)")
def normalize_ws(spark, sf):
    return _noisy(spark, sf).select("doc_id", T.normalize_whitespace("text").alias("text"))


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 77) || '...' ELSE text END AS short FROM documents")
def truncate_text(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.truncate_text("text", 80).alias("short"))


@query("dedup_by_key", "SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER "
                       "(PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) = 1")
def dedup_by_key(spark, sf):
    items = read_table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    return O.dedup_by_key(items, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).drop("l_shipdate")


@query("chunk_rows", """
    SELECT event_type, CAST(floor(i / 100) AS BIGINT) AS chunk, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY i) AS ids
    FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events)
    GROUP BY 1, 2""")
def chunk_rows(spark, sf):
    chunks = O.chunk_rows(read_table(spark, sf, "events"), "event_id", 100, ["ts", "event_id"], ["event_type"])
    return chunks.select("event_type", "chunk", F.concat_ws(",", F.transform("items", lambda x: x.cast("string"))).alias("ids"))


@query("flatten_rows", """
    SELECT conv_id, turn, unnest(w) AS item, generate_subscripts(w, 1) - 1 AS pos FROM (
      SELECT conv_id, turn, flatten(list_transform(string_split(text, chr(10)), lambda x: string_split(x, ' '))) AS w FROM conversations)""", ints="pos")
def flatten_rows(spark, sf):
    nested = fan_out(read_table(spark, sf, "conversations")).select(
        "conv_id", "turn", F.transform(F.split("text", "\n", -1), lambda x: F.split(x, " ", -1)).alias("nested"))
    return O.flatten_rows(nested, "nested")


@query("hash_text", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def hash_text(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", *[T.hash_text("text", a).alias(a) for a in ("md5", "sha1", "sha256")])


@query("json_parse_safe", "SELECT event_id, coalesce(CAST(json_extract(j, '$.k') AS BIGINT), -1) AS k FROM (SELECT event_id, CASE WHEN "
                          "json_valid(p) THEN p END AS j FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN substr(props, 2) ELSE props END AS p FROM events))")
def json_parse_safe(spark, sf):
    props = F.when(F.col("event_type") == "error", F.substring("props", F.lit(2), F.length("props"))).otherwise(F.col("props"))
    default = F.struct(F.lit(-1).cast("long").alias("k"))
    return read_table(spark, sf, "events").select("event_id", T.json_parse_safe(props, "k long", default)["k"].alias("k"))


@query("json_dump_safe", """SELECT event_id, CASE WHEN event_type = 'error' THEN '{}' ELSE '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' END AS json FROM events""")
def json_dump_safe(spark, sf):
    value = F.when(F.col("event_type") != "error", F.struct("user_id", "event_type"))
    return read_table(spark, sf, "events").select("event_id", T.json_dump_safe(value).alias("json"))


@query("ts_format", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events")
def ts_format(spark, sf):
    return read_table(spark, sf, "events").select("event_id", T.format_timestamp("ts").alias("text"))


@query("ts_parse", "SELECT event_id, strftime(try_strptime(t, '%Y-%m-%d %H:%M:%S'), '%Y/%m/%d %H.%M.%S') AS parsed FROM "
                   "(SELECT event_id, CASE WHEN event_type = 'error' THEN 'at ' ELSE '' END || strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events)")
def ts_parse(spark, sf):
    text = F.concat(F.when(F.col("event_type") == "error", "at ").otherwise(""), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return read_table(spark, sf, "events").select("event_id", T.format_timestamp(T.parse_timestamp(text), "yyyy/MM/dd HH.mm.ss").alias("parsed"))


@query("elapsed_text", """
    SELECT event_id, CASE WHEN us >= 3600000000 THEN printf('%dh %dm %ds', us // 3600000000, us % 3600000000 // 60000000, us % 60000000 // 1000000)
      WHEN us >= 60000000 THEN printf('%dm %ds', us // 60000000, us % 60000000 // 1000000) ELSE printf('%.1fs', us / 1000000) END AS elapsed
    FROM (SELECT event_id, epoch_us(ts) - epoch_us(CASE event_type WHEN 'error' THEN TIMESTAMP '2023-12-31 22:30:00' WHEN 'view'
      THEN date_trunc('hour', ts) ELSE date_trunc('minute', ts) END) AS us FROM events)""")
def elapsed_text(spark, sf):
    start = (F.when(F.col("event_type") == "error", F.lit("2023-12-31 22:30:00").cast("timestamp"))
             .when(F.col("event_type") == "view", F.date_trunc("hour", "ts").cast("timestamp"))
             .otherwise(F.date_trunc("minute", "ts").cast("timestamp")))
    return read_table(spark, sf, "events").select("event_id", T.elapsed_text(start, "ts").alias("elapsed"))


@query("pct", """SELECT c_nationkey, CASE WHEN total = 0 THEN 0 ELSE round(owed / total::DOUBLE * 100, 2) END AS share FROM (
    SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal < 0) AS owed, count(*) FILTER (WHERE c_mktsegment <> 'BUILDING' OR c_nationkey > 2) AS total
    FROM customer GROUP BY 1)""")
def pct(spark, sf):
    counts = read_table(spark, sf, "customer").groupBy("c_nationkey").agg(
        F.count_if(F.col("c_acctbal") < 0).alias("owed"),
        F.count_if((F.col("c_mktsegment") != "BUILDING") | (F.col("c_nationkey") > 2)).alias("total"))
    return counts.select("c_nationkey", T.percentage("owed", "total").alias("share"))


@query("summary_stats", """SELECT l_returnflag, count(l_extendedprice) AS "count", min(l_extendedprice) AS "min", max(l_extendedprice) AS "max",
    round(avg(l_extendedprice), 4) AS mean, median(l_extendedprice) AS median, round(sum(l_extendedprice), 2) AS "sum" FROM lineitem GROUP BY 1""")
def summary_stats(spark, sf):
    items = read_table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    return O.summary_stats(items, "l_extendedprice", ["l_returnflag"]).withColumns(
        {"mean": F.round("mean", 4), "sum": F.round("sum", 2)})


@query("summary_stats_all", """SELECT count(value) AS "count", min(value) AS "min", max(value) AS "max",
    round(avg(value), 6) AS mean, median(value) AS median, round(sum(value), 2) AS "sum" FROM events""")
def summary_stats_all(spark, sf):
    return O.summary_stats(read_table(spark, sf, "events").select("value"), "value").withColumns(
        {"mean": F.round("mean", 6), "sum": F.round("sum", 2)})


_ADDR = f"({table_sql(ADDRESSES)})"


@query("fmt_standard", f"""SELECT row_number() OVER (ORDER BY id) AS "index", email, {Q.username('email')} AS username, {Q.domain('email')} AS domain
    FROM (SELECT id, CASE WHEN id % 10 = 7 THEN replace(email, '@', ' ') ELSE email END AS email FROM {_ADDR})""")
def fmt_standard(spark, sf):
    some = F.when(F.col("id") % 10 == 7, F.replace("email", F.lit("@"), F.lit(" "))).otherwise(F.col("email"))
    return O.standard_format(derive(spark, sf, ADDRESSES).select("id", some.alias("email")), "email", ["id"], with_time=False)
