"""Tables derived from the given ones, each defined once in SQL that Spark and DuckDB both run.

Every definition is (source table, {column: expression}); the whole source table is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteroster.operators.rows import spread
from siteroster.sources.readers import read_table

_SITE = "CAST(floor(c_custkey / 40) AS BIGINT)"
_PAGE = "(c_custkey % 40)"
_HOME = f"('https://site' || {_SITE} || '.com')"
_PHONE = "('+1 (555) 010-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))"

_MAIL = (
    "CASE WHEN c_custkey % 6 = 5 THEN '' "
    "WHEN c_custkey % 5 = 0 THEN ' ' || lower(c_mktsegment) || c_custkey || '@gmail.com' "
    f"WHEN c_custkey % 3 = 0 THEN ' sales [at] shop' || {_SITE} || ' [dot] com' "
    f"WHEN c_custkey % 3 = 1 THEN ' ar@shop' || {_SITE} || '.com, info@example.com' "
    f"ELSE ' Info@Shop' || {_SITE} || '.com and info@shop' || {_SITE} || '.com or logo@image.png' END"
)
_MANY = (
    f"CASE WHEN {_PAGE} = 3 THEN ' a1@x' || {_SITE} || '.org b22@x' || {_SITE} || '.org c333@x' || {_SITE} "
    f"|| '.org d444@x' || {_SITE} || '.org e555@x' || {_SITE} || '.org f666@x' || {_SITE} || '.org' ELSE '' END"
)
_MAILTO = (
    "CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN '<a href=\"mailto:desk' || c_custkey || '@desk' "
    f"|| c_nationkey || '.com?subject=hi\">Mail</a>' ELSE '<a href=\"mailto:info@shop' || {_SITE} || '.com\">Mail</a>' END"
)
_SOCIAL = (
    "CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN '<a href=\"https://www.facebook.com/c' || c_custkey || '\">f</a>' "
    "WHEN 2 THEN '<a href=\"https://x.com/c' || c_custkey || '\">x</a> twitter.com/late' "
    "WHEN 3 THEN '<a href=\"HTTP://instagram.com/c' || c_custkey || '\">i</a>' "
    "WHEN 4 THEN '<a href=\"https://linkedin.com/in\">l</a>' ELSE '<a href=\"//wa.me/1' || c_custkey || '\">w</a>' END"
)
_WORDS = (
    "CASE c_mktsegment WHEN 'BUILDING' THEN 'Real estate and property broker' "
    "WHEN 'MACHINERY' THEN 'industrial machinery, steel plant' WHEN 'AUTOMOBILE' THEN 'Corporate group, Inc' "
    "WHEN 'FURNITURE' THEN 'online store with cart' ELSE 'hotel rooms, cafe and health club' END"
)
_LINKS = (
    f"'<a href=\"/p' || (2 * {_PAGE} + 1) || '\">one</a><a href=\"p' || (2 * {_PAGE} + 2) || '\">two</a>"
    f"<a href=\"/p' || (2 * {_PAGE} + 1) || '\">again</a><a href=\"/\">home</a><a href=\"#top\">top</a>"
    f"<a href=\"?q=' || {_PAGE} || '&amp;r=1\">query</a><a href=\"javascript:go()\">js</a><a href=\"tel:123\">call</a>"
    f"<a href=\"https://other.example.net/\">other</a>'"
)

CONTACT_PAGES = ("customer", {
    "page_id": "c_custkey + 1000000",
    "url": f"CASE WHEN {_PAGE} = 0 THEN {_HOME} ELSE {_HOME} || '/p' || {_PAGE} END",
    "html": (
        "'<!DOCTYPE html><html lang=\"en\"><head>' "
        "|| CASE WHEN c_custkey % 3 = 0 THEN '<title>' || c_name || ' &amp; Co</title>' ELSE '' END "
        "|| '<meta name=\"description\" content=\"Shop of ' || c_name || '\"><meta name=\"robots\" content=\"a\">' "
        "|| CASE WHEN c_custkey % 3 = 1 THEN '<meta property=\"og:title\" content=\" OG ' || c_name || '\">' ELSE '' END "
        "|| '<meta name=\"robots\" content=\"index\"><meta content=\"summary\" name=\"twitter:card\">' "
        "|| '<script type=\"application/ld+json\">' || CASE WHEN c_custkey % 4 = 0 THEN '{bad' ELSE "
        "'{\"@type\":\"Organization\",\"name\":\"' || c_name || '\"}' END || '</script><style>p{}</style></head><body>' "
        "|| '<nav><a href=\"/about\">About</a></nav><h1>' || c_name || ' shop</h1><h2>Our <b>prices</b> today</h2><h2>Short</h2>' "
        f"|| '<p>' || {_WORDS} || '</p><p>Write to' || {_MAIL} || {_MANY} || ' today.</p><!-- note --><p>[ ] Call ' "
        f"|| CASE WHEN c_custkey % 7 = 0 THEN '' ELSE {_PHONE} END || '</p>' || {_MAILTO} || {_SOCIAL} || {_LINKS} "
        f"|| '<footer>&copy; footer@foot' || c_nationkey || '.com</footer></body></html>'"),
    "status_code": "CASE WHEN c_custkey % 11 = 0 THEN 404 ELSE 200 END",
})

RAW_PAGES = ("pages", {"page_id": "page_id", "url": "url", "html": "html", "status_code": "200"})

# Captures of the same pages from another time; every tenth is the later one.
OLD_PAGES = ("customer", {
    "page_id": "c_custkey + 2000000",
    "url": CONTACT_PAGES[1]["url"],
    "html": f"'<p>Write to old' || c_custkey || '@old' || {_SITE} || '.com</p><a href=\"/p' || (3 * {_PAGE} + 1) || '\">one</a>'",
    "status_code": "CASE WHEN c_custkey % 17 = 0 THEN 500 ELSE 200 END",
    "captured": "CAST(CASE WHEN c_custkey % 10 = 3 THEN 2 ELSE 0 END AS INT)",
})

SEEDS = ("customer", {
    "job_id": f"'job-' || {_SITE}",
    "seed": f"CASE WHEN {_PAGE} = 0 THEN {_HOME} || '/' ELSE {_HOME} || '/p' || {_PAGE} END",
    "mode": "CASE WHEN c_custkey % 4 = 0 THEN 'quick' ELSE 'deep' END",
})

PAGE_SEEDS = ("pages", {"job_id": "'pages-' || (page_id % 7)", "seed": "url", "mode": "CASE WHEN page_id % 3 = 0 THEN 'quick' ELSE 'deep' END"})

URL_TEXTS = ("pages", {
    "page_id": "page_id",
    "text": (
        "'see (' || url || '), ok. Or www.mirror' || page_id || '.org/a;b, <' || url || '> and "
        "https://files.example.com/' || page_id || '.PDF or https://t.co/x' || page_id || ' end http://a.bb.cc.d '"),
})

CRAWL_LOG = ("events", {
    "event_id": "event_id", "ts": "ts", "domain": "'d' || user_id || '.com'",
    "kind": ("CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'blocked' ELSE 'success' END"),
    "bytes": "CAST(round(value * 1000) AS BIGINT)",
})

# A crawl log in which domains are also blocked and unblocked by hand.
ADMISSION_LOG = ("events", {
    "event_id": "event_id", "ts": "ts", "domain": "'d' || user_id || '.com'",
    "kind": ("CASE WHEN event_id % 29 = 0 THEN 'unblock' WHEN event_id % 97 = 0 THEN 'block' WHEN event_type = 'error' THEN 'failure' "
             "WHEN event_type = 'signup' THEN 'blocked' ELSE 'success' END"),
    "bytes": "CAST(round(value * 1000) AS BIGINT)",
})

BLOCK_LOG = ("events", {
    "event_id": "event_id", "ts": "ts", "domain": "'d' || user_id || '.com'",
    "kind": "CASE event_type WHEN 'error' THEN 'block' WHEN 'purchase' THEN 'unblock' ELSE 'success' END",
    "bytes": "CAST(round(value * 1000) AS BIGINT)",
})

# Addresses of many shapes, built from suppliers' numbers and customers' segments.
ADDRESSES = ("customer", {
    "id": "c_custkey",
    "email": (
        "CASE c_custkey % 19 WHEN 0 THEN 'sales' WHEN 1 THEN 'support-help' WHEN 2 THEN 'newsletter' WHEN 3 THEN 'hr' "
        "WHEN 4 THEN 'recruit' WHEN 5 THEN 'billing.accounts' WHEN 6 THEN 'legal' WHEN 7 THEN 'vice president' WHEN 8 THEN 'Info' "
        "WHEN 9 THEN 'sugar' WHEN 10 THEN 'sales.order.shop' WHEN 11 THEN 'customer.care' WHEN 12 THEN 'promo.media' "
        "WHEN 13 THEN 'dev' WHEN 14 THEN 'x' WHEN 15 THEN 'contact.hello' WHEN 16 THEN 'accountspayable' "
        "WHEN 17 THEN 'ceo' ELSE 'c' || c_custkey END || '@' "
        "|| CASE c_custkey % 8 WHEN 0 THEN 'gmail' WHEN 1 THEN 'design-studio' WHEN 2 THEN 'cloudapp' WHEN 3 THEN 'state.gov' "
        "WHEN 4 THEN 'myshopstore' WHEN 5 THEN 'foundation' WHEN 6 THEN 'mail.yahoo' ELSE 'firm' || c_nationkey END "
        "|| CASE c_custkey % 5 WHEN 0 THEN '.org' WHEN 1 THEN '.edu' ELSE '.com' END"),
    "context": (
        "CASE c_custkey % 4 WHEN 0 THEN 'Please ask our Help desk for support and service about your order' "
        "WHEN 1 THEN 'Jobs and careers: hiring talent, recruitment by human resources' "
        "WHEN 2 THEN '' ELSE 'Quote, pricing, deals, offer, buy, purchase at our store or shop' END"),
    "site_text": f"c_name || ' ' || {_WORDS} || ' software platform tool, school and learning ' || c_mktsegment",
})

REQUESTS = ("customer", {
    "job_id": "'job-' || c_custkey",
    "input_data": (
        f"CASE WHEN c_custkey % 13 = 0 THEN 'abc' WHEN c_custkey % 13 = 1 THEN 'no links here' ELSE 'see ' || {_HOME} || "
        f"'/p' || {_PAGE} || ', thanks' END"),
    "mode": "CASE c_custkey % 5 WHEN 0 THEN 'quick' WHEN 1 THEN 'deep' WHEN 2 THEN 'custom' WHEN 3 THEN NULL ELSE 'turbo' END",
    "format": "CASE c_custkey % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'json' ELSE 'doc' END",
    "max_urls": "CAST(CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 60 END AS INT)",
    "max_depth": "CAST(c_custkey % 7 AS INT)",
    "timeout": "CAST(c_custkey % 70 AS INT)",
    "min_conf": "CAST(CASE WHEN c_custkey % 9 = 0 THEN 1.5 WHEN c_custkey % 3 = 1 THEN 0.75 WHEN c_custkey % 3 = 2 THEN 0.5 END AS DOUBLE)",
    "respect": "CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END",
})

# A robots.txt for each of the made-up shops.
SITE_ROBOTS = ("customer", {
    "host": f"'site' || {_SITE} || '.com'",
    "status_code": "200",
    "body": (f"CASE {_SITE} % 3 WHEN 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /p1' WHEN 1 THEN 'User-agent: *' || chr(10) || 'Allow: /p2' "
             f"|| chr(10) || 'Disallow: /p' ELSE '' END"),
})

# One robots.txt per host of the captured pages, in five shapes.
_HOST = "split_part(split_part(split_part(url, '/', 3), '?', 1), '#', 1)"
_SHAPE = f"(length({_HOST}) % 5)"
ROBOTS_PAGES = ("pages", {
    "host": _HOST,
    "status_code": f"CASE WHEN {_SHAPE} = 4 THEN 404 ELSE 200 END",
    "body": (
        f"CASE {_SHAPE} WHEN 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /en/' || chr(10) || 'Allow: /' || chr(10) || 'Crawl-delay: 2' "
        "WHEN 1 THEN '# nothing' || chr(10) || 'User-agent: otherbot' || chr(10) || 'User-agent: MOZILLA' || chr(10) || 'Allow: /en/6' || chr(10) "
        "|| 'Disallow: /en/ # most' || chr(10) || 'Disallow: /fr/' || chr(10) || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /' "
        "WHEN 2 THEN 'Disallow: /' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow:' || chr(10) || 'Crawl-delay: x' "
        "WHEN 3 THEN 'User-agent: *' || chr(10) || chr(10) || 'Disallow: /' || chr(10) || 'User-agent: bot' || chr(10) || 'Disallow: /' "
        "ELSE 'User-agent: *' || chr(10) || 'Disallow: /' END"),
})


def table_sql(*definitions) -> str:
    """SELECT of one definition, or UNION ALL of several, for DuckDB."""
    return " UNION ALL ".join(
        "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source}"
        for source, columns in definitions)


def derive(spark: SparkSession, sf_dir: str, *definitions, costly: bool = False) -> DataFrame:
    """The same rows in Spark. With ``costly`` the sources are spread before the columns are made of them."""
    read = (lambda source: spread(read_table(spark, sf_dir, source))) if costly else (lambda source: read_table(spark, sf_dir, source))
    parts = [read(source).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()]) for source, columns in definitions]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
