"""Registered queries: sources of pages and HTML operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteroster.functions import html as H
from siteroster.functions import text as T
from siteroster.functions.fixed_values import VOID_TAGS
from siteroster.operators import pages as P
from siteroster.operators.rows import unnest
from siteroster.plans import check_sql as Q
from siteroster.plans.derived import CONTACT_PAGES, RAW_PAGES, URL_TEXTS, derive, table_sql
from siteroster.plans.registry import query
from siteroster.session import scratch_path
from siteroster.sources.readers import read_pages, read_table, read_texts

ALL_PAGES = f"({table_sql(RAW_PAGES, CONTACT_PAGES)})"


def all_pages(spark, sf):
    """Captured pages of both kinds: (page_id, url, html, status_code)."""
    return derive(spark, sf, RAW_PAGES, CONTACT_PAGES, costly=True)


@query("src_raw_text", f"SELECT text FROM ({table_sql(URL_TEXTS)})")
def src_raw_text(spark, sf):
    path = scratch_path(spark, "texts")
    derive(spark, sf, URL_TEXTS).select("text").write.text(path)
    return read_texts(spark, path, whole_files=False).select("text")


@query("src_pages", f"SELECT url, status_code, length(html) AS chars, md5(html) AS digest FROM {ALL_PAGES}", ints="chars")
def src_pages(spark, sf):
    path = scratch_path(spark, "pages")
    all_pages(spark, sf).drop("page_id").write.json(path)
    return read_pages(spark, path, "json").select("url", "status_code", F.char_length("html").alias("chars"), F.md5("html").alias("digest"))


@query("src_decode", "SELECT doc_id, text || chr(65533) || ' end' AS text FROM documents")
def src_decode(spark, sf):
    dirty = F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"), F.unhex(F.lit("C3")),
                     F.encode(F.lit("\ufffd end"), "UTF-8"), F.unhex(F.lit("E282")))
    return read_table(spark, sf, "documents").select("doc_id", T.decode_utf8(dirty).alias("text"))


@query("page_size_guard", f"""SELECT page_id, CASE WHEN strlen(html) > 4000 THEN 0 ELSE length(html) END AS chars,
    CASE WHEN strlen(html) > 4000 THEN 'Page size exceeds limit (' || strlen(html) || ' bytes)' END AS error FROM {ALL_PAGES}""", ints="chars")
def page_size_guard(spark, sf):
    return P.page_size_guard(all_pages(spark, sf), 4000).select("page_id", F.char_length("html").alias("chars"), "error")


@query("page_ok", f"SELECT page_id, url FROM {ALL_PAGES} WHERE status_code = 200 AND html <> ''")
def page_ok(spark, sf):
    return P.page_ok(all_pages(spark, sf)).select("page_id", "url")


@query("page_text", f"SELECT page_id, {Q.page_text('html')} AS text FROM {ALL_PAGES}")
def page_text(spark, sf):
    return all_pages(spark, sf).select("page_id", H.page_text("html").alias("text"))


_M = f"(SELECT page_id, {Q.markup('html')} AS m FROM {ALL_PAGES})"


@query("page_title", f"""SELECT page_id, {Q.strip(Q.references(
    "coalesce(nullif(regexp_extract(m, '(?i)<title[^>]*>([^<]*)</title', 1), ''), nullif(regexp_extract(m, '<meta property=.og:title. content=.([^>]*).>', 1), ''), "
    "nullif(regexp_extract(m, '(?i)<h1[^>]*>([^<]*)</h1', 1), ''))"))} AS title FROM {_M}""")
def page_title(spark, sf):
    return all_pages(spark, sf).select("page_id", H.page_title("html").alias("title"))


@query("page_meta_desc", f"""SELECT page_id, nullif({Q.strip(Q.references("regexp_extract(m, '<meta name=.description. content=.([^>]*).>', 1)"))}, '') AS description FROM {_M}""")
def page_meta_desc(spark, sf):
    return all_pages(spark, sf).withColumn("meta", H.meta_entries("html")).select("page_id", H.meta_description("meta").alias("description"))


_ATTRS_A = "regexp_extract_all(m, '(?i)<a(\\s[^>]*)>', 1)"
LINKS = f"""SELECT page_id, url, target, row_number() OVER (PARTITION BY page_id ORDER BY min(i)) - 1 AS pos FROM (
    SELECT page_id, url, i, {Q.resolve('url', 'href')} AS target FROM (
      SELECT page_id, url, i, {Q.attribute('tag', 'href')} AS href FROM (
        SELECT page_id, url, unnest(l) AS tag, generate_subscripts(l, 1) AS i FROM (
          SELECT page_id, url, {_ATTRS_A} AS l FROM (SELECT page_id, url, {Q.markup('html')} AS m FROM {ALL_PAGES}))))
    WHERE href <> '' AND href NOT LIKE '#%' AND href NOT LIKE 'javascript:%' AND href NOT LIKE 'mailto:%')
  GROUP BY page_id, url, target"""


@query("page_links", f"SELECT url AS source, pos, target, page_id FROM ({LINKS})", ints="pos")
def page_links(spark, sf):
    return P.link_edges(all_pages(spark, sf), "url", keep=["page_id"])


_HEADINGS = " UNION ALL ".join(
    f"SELECT page_id, {n} AS level, unnest(l) AS inner_html, generate_subscripts(l, 1) AS i FROM (SELECT page_id, "
    f"regexp_extract_all(m, '(?is)<h{n}[^>]*>(.*?)</h{n}\\s*>', 1) AS l FROM {_M})" for n in range(1, 7))


@query("page_headings", f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY level, i) - 1 AS pos, heading FROM (
    SELECT page_id, level, i, {Q.element_text('inner_html')} AS heading FROM ({_HEADINGS})) WHERE length(heading) >= 10""", ints="pos")
def page_headings(spark, sf):
    return unnest(all_pages(spark, sf), ["page_id"], H.page_headings("html"), "heading")


_T = f"(SELECT page_id, {Q.page_text('html')} AS t FROM {ALL_PAGES})"


@query("page_word_count", f"SELECT page_id, {Q.word_count('t')} AS words FROM {_T}", ints="words")
def page_word_count(spark, sf):
    return all_pages(spark, sf).select("page_id", T.word_count(H.page_text("html")).alias("words"))


@query("page_valid", f"SELECT page_id, length(t) >= 10 AND ({Q.word_count('t')}) >= 10 AS valid FROM {_T}")
def page_valid(spark, sf):
    return all_pages(spark, sf).select("page_id", T.let(H.page_text("html"), H.is_valid_content).alias("valid"))


@query("page_meta", f"""SELECT page_id, CASE WHEN name LIKE 'og:%' THEN 'open_graph' WHEN name LIKE 'twitter:%' THEN 'twitter_card' ELSE 'meta_tags' END AS section,
    name, arg_max(value, i) AS value FROM (
      SELECT page_id, i, coalesce(nullif({Q.attribute('tag', 'name')}, ''), {Q.attribute('tag', 'property')}) AS name, {Q.attribute('tag', 'content')} AS value FROM (
        SELECT page_id, unnest(l) AS tag, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(m, '(?i)<meta(\\s[^>]*)>', 1) AS l FROM {_M})))
    WHERE name <> '' AND value <> '' GROUP BY page_id, name""")
def page_meta(spark, sf):
    return P.meta_rows(all_pages(spark, sf), "page_id")


@query("page_json_ld", f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, json_extract_string(j, '$.name') AS name FROM (
    SELECT page_id, unnest(l) AS j, generate_subscripts(l, 1) AS i FROM (
      SELECT page_id, regexp_extract_all(html, '(?s)<script type=.application/ld\\+json.>(.*?)</script>', 1) AS l FROM {ALL_PAGES})) WHERE json_valid(j)""", ints="pos")
def page_json_ld(spark, sf):
    rows = P.json_ld_rows(all_pages(spark, sf), "page_id")
    return rows.select("page_id", "pos", F.try_variant_get("data", "$.name", "string").alias("name"))


def _elements(tag: str) -> str:
    """Elements as a tree parser pairs them, tag by tag; ``open`` holds the numbers of the tags that are open, ``ended`` those a tag ends."""
    code = ("CASE WHEN regexp_extract(t, '^</?([a-zA-Z][^\\s/>]*)', 1) = '' OR lower(regexp_extract(t, '^</?([a-zA-Z][^\\s/>]*)', 1)) IN "
            f"({', '.join(Q.lit(v) for v in VOID_TAGS)}) OR (ends_with(t, '/>') AND NOT starts_with(t, '</')) THEN '' "
            "ELSE lower(regexp_extract(t, '^(</?[a-zA-Z][^\\s/>]*)', 1))[2:] END")
    return f"""WITH RECURSIVE page AS MATERIALIZED (
      SELECT page_id, list_transform(regexp_extract_all(m, '<[a-zA-Z/][^>]*>'), lambda t: {code}) AS codes,
        list_transform(regexp_split_to_array(m, '<[a-zA-Z/][^>]*>'), lambda n: {Q.strip(Q.references('n'))}) AS nodes
      FROM {_M} WHERE lower(m) LIKE '%<{tag}%'),
    walk AS (
      SELECT page_id, codes, 0 AS i, []::INTEGER[] AS open, []::INTEGER[] AS ended FROM page
      UNION ALL
      SELECT page_id, codes, i + 1,
        CASE WHEN i = len(codes) THEN [] WHEN hit > 0 THEN open[:hit - 1] WHEN codes[i + 1] <> '' AND codes[i + 1][1] <> '/' THEN list_append(open, i + 1) ELSE open END,
        CASE WHEN i = len(codes) THEN open WHEN hit > 0 THEN open[hit:] ELSE [] END
      FROM (SELECT *, CASE WHEN codes[i + 1][1] = '/' THEN coalesce(list_max(list_filter(range(1, len(open) + 1), lambda k: codes[open[k]] = codes[i + 1][2:])), 0) ELSE 0 END AS hit
        FROM walk WHERE i <= len(codes))),
    element AS (SELECT page_id, unnest(ended) AS first, i AS last FROM walk WHERE len(ended) > 0)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS pos, text FROM (
      SELECT page_id, first, array_to_string(nodes[first + 1:last], '') AS text FROM element JOIN page USING (page_id) WHERE codes[first] = '{tag}') WHERE length(text) >= 10"""


@query("page_elements", _elements("p"), ints="pos")
def page_elements(spark, sf):
    return P.element_rows(all_pages(spark, sf), "page_id", "p")


@query("page_elements_div", _elements("div"), ints="pos")
def page_elements_div(spark, sf):
    return P.element_rows(all_pages(spark, sf), "page_id", "div")


@query("page_elements_li", _elements("li"), ints="pos")
def page_elements_li(spark, sf):
    return P.element_rows(all_pages(spark, sf), "page_id", "li")


@query("page_parse", f"""SELECT page_id, length(t) AS chars, {Q.word_count('t')} AS word_count, coalesce(n, 0) AS links FROM {_T}
    LEFT JOIN (SELECT page_id AS k, count(*) AS n FROM ({LINKS}) GROUP BY 1) ON k = page_id""", ints="chars word_count links")
def page_parse(spark, sf):
    return P.parse_pages(all_pages(spark, sf)).select("page_id", F.char_length("text").alias("chars"), "word_count", F.size("links").alias("links"))
