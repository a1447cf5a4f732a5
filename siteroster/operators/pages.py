"""Operators over a table of captured pages (url, html, ...). All are row-local: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteroster.functions import html as H
from siteroster.functions.fixed_values import MAX_PAGE_BYTES, MIN_TEXT_LENGTH
from siteroster.functions.text import word_count
from siteroster.operators.rows import once, unnest


def page_size_guard(pages: DataFrame, max_bytes: int = MAX_PAGE_BYTES) -> DataFrame:
    """Empty the html of pages over the size limit and say why in ``error``."""
    large = F.octet_length("html") > max_bytes
    known = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    return pages.withColumns({
        "error": F.when(large, F.concat(F.lit("Page size exceeds limit ("),
                                        F.octet_length("html").cast("string"), F.lit(" bytes)"))).otherwise(known),
        "html": F.when(large, F.lit("")).otherwise(F.col("html"))})


def page_ok(pages: DataFrame) -> DataFrame:
    """Pages worth parsing: status 200 and some html."""
    return pages.filter((F.col("status_code") == 200) & (F.col("html") != ""))


def parse_pages(pages: DataFrame, remove_nav: bool = True, extract_links: bool = True,
                extract_headings: bool = True, min_text_length: int = MIN_TEXT_LENGTH,
                keep_comments: bool = True, base_url: Column | str = "url") -> DataFrame:
    """Add text, title, meta_description, links, headings and word_count."""
    none = F.array().cast("array<string>")
    tidy = once(pages, {"_markup": H.markup("html"), "text": H.page_text("html", remove_nav, keep_comments)})
    m = F.col("_markup")
    parsed = once(once(tidy, {"_meta": H.meta_entries_in(m)}), {
        "title": H.title_in(m, "_meta"),
        "meta_description": H.meta_description("_meta"),
        "links": H.links_in(m, base_url) if extract_links else none,
        "headings": H.headings_in(m, min_text_length) if extract_headings else none})
    return parsed.withColumn("word_count", word_count("text")).drop("_meta", "_markup")


def link_edges(pages: DataFrame, source: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Edge table (source, pos, target) of the links of each page."""
    return unnest(pages, [*(keep or []), F.col(source).alias("source")], H.page_links("html", source), "target")


def meta_rows(pages: DataFrame, key: str) -> DataFrame:
    """Metadata of each page, one row per entry: (key, section, name, value)."""
    pairs = unnest(pages, [key], H.meta_pairs(H.meta_entries("html")), "m")
    return pairs.select(key, H.meta_group("m.key").alias("section"), F.col("m.key").alias("name"),
                        F.col("m.value").alias("value"))


def json_ld_rows(pages: DataFrame, key: str) -> DataFrame:
    """Linked data of each page as VARIANT, one row per script that parses."""
    return unnest(pages, [key], H.json_ld("html"), "json").withColumn("data", F.try_parse_json("json"))


def element_rows(pages: DataFrame, key: str, tag: str, min_text_length: int = MIN_TEXT_LENGTH) -> DataFrame:
    return unnest(pages, [key], H.element_texts("html", tag, min_text_length), "text")
