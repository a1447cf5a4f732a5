"""The contact report: one row per address, or one phone-only row for a page without any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteroster.functions import html as H
from siteroster.functions.categories import business_type
from siteroster.functions.fixed_values import REPORT_CONTEXT_CHARS
from siteroster.functions.urls import netloc
from siteroster.operators.contacts import contact_parts, extract_contacts
from siteroster.operators.pages import page_ok
from siteroster.operators.rows import once

NETWORKS = ["facebook", "instagram", "linkedin", "twitter", "whatsapp"]
REPORT_COLUMNS = ["email", "source_url", "domain", "confidence", "context", "phone_numbers",
                  "business_label", *NETWORKS]


def page_parts(pages: DataFrame) -> DataFrame:
    """Contacts and business label of each page that was fetched well, addresses of text and links apart."""
    text = once(page_ok(pages), {"text": H.page_text("html")})
    return once(contact_parts(text), {"business_label": business_type("text")}).drop("text", "html")


def page_contacts(pages: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Contacts and business label of each page that was fetched well."""
    text = once(page_ok(pages), {"text": H.page_text("html")})
    return once(extract_contacts(text, "text", "html", min_confidence), {"business_label": business_type("text")}).drop("text", "html")


def report_rows(found: DataFrame, keep: list[str] | None = None, limit: Column | str | None = None) -> DataFrame:
    """Flat report of ``page_contacts`` rows; ``limit`` is the number of addresses a page may give."""
    keep = keep or []
    emails = F.col("emails") if limit is None else F.slice("emails", 1, F.col(limit) if isinstance(limit, str) else limit)
    rows = (found.filter((F.size("emails") > 0) | (F.size("phone_numbers") > 0))
            .withColumn("_allowed", emails)
            .filter((F.size("_allowed") > 0) | (F.size("emails") == 0))
            .select(*keep, "url", "phone_numbers", "business_label", "social", F.explode_outer("_allowed").alias("_e")))
    text = {n: F.coalesce(F.col(f"social.{n}"), F.lit("")).alias(n) for n in NETWORKS}
    return rows.select(
        *keep, F.coalesce("_e.email", F.lit("")).alias("email"), F.col("url").alias("source_url"),
        F.coalesce("_e.domain", netloc("url")).alias("domain"),
        F.coalesce("_e.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce(F.left("_e.context", F.lit(REPORT_CONTEXT_CHARS)), F.lit("")).alias("context"),
        F.concat_ws(", ", "phone_numbers").alias("phone_numbers"), "business_label", *text.values())


def contact_report(pages: DataFrame, min_confidence: float = 0.7, keep: list[str] | None = None,
                   max_emails: int | None = None) -> DataFrame:
    """Report over captured pages, each page on its own."""
    limit = None if max_emails is None else F.lit(max_emails)
    return report_rows(page_contacts(pages, min_confidence), keep, limit)
