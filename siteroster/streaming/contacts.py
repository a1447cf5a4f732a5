"""Contacts from pages as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteroster.operators.contacts import email_rows, page_emails
from siteroster.operators.pages import page_ok


def stream_contacts(pages: DataFrame, min_confidence: float = 0.7, watermark: str = "1 hour") -> DataFrame:
    """(url, scraped_at, email, domain, confidence), each address once per url.

    ``pages`` streams url, html, status_code and scraped_at (a TIMESTAMP). The pair (url, email) is
    remembered until the watermark passes it, so state stays bounded; later repeats count as new.
    """
    found = page_emails(page_ok(pages.withWatermark("scraped_at", watermark)), min_confidence)
    rows = email_rows(found, ["url", "scraped_at"]).select("url", "scraped_at", "email", "domain", "confidence")
    return rows.dropDuplicatesWithinWatermark(["url", "email"])
