"""Contact extraction over a table of texts or pages. Row-local: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteroster.functions import contacts as C
from siteroster.functions import html as H
from siteroster.operators.rows import once, unnest


def extract_contacts(df: DataFrame, text: str = "text", html: str | None = None, min_confidence: float = 0.0,
                     remove_duplicates: bool = True, plain_words: bool = True) -> DataFrame:
    """Add ``emails`` (array of structs), ``phone_numbers`` (array) and ``social`` (struct)."""
    if html is None:
        clean = once(df, {"_clean": C.deobfuscate(F.coalesce(F.col(text), F.lit("")), plain_words)})
        return once(clean, {"emails": C.email_hits("_clean", min_confidence, remove_duplicates), "phone_numbers": C.phone_numbers("_clean"),
                            "social": C.social_links("_clean")}).drop("_clean")
    found = contact_parts(df, text, html, min_confidence, remove_duplicates, plain_words)
    return once(found, {"emails": C.merge_hits("text_hits", "link_hits", remove_duplicates)}).drop("text_hits", "link_hits")


def contact_parts(df: DataFrame, text: str = "text", html: str = "html", min_confidence: float = 0.0,
                  remove_duplicates: bool = True, plain_words: bool = True) -> DataFrame:
    """As ``extract_contacts``, with the addresses of the text and of mailto links apart: ``text_hits``, ``link_hits``."""
    clean = once(df, {"_clean": C.deobfuscate(F.coalesce(F.col(text), F.lit("")), plain_words)})
    return once(clean, {
        "text_hits": C.email_hits("_clean", min_confidence, remove_duplicates), "link_hits": C.mailto_hits(F.coalesce(F.col(html), F.lit(""))),
        "phone_numbers": C.phone_numbers("_clean"), "social": C.social_links("_clean", html)}).drop("_clean")


def page_emails(pages: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Add ``emails`` to pages, and nothing else that ``extract_contacts`` finds."""
    clean = once(pages, {"_clean": C.deobfuscate(H.page_text("html"))})
    hits = once(clean, {"_hits": C.email_hits("_clean", min_confidence), "_mailto": C.mailto_hits(F.coalesce("html", F.lit("")))})
    return once(hits, {"emails": C.merge_hits("_hits", "_mailto")}).drop("_clean", "_hits", "_mailto")


def email_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per address out of ``extract_contacts``, in order of ``pos``."""
    return unnest(df, keys, "emails", "_e", "_p").select(*keys, "_e.*")
