"""Registered queries. Importing this package fills the register."""

from siteroster.plans import contact_queries, crawl_queries, page_queries, storage_queries, text_queries  # noqa: F401
from siteroster.plans.registry import CHECKS, QUERIES  # noqa: F401
