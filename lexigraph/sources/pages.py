"""Fetched web pages as documents; fetching itself is not the engine's work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_to_text, page_name


def page_documents(pages: DataFrame) -> DataFrame:
    """ref, name, content of pages (url, html); pages without content are left out."""
    return pages.where("html is not null").select(F.col("url").alias("ref"), page_name("url").alias("name"), html_to_text("html").alias("content"))
