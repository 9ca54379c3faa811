"""Crawl evidence in the shape the graph rules and reads expect, from the delivered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlmill.sources.tables import table

PAGE_FIELDS = ("page_id", "title", "meta_description", "canonical_url", "robots_directives", "content_hash", "status_code", "depth", "extraction_mode", "text_length")


def pages(spark: SparkSession, sf: str, *fields: str) -> DataFrame:
    """One row per crawl and url: the latest extraction, then the largest page. Only ``fields`` are carried."""
    names = fields or PAGE_FIELDS
    rows = table(spark, sf, "page_record", "crawl_id", "url", "extracted_at", *{"page_id", *names})
    latest = rows.groupBy("crawl_id", "url").agg(F.max_by(F.struct(*names), F.struct("extracted_at", "page_id")).alias("p"))
    return latest.select("crawl_id", "url", "p.*")


def links(spark: SparkSession, sf: str, *fields: str) -> DataFrame:
    """Edges, each delivered once: crawl, link, and ``fields``.

    A row delivered twice is equal in every column, so a hash aggregation over the columns used is enough; filters
    on them pass through it to the scan.
    """
    names = fields or ("source_url", "target_url", "anchor_text", "rel", "kind")
    return table(spark, sf, "link_record", "crawl_id", "link_id", *names).distinct()


def discovered(spark: SparkSession, sf: str) -> DataFrame:
    """Frontier rows, each delivered once."""
    return table(spark, sf, "discovery", "crawl_id", "crawl_url_id", "url", "depth", "discovery_kind", "discovered_from").distinct()


SQL = """
  page AS (SELECT crawl_id, url, page_id, title, meta_description, canonical_url, robots_directives, content_hash, status_code, depth, extraction_mode, text_length
      FROM page_record QUALIFY row_number() OVER (PARTITION BY crawl_id, url ORDER BY extracted_at DESC, page_id DESC) = 1),
  link AS (SELECT DISTINCT crawl_id, link_id, source_url, target_url, anchor_text, rel, kind FROM link_record),
  found AS (SELECT DISTINCT crawl_id, crawl_url_id, url, depth, discovery_kind, discovered_from FROM discovery)
"""
