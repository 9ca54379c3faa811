"""Queries of the text operators and their SQL, merged into the driver's lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlmill.llm import boilerplate, format_duplicates, leakage, mixing, mojibake, spam
from crawlmill.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Field values of which a part was decoded with a wrong encoding."""
    return garbled(spark, sf).select("record_kind", "record_id", "field_name").distinct()


def garbled(spark: SparkSession, sf: str) -> DataFrame:
    """The garbled values with their repaired texts and the undone steps."""
    fields = F.explode(
        F.array(
            F.struct(F.lit("title").alias("field_name"), F.col("title").alias("value")),
            F.struct(F.lit("meta_description").alias("field_name"), F.col("meta_description").alias("value")),
        )
    ).alias("f")
    pages = table(spark, sf, "page_record", "page_id", "title", "meta_description").select(F.lit("page").alias("record_kind"), F.col("page_id").alias("record_id"), fields)
    pages = pages.select("record_kind", "record_id", "f.field_name", "f.value")
    links = table(spark, sf, "link_record", "link_id", "anchor_text").select(
        F.lit("link").alias("record_kind"), F.col("link_id").alias("record_id"), F.lit("anchor_text").alias("field_name"), F.col("anchor_text").alias("value")
    )
    keys = ["record_kind", "record_id", "field_name"]
    done = [mojibake.repair_column(x, keys, "value") for x in (pages, links)]
    return done[0].unionByName(done[1]).filter("garbled").select(*keys, "original", "repaired", "steps")


def p1_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Affected fields with their original text, one row a field value."""
    return garbled(spark, sf).distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Smallest page of each group of equal records, paired with each other page of the group."""
    members = format_duplicates.duplicate_members(*_p2_records(spark, sf)).filter("member_id <> first_id")
    return members.select(F.col("first_id").alias("first_page_id"), F.col("member_id").alias("copy_page_id"))


def _p2_records(spark: SparkSession, sf: str) -> tuple[DataFrame, str, str, str, str]:
    pages = table(spark, sf, "page_record", "crawl_id", "page_id", "title", "meta_description")
    return pages, "crawl_id", "page_id", "title", "meta_description"


def p2_copies(spark: SparkSession, sf: str) -> DataFrame:
    """One record per group with its number of copies."""
    return format_duplicates.collapse(*_p2_records(spark, sf))


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    fetched = table(spark, sf, "fetch_result", "fetch_id", "body").select(F.lit("fetch").alias("record_kind"), F.col("fetch_id").cast("string").alias("record_key"), "body")
    cases = table(spark, sf, "fixture_case", "case_id", "body").select(F.lit("fixture").alias("record_kind"), F.col("case_id").alias("record_key"), "body")
    return fetched.unionByName(cases)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of each block of the article itself."""
    return boilerplate.article_blocks(_bodies(spark, sf)).select("record_kind", "record_key", "block_md5").distinct()


def p4_article_text(spark: SparkSession, sf: str) -> DataFrame:
    """Article text of each page: its blocks in order, one to a line."""
    found = boilerplate.article_blocks(_bodies(spark, sf), text=True).dropDuplicates(["record_kind", "record_key", "position"])
    lines = F.array_sort(F.collect_list(F.struct("position", "block")))
    return found.groupBy("record_kind", "record_key").agg(F.array_join(F.transform(lines, lambda b: b["block"]), "\n").alias("article_text"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "eval_item", "item_id", "text"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the evaluation items they hold passages of."""
    return _leaks(spark, sf).select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Leaks with how many of the item's words stand in shared passages."""
    return _leaks(spark, sf).select("doc_id", "item_id", "shared_words", "item_words").distinct()


def p9_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Documents chosen for the mix with their number of copies."""
    return mixing.mix(table(spark, sf, "documents", "doc_id", "source", "lang", "text"), table(spark, sf, "mix_target"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted and really reached share of each source."""
    return mixing.shares(p9_selection(spark, sf), table(spark, sf, "mix_target"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents made of repeated keywords, link lists or product tags."""
    return p10_shapes(spark, sf).select("doc_id").distinct()


def p10_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """The documents concerned with their largest shapes."""
    return spam.judged(table(spark, sf, "documents", "doc_id", "text")).filter("spam")


_P2_KEYS = """
  WITH n AS (SELECT DISTINCT crawl_id, page_id,
      regexp_replace(lower(coalesce(title, '')), '[^\\p{L}\\p{M}\\p{N}]+', '', 'g') AS a,
      regexp_replace(lower(coalesce(meta_description, '')), '[^\\p{L}\\p{M}\\p{N}]+', '', 'g') AS b FROM page_record),
  k AS (SELECT crawl_id, page_id, least(a, b) AS x, greatest(a, b) AS y FROM n WHERE a <> '' OR b <> ''),
  g AS (SELECT *, min(page_id) OVER w AS first_id, count(*) OVER w AS c FROM k WINDOW w AS (PARTITION BY crawl_id, x, y))"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_repaired": p1_repaired,
    "p2_found": p2_found,
    "p2_copies": p2_copies,
    "p4_found": p4_found,
    "p4_article_text": p4_article_text,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_selection": p9_selection,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_shapes": p10_shapes,
}

_P8_RUNS = """
  WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+') AS w FROM documents WHERE text <> ''),
  i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+') AS w FROM eval_item WHERE text IS NOT NULL),
  s AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
  g AS (SELECT item_id, n, k, len(w) AS item_words, array_to_string(w[k:k + n - 1], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM s)),
  e AS (SELECT DISTINCT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS run
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM s)))"""

ORACLES: dict[str, str] = {
    "p2_found": _P2_KEYS + " SELECT first_id AS first_page_id, page_id AS copy_page_id FROM g WHERE page_id <> first_id",
    "p2_copies": _P2_KEYS + " SELECT crawl_id, first_id, CAST(max(c) AS BIGINT) AS copies FROM g WHERE c > 1 GROUP BY crawl_id, first_id",
    "p8_found": _P8_RUNS + " SELECT DISTINCT doc_id, item_id FROM e JOIN g USING (n, run)",
    "p8_leaks": _P8_RUNS + """,
  c AS (SELECT DISTINCT doc_id, item_id, item_words, unnest(range(k, k + n)) AS word FROM e JOIN g USING (n, run))
  SELECT doc_id, item_id, count(*) AS shared_words, item_words FROM c GROUP BY doc_id, item_id, item_words""",
}
