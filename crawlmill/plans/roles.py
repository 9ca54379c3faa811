"""Role-played evidence: a site whose crawl is derived from the star-schema tables, for what the delivered ones lack.

The delivered tables hold no language alternates, images, sitemap files, crawl states or repeated content hashes.
The views below derive them by rule; their text runs as it is in Spark and in the SQL the results are compared with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawlmill.session import prepare

CRAWL = "role"
VIEWS = {
    "ev_url": "SELECT p_partkey AS url_id, 'https://shop.example/' || replace(lower(p_brand), '#', '-') || '/' || CAST(p_partkey AS VARCHAR(20)) AS request_key FROM {part}",
    "ev_crawl_url": """SELECT p_partkey AS crawl_url_id, p_partkey AS url_id, CAST(p_size % 7 AS BIGINT) AS depth,
      CASE WHEN p_partkey % 17 = 0 THEN 'failed' WHEN p_partkey % 13 = 0 THEN 'skipped' ELSE 'analysed' END AS state,
      CASE WHEN p_partkey % 17 <> 0 AND p_partkey % 13 = 0 THEN 'disallowed' ELSE 'allowed' END AS robots_decision, CAST(1 + p_partkey % 3 AS BIGINT) AS attempt_count
      FROM {part} WHERE p_partkey % 10 <> 3""",
    "ev_last_fetch": """SELECT crawl_url_id, CASE WHEN state = 'failed' THEN NULL WHEN url_id % 29 = 0 THEN 404 WHEN url_id % 31 = 0 THEN 301 ELSE 200 END AS status_code
      FROM ev_crawl_url WHERE state <> 'skipped'""",
    "r_url": f"""SELECT '{CRAWL}' AS crawl_id, cu.crawl_url_id, u.request_key AS url, cu.state, f.status_code, CAST(cu.depth AS INT) AS depth, cu.robots_decision
      FROM ev_crawl_url cu JOIN ev_url u ON u.url_id = cu.url_id LEFT JOIN ev_last_fetch f ON f.crawl_url_id = cu.crawl_url_id""",
    "r_page": """SELECT s.crawl_id, s.url, s.crawl_url_id AS page_id, CASE WHEN p.p_partkey % 4 = 0 THEN p.p_name WHEN p.p_partkey % 41 = 0 THEN '' ELSE p.p_name || ' ' || CAST(p.p_partkey AS VARCHAR(20)) END AS title,
      CASE WHEN p.p_partkey % 6 = 0 THEN p.p_brand || ' ' || p.p_type ELSE p.p_brand || ' ' || p.p_type || ' ' || CAST(p.p_partkey AS VARCHAR(20)) END AS meta_description,
      CASE WHEN p.p_partkey % 5 = 0 THEN NULL WHEN p.p_partkey % 7 = 0 THEN c.request_key ELSE s.url END AS canonical_url,
      CASE WHEN p.p_partkey % 11 = 0 THEN 'noindex, follow' WHEN p.p_partkey % 23 = 0 THEN 'NOINDEX' ELSE '' END AS robots_directives,
      CASE WHEN p.p_partkey % 8 = 1 THEN p.p_type || '|' || CAST(p.p_size AS VARCHAR(10)) ELSE CAST(p.p_partkey AS VARCHAR(20)) END AS content_hash, s.status_code, s.depth
      FROM r_url s JOIN {part} p ON p.p_partkey = s.crawl_url_id LEFT JOIN ev_url c ON c.url_id = p.p_partkey % 97 WHERE s.state = 'analysed'""",
    "r_link": f"""SELECT '{CRAWL}' AS crawl_id, l.link_id, a.request_key AS source_url, b.request_key AS target_url, l.rel, l.kind FROM
      (SELECT l_orderkey * 10 + l_linenumber AS link_id, l_partkey AS source_id, (l_orderkey * 7 + l_linenumber) % n.c - ((l_orderkey * 7 + l_linenumber) % n.c) % 3 AS target_id,
        CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'NoFollow,ugc' WHEN l_returnflag = 'A' AND l_linenumber = 2 THEN 'noopener nofollow' WHEN l_returnflag = 'N' THEN 'xnofollow' ELSE '' END AS rel,
        CASE WHEN l_linestatus = 'F' THEN 'external' ELSE 'internal' END AS kind FROM {{lineitem}} CROSS JOIN (SELECT count(*) AS c FROM {{part}}) n) l
      JOIN ev_url a ON a.url_id = l.source_id JOIN ev_url b ON b.url_id = l.target_id""",
    "r_sitemap": f"SELECT '{CRAWL}' AS crawl_id, r_regionkey AS sitemap_id, CASE WHEN r_regionkey = 2 THEN 'http_500' ELSE 'ok' END AS status FROM {{region}}",
    "r_found": f"SELECT '{CRAWL}' AS crawl_id, u.request_key AS url, 'sitemap' AS discovery_kind, CAST(p_partkey % 5 AS INT) AS sitemap_id FROM {{part}} JOIN ev_url u ON u.url_id = p_partkey WHERE p_partkey % 3 <> 0",
    "r_hreflang": """SELECT pg.crawl_id, pg.page_id, CASE WHEN pg.page_id % 2 = 1 THEN 'de' ELSE 'en-GB' END AS language_code, u.request_key AS target_url FROM r_page pg
      JOIN ev_url u ON u.url_id = CASE WHEN pg.page_id % 2 = 1 THEN pg.page_id + 1 ELSE pg.page_id - 1 END WHERE pg.page_id % 2 = 1 OR pg.page_id % 4 = 0""",
    "r_image": f"SELECT '{CRAWL}' AS crawl_id, s_suppkey AS image_id, u.request_key AS url FROM {{supplier}} JOIN ev_url u ON u.url_id = s_suppkey * 3",
    "r_shown": f"SELECT DISTINCT '{CRAWL}' AS crawl_id, l_partkey AS page_id, l_suppkey AS image_id FROM {{lineitem}}",
}
TABLES = ("part", "lineitem", "region", "supplier")


def sql() -> str:
    """The views as common table expressions over tables of their own names."""
    return ",\n  ".join(f"{name} AS ({text.format(**{t: t for t in TABLES})})" for name, text in VIEWS.items())


def role(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One view as a frame over the files of a folder; views it doesn't use are dropped by the optimizer."""
    files = {t: f"parquet.`{sf}/{t}.parquet`" for t in TABLES}
    listed = ", ".join(f"{n} AS ({text.format(**files)})" for n, text in VIEWS.items())
    return prepare(spark).sql(f"WITH {listed} SELECT * FROM {name}")
