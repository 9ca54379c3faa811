"""Queries of the site-audit operators over the delivered tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlmill.functions import html, text, urls
from crawlmill.functions.robots import robots_decisions
from crawlmill.operators import audits, graph, neardup, reads, rules
from crawlmill.sources import evidence as ev
from crawlmill.sources import metrics
from crawlmill.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
WITH = "WITH " + ev.SQL


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and the SQL it equals."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# URLs. SQL forms of host, path and query of an absolute URL.
_HOST = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
_PATH = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_URLS = "SELECT DISTINCT target_url AS url FROM link_record WHERE target_url IS NOT NULL"


def _target_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "link_record", "target_url").filter("target_url is not null").select(F.col("target_url").alias("url")).distinct()


@query("url_normalize")
def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Identity of every raw target, resolved against its page; raw targets are written in several ways."""
    raw = table(spark, sf, "link_record", "source_url", "raw_target").distinct()
    full = spread(raw).select("source_url", "raw_target", urls.resolved(F.col("source_url"), F.col("raw_target")).alias("resolved"))
    return full.select("source_url", "raw_target", urls.normalized(F.col("resolved")).alias("request_key"))


@query("url_parts", f"SELECT url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM ({_URLS})")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Scheme, host, path and query of every link target."""
    u = F.col("url")
    return _target_urls(spark, sf).select("url", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query(u).alias("query"))


@query(
    "url_segment",
    f"""SELECT segment, count(*) AS n FROM (SELECT CASE WHEN {_HOST.format('url')} = '' THEN 'unknown'
      WHEN regexp_extract({_PATH.format('url')}, '^/*([^/]+)', 1) = '' THEN '/'
      ELSE '/' || regexp_extract({_PATH.format('url')}, '^/*([^/]+)', 1) || '/' END AS segment FROM ({_URLS})) GROUP BY segment""",
)
def url_segment(spark: SparkSession, sf: str) -> DataFrame:
    """Number of targets by first directory."""
    return _target_urls(spark, sf).groupBy(urls.segment(F.col("url")).alias("segment")).agg(F.count(F.lit(1)).alias("n"))


SCOPE_INCLUDE, SCOPE_EXCLUDE, SCOPE_QUERY = "^/(shop|guides|help|blog)/", "/x-[0-9]+", "(^|&)page="


@query(
    "url_scope",
    f"""SELECT decision, count(*) AS n FROM (SELECT CASE
      WHEN NOT ({_HOST.format('url')} = 'merrovik.example' OR suffix({_HOST.format('url')}, '.merrovik.example')) THEN 'host is outside crawl scope'
      WHEN NOT regexp_matches({_PATH.format('url')}, '{SCOPE_INCLUDE}') THEN 'path does not match include scope'
      WHEN regexp_matches({_PATH.format('url')}, '{SCOPE_EXCLUDE}') THEN 'path matches exclude scope'
      WHEN regexp_matches(regexp_extract(url, '\\?([^#]*)', 1), '{SCOPE_QUERY}') THEN 'query matches exclude scope'
      ELSE 'allowed' END AS decision FROM ({_URLS})) GROUP BY decision""",
)
def url_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Targets by scope decision."""
    decision = urls.scope_decision(F.col("url"), ["merrovik.example"], True, [SCOPE_INCLUDE], [SCOPE_EXCLUDE], None, [SCOPE_QUERY])
    return _target_urls(spark, sf).groupBy(decision.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "url_trap",
    f"""SELECT trap, count(*) AS n FROM (SELECT CASE WHEN len(s) > 200 THEN 'excessive_path_depth'
      WHEN len(s) > 8 AND list_bool_or(list_transform(range(1, len(s) - 7), lambda i: len(list_distinct(s[i:i + 8])) = 1)) THEN 'repeated_path_segment'
      WHEN regexp_matches(q, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') THEN 'malformed_query'
      WHEN len(list_filter(string_split(q, '&'), lambda p: p <> '')) > 50 THEN 'excessive_query_parameters' ELSE '' END AS trap
      FROM (SELECT list_filter(string_split({_PATH.format('url')}, '/'), lambda x: x <> '') AS s, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM ({_URLS}))) GROUP BY trap""",
)
def url_trap(spark: SparkSession, sf: str) -> DataFrame:
    """Targets by crawl trap."""
    return _target_urls(spark, sf).groupBy(urls.trap(F.col("url")).alias("trap")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "url_link_kind",
    f"""SELECT own AS kind, kind AS recorded, count(*) AS n FROM (SELECT kind,
      CASE WHEN {_HOST.format('target_url')} = {_HOST.format('source_url')} THEN 'internal' ELSE 'external' END AS own
      FROM link_record WHERE target_url IS NOT NULL AND source_url IS NOT NULL) GROUP BY 1, 2""",
)
def url_link_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Links by computed and recorded kind."""
    rows = table(spark, sf, "link_record", "source_url", "target_url", "kind").filter("target_url is not null and source_url is not null")
    return rows.groupBy(urls.link_kind(F.col("target_url"), F.col("source_url")).alias("kind"), F.col("kind").alias("recorded")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "url_retry",
    """SELECT decision, wait_s, count(*) AS n FROM (SELECT CASE WHEN status_code IS NULL AND fetch_id % 2 = 0 THEN 'transient_network' WHEN status_code IS NULL THEN 'permanent_network'
      WHEN status_code IN (408, 425, 429, 500, 502, 503, 504) THEN 'transient_http' ELSE 'status_not_retryable' END AS decision,
      CASE fetch_id % 4 WHEN 0 THEN 120 WHEN 1 THEN 900 WHEN 2 THEN 480 ELSE 0 END AS wait_s FROM (SELECT DISTINCT fetch_id, status_code FROM fetch_result)) GROUP BY ALL""",
)
def url_retry(spark: SparkSession, sf: str) -> DataFrame:
    """Fetches by whether another attempt is worth it and how long to wait; the errors' kind and the header are role-played from the key."""
    key = F.col("fetch_id")
    rows = table(spark, sf, "fetch_result", "fetch_id", "status_code").distinct()
    header = F.when(key % 4 == 0, "120").when(key % 4 == 1, "99999").when(key % 4 == 2, "Wed, 21 Oct 2026 07:28:00 GMT").otherwise("soon")
    decision = urls.retry_decision(F.col("status_code"), F.col("status_code").isNull() & (key % 2 == 0))
    wait = urls.retry_after_s(header, F.lit("2026-10-21 07:20:00").cast("timestamp"))
    return rows.groupBy(decision.alias("decision"), wait.alias("wait_s")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "url_redirect_chain",
    """SELECT fetch_id, CAST(len(redirects) AS BIGINT) AS hops, list_sort(list_transform(redirects, lambda r: r.hop))[1] AS first_hop,
      array_to_string(list_transform(list_sort(list_transform(redirects, lambda r: {'hop': r.hop, 's': r.status_code})), lambda x: CAST(x.s AS VARCHAR)), ',') AS statuses
      FROM (SELECT DISTINCT fetch_id, redirects FROM fetch_result WHERE len(redirects) > 0)""",
)
def url_redirect_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Redirect chains in hop order."""
    rows = table(spark, sf, "fetch_result", "fetch_id", "redirects").filter(F.size("redirects") > 0).distinct()
    ordered = F.array_sort(F.transform("redirects", lambda r: F.struct(r["hop"].alias("hop"), r["status_code"].alias("s"))))
    return rows.select("fetch_id", F.size("redirects").cast("long").alias("hops"), ordered[0]["hop"].alias("first_hop"), F.array_join(F.transform(ordered, lambda x: x["s"].cast("string")), ",").alias("statuses"))


@query(
    "url_robots",
    f"""WITH f AS (SELECT {_HOST.format('requested_url')} AS host, min(body) AS body FROM fetch_result WHERE content_type LIKE 'text/plain%' AND body IS NOT NULL GROUP BY 1),
      r AS (SELECT host, unnest(regexp_extract_all(body, '(?i)disallow:\\s*(\\S+)', 1)) AS rule FROM f),
      q AS (SELECT DISTINCT {_HOST.format('url')} AS host, {_PATH.format('url')} AS path FROM page_record WHERE {_HOST.format('url')} IN (SELECT host FROM f)),
      m AS (SELECT q.host, q.path, arg_max(rule, length(rule)) AS rule FROM q JOIN r ON r.host = q.host AND starts_with(q.path, r.rule) GROUP BY ALL)
      SELECT q.host, q.path, m.rule IS NULL AS allowed, coalesce(m.rule, '') AS matched_rule, CAST(0 AS DOUBLE) AS crawl_delay FROM q LEFT JOIN m USING (host, path)""",
)
def url_robots(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of the fetched robots files for every page of their host; the SQL knows files of one group that only refuse prefixes."""
    fetched = table(spark, sf, "fetch_result", "requested_url", "content_type", "body").filter("content_type like 'text/plain%' and body is not null")
    files = fetched.select(urls.host(F.col("requested_url")).alias("host"), "body").groupBy("host").agg(F.min("body").alias("body"))
    pages = table(spark, sf, "page_record", "url").distinct().select(urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))
    return robots_decisions(files, pages.join(files.select("host"), "host", "left_semi"), "auditbot")


# Documents.


def _html(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "fetch_result", "fetch_id", "final_url", "requested_url", "body").filter("body is not null and body rlike '^\\\\s*<'").dropDuplicates(["fetch_id"])
    return spread(rows).select("fetch_id", F.coalesce("final_url", "requested_url").alias("url"), "body")


@query("ext_page")
def ext_page(spark: SparkSession, sf: str) -> DataFrame:
    """Page records of all fetched documents."""
    return _html(spark, sf).select("fetch_id", "url", html.page(F.col("url"), F.col("body")).alias("p")).select("fetch_id", "url", "p.*")


@query(
    "ext_title",
    """SELECT DISTINCT fetch_id, trim(regexp_replace(regexp_extract(body, '(?is)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title,
      regexp_extract(body, '(?i)<html lang="([^"]*)"', 1) AS language FROM fetch_result WHERE body IS NOT NULL AND regexp_matches(body, '^\\s*<')""",
)
def ext_title(spark: SparkSession, sf: str) -> DataFrame:
    """Title and language of all fetched documents; only two fields of the record are used."""
    p = html.page(F.col("url"), F.col("body")).alias("p")
    return _html(spark, sf).select("fetch_id", p).select("fetch_id", "p.title", "p.language")


@query("ext_links")
def ext_links(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of all fetched documents, in order."""
    p = html.page(F.col("url"), F.col("body")).alias("p")
    return _html(spark, sf).select("fetch_id", p).select("fetch_id", F.posexplode("p.links").alias("position", "l")).select("fetch_id", "position", "l.*")


@query("ext_headings", "SELECT DISTINCT fetch_id, CAST(len(regexp_extract_all(body, '(?i)<h[1-6][ >]')) AS BIGINT) AS headings FROM fetch_result WHERE body IS NOT NULL AND regexp_matches(body, '^\\s*<')")
def ext_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Number of headings of all fetched documents."""
    p = html.page(F.col("url"), F.col("body")).alias("p")
    return _html(spark, sf).select("fetch_id", p).select("fetch_id", F.size("p.headings").cast("long").alias("headings"))


@query("ext_html_hash", "SELECT DISTINCT fetch_id, sha256(body) AS html_hash FROM fetch_result WHERE body IS NOT NULL")
def ext_html_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of the fetched bytes, all in the JVM."""
    return table(spark, sf, "fetch_result", "fetch_id", "body").filter("body is not null").select("fetch_id", F.sha2("body", 256).alias("html_hash")).distinct()


@query("ext_redacted")
def ext_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without script contents, secrets and queries."""
    return _html(spark, sf).select("fetch_id", html.redacted(F.col("body")).alias("html"))


_SIMHASH = """
  w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
  g AS (SELECT doc_id, ('0x' || substr(sha256(array_to_string(w[i:i + 2], chr(0))), 1, 16))::UBIGINT AS v
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
  b AS (SELECT doc_id, k, 2 * sum((v >> k) & 1::UBIGINT) >= count(*) AS bit FROM g, (SELECT unnest(range(64))::UBIGINT AS k) GROUP BY doc_id, k),
  sig AS (SELECT doc_id, bit_or(CASE WHEN bit THEN 1::UBIGINT << k ELSE 0::UBIGINT END) AS s FROM b GROUP BY doc_id)
"""


@query("text_simhash", f"WITH {_SIMHASH} SELECT doc_id, lpad(to_hex(s), 16, '0') AS similarity_hash FROM sig".replace("to_hex(s)", "lower(to_hex(s))"))
def text_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """SimHash of every document with words."""
    rows = spread(table(spark, sf, "documents", "doc_id", "text"))
    return rows.select("doc_id", text.simhash64(F.col("text")).alias("sig")).filter("sig is not null").select("doc_id", text.hex16(F.col("sig")).alias("similarity_hash"))


@query(
    "gr_near_duplicates",
    f"""WITH {_SIMHASH}, k AS (SELECT doc_id, s, unnest([
        {", ".join(f"{{'p': {p}, 'a': {a}, 'b': {b}}}" for p, (a, b) in enumerate(neardup.PAIRS))}]) AS q FROM sig),
      e AS (SELECT doc_id, s, q.p AS p, CASE WHEN q.a = 4 THEN s >> 52 ELSE (s >> (13 * q.a)::UBIGINT) & 8191 END AS x, CASE WHEN q.b = 4 THEN s >> 52 ELSE (s >> (13 * q.b)::UBIGINT) & 8191 END AS y FROM k),
      m AS (SELECT l.doc_id AS id, r.doc_id AS match_id, l.p, bit_count(xor(l.s, r.s)) AS distance FROM e l JOIN e r ON l.p = r.p AND l.x = r.x AND l.y = r.y AND r.doc_id < l.doc_id)
      SELECT id, match_id, CAST(distance AS INTEGER) AS distance FROM m WHERE distance <= 3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY p, match_id) = 1""",
)
def gr_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's earlier near duplicate."""
    rows = spread(table(spark, sf, "documents", "doc_id", "text"))
    return neardup.near_duplicates(rows.select(F.col("doc_id").alias("id"), text.simhash64(F.col("text")).alias("sig")))


# Row-local rules.


@query("rp_page_findings")
def rp_page_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of all fixture cases."""
    cases = table(spark, sf, "fixture_case").dropDuplicates(["case_id"])
    base = "https://site.example"
    url = F.coalesce("document_url", F.concat(F.lit(base), F.col("path")))
    body = F.replace(F.col("body"), F.lit("{{BASE_URL}}"), F.lit(base))
    headers = F.transform_keys("headers", lambda k, v: F.lower(k))
    rows = spread(cases).select("case_id", url.alias("document_url"), "status_code", headers.alias("headers"), "depth", "inlinks", "in_sitemap", "robots_blocked", "exact_duplicate_count", html.page(url, body).alias("page"))
    return rules.page_findings(rows, ["case_id"])


@query(
    "rp_title",
    """SELECT page_id, CASE WHEN n = 0 THEN 'Title is missing or empty' WHEN n < 30 THEN 'Title is shorter than the configured threshold'
      WHEN n > 60 THEN 'Title is longer than the configured threshold' END AS message FROM (SELECT DISTINCT page_id,
      length(regexp_replace(coalesce(title, ''), '^[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+|[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+$', '', 'g')) AS n
      FROM page_record) WHERE n < 30 OR n > 60""",
)
def rp_title(spark: SparkSession, sf: str) -> DataFrame:
    """Title findings of all pages, in code points."""
    n = F.length(rules.trimmed(F.col("title")))
    message = F.when(n == 0, "Title is missing or empty").when(n < rules.TITLE[0], "Title is shorter than the configured threshold").when(n > rules.TITLE[1], "Title is longer than the configured threshold")
    return table(spark, sf, "page_record", "page_id", "title").distinct().select("page_id", message.alias("message")).filter("message is not null")


def _resource_sql() -> str:
    """Findings of resources in SQL: condition and evidence of each rule, its texts from the table of findings."""
    text, size = """'"content_type":"' || k || '"'""", """'"decoded_bytes":' || b"""
    listed = {
        "RR-01": ("s < 200 OR s >= 400", f"""'"status_code":' || s || ',' || {text}"""),
        "RR-16b": (f"starts_with(k, 'image/') AND b > {rules.LARGE_IMAGE}", f"""{size} || ',"threshold_bytes":{rules.LARGE_IMAGE},' || {text}"""),
        "RR-16c": ("k IN ('image/bmp', 'image/tiff')", text),
        "RR-17a": ("pdf AND NOT contains(t, '/Title')", f"""'"check":"info_title",' || {size}"""),
        "RR-17b": ("pdf AND NOT contains(t, '/Lang')", """'"check":"document_language"'"""),
        "RR-17c": ("pdf AND NOT contains(t, '/Marked true') AND NOT contains(t, '/Marked(true)')", """'"check":"marked_content"'"""),
        "RR-17d": ("pdf AND contains(t, '/Encrypt')", """'"encrypted":true'"""),
    }
    parts = []
    for name, (condition, evidence) in listed.items():
        rule, severity, message, kind = rules.FOUND[name]
        parts.append(f"SELECT fetch_id, '{rule}' AS rule_id, '{severity}' AS severity, '{message}' AS message, '{{' || {evidence} || '}}' AS evidence, '{kind}' AS classification FROM p WHERE {condition}")
    return f"""WITH r AS (SELECT DISTINCT fetch_id, coalesce(status_code, 0) AS s, lower(split_part(coalesce(content_type, ''), ';', 1)) AS k, coalesce(decoded_bytes, 0) AS b, coalesce(body, '') AS t
      FROM fetch_result WHERE content_type NOT LIKE 'text/html%'), p AS (SELECT *, k = 'application/pdf' OR starts_with(t, '%PDF-') AS pdf FROM r) {' UNION ALL '.join(parts)}"""


@query("rr_resource_findings", _resource_sql())
def rr_resource_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of fetched resources that are no pages."""
    rows = table(spark, sf, "fetch_result", "fetch_id", "status_code", "content_type", "decoded_bytes", "body").filter("content_type not like 'text/html%'").dropDuplicates(["fetch_id"])
    return rules.resource_findings(rows, ["fetch_id"])


@query("rr_status", "SELECT DISTINCT fetch_id, coalesce(status_code, 0) AS status_code FROM fetch_result WHERE coalesce(status_code, 0) < 200 OR status_code >= 400")
def rr_status(spark: SparkSession, sf: str) -> DataFrame:
    """Fetches that were not successful."""
    s = F.coalesce("status_code", F.lit(0))
    return table(spark, sf, "fetch_result", "fetch_id", "status_code").select("fetch_id", s.alias("status_code")).filter("status_code < 200 or status_code >= 400").distinct()


# Whole-site rules.


@query(
    "gr_broken_links",
    WITH + """SELECT l.crawl_id, l.link_id, l.source_url, l.target_url, coalesce(p.status_code, 0) AS status_code FROM link l
      LEFT JOIN page p ON p.crawl_id = l.crawl_id AND p.url = l.target_url
      WHERE l.kind = 'internal' AND l.target_url IS NOT NULL AND (coalesce(p.status_code, 0) = 0 OR p.status_code >= 400)""",
)
def gr_broken_links(spark: SparkSession, sf: str) -> DataFrame:
    """Internal links to pages that failed or were not crawled."""
    return graph.broken_links(ev.links(spark, sf, "source_url", "target_url", "kind"), ev.pages(spark, sf, "status_code"))


def _duplicates_sql(field: str) -> str:
    return WITH + f"""SELECT crawl_id, page_id, {field} AS value, n AS duplicate_count FROM (
      SELECT crawl_id, page_id, {field}, count(*) OVER (PARTITION BY crawl_id, {field}) AS n FROM page WHERE trim(coalesce({field}, '')) <> '') WHERE n > 1"""


for _name, _field in (("gr_duplicate_titles", "title"), ("gr_duplicate_descriptions", "meta_description")):
    query(_name, _duplicates_sql(_field))(lambda spark, sf, f=_field: graph.duplicates(ev.pages(spark, sf, "page_id", f), f))


@query(
    "gr_canonical",
    WITH + """SELECT * FROM (SELECT p.crawl_id, p.page_id, p.canonical_url, coalesce(t.status_code, 0) AS target_status, t.url IS NOT NULL AS target_crawled,
      coalesce(t.canonical_url, '') AS target_canonical, lower(coalesce(t.robots_directives, '')) LIKE '%noindex%' AS target_noindex
      FROM page p LEFT JOIN page t ON t.crawl_id = p.crawl_id AND t.url = p.canonical_url WHERE p.canonical_url IS NOT NULL)
      WHERE NOT target_crawled OR target_status <> 200 OR (target_canonical <> '' AND target_canonical <> canonical_url) OR target_noindex""",
)
def gr_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose canonical does not lead to an indexable page."""
    rows = graph.canonical_targets(ev.pages(spark, sf, "page_id", "canonical_url", "status_code", "robots_directives"))
    return rows.select("crawl_id", "page_id", "canonical_url", "target_status", "target_crawled", "target_canonical", "target_noindex")


@query(
    "gr_sitemap_missing",
    WITH + """SELECT crawl_id, page_id, url FROM page p WHERE status_code = 200 AND lower(coalesce(robots_directives, '')) NOT LIKE '%noindex%'
      AND NOT EXISTS (SELECT 1 FROM found f WHERE f.discovery_kind = 'sitemap' AND f.crawl_id = p.crawl_id AND f.url = p.url)""",
)
def gr_sitemap_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Indexable pages no sitemap lists."""
    return graph.missing_from_sitemaps(ev.pages(spark, sf, "page_id", "status_code", "robots_directives"), ev.discovered(spark, sf))


@query(
    "gr_sitemap_bad",
    WITH + """SELECT * FROM (SELECT f.crawl_id, f.url, coalesce(p.status_code, 0) AS status_code, lower(coalesce(p.robots_directives, '')) LIKE '%noindex%' AS noindex,
      p.url IS NOT NULL AS crawled FROM (SELECT DISTINCT crawl_id, url FROM found WHERE discovery_kind = 'sitemap') f
      LEFT JOIN page p ON p.crawl_id = f.crawl_id AND p.url = f.url) WHERE status_code <> 200 OR noindex""",
)
def gr_sitemap_bad(spark: SparkSession, sf: str) -> DataFrame:
    """Sitemap entries that are no indexable pages."""
    return graph.bad_sitemap_entries(ev.pages(spark, sf, "status_code", "robots_directives"), ev.discovered(spark, sf))


@query("gr_deep", WITH + "SELECT crawl_id, page_id, depth FROM page WHERE depth > 4")
def gr_deep(spark: SparkSession, sf: str) -> DataFrame:
    """Pages deeper than the threshold."""
    return graph.deep_pages(ev.pages(spark, sf, "page_id", "depth"))


@query("gr_orphans", WITH + "SELECT crawl_id, page_id FROM page p WHERE depth > 0 AND NOT EXISTS (SELECT 1 FROM link l WHERE l.crawl_id = p.crawl_id AND l.kind = 'internal' AND l.target_url = p.url)")
def gr_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Pages no internal link leads to."""
    return graph.orphans(ev.pages(spark, sf, "page_id", "depth"), table(spark, sf, "link_record", "crawl_id", "target_url", "kind"))


@query(
    "gr_nofollow",
    WITH + """SELECT p.crawl_id, p.page_id, count(*) AS nofollow_links FROM page p JOIN link l ON l.crawl_id = p.crawl_id AND l.source_url = p.url
      WHERE l.kind = 'internal' AND (' ' || lower(replace(l.rel, ',', ' ')) || ' ') LIKE '% nofollow %' GROUP BY p.crawl_id, p.page_id""",
)
def gr_nofollow(spark: SparkSession, sf: str) -> DataFrame:
    """Internal nofollow links per page."""
    return graph.nofollow_links(ev.pages(spark, sf, "page_id"), ev.links(spark, sf, "source_url", "rel", "kind"))


def _issues(spark: SparkSession, sf: str, *fields: str) -> DataFrame:
    return table(spark, sf, "issue").dropDuplicates(["issue_id"]).select(*fields) if fields else table(spark, sf, "issue").dropDuplicates(["issue_id"])


@query(
    "gr_provenance",
    """WITH i AS (SELECT DISTINCT * FROM issue), j AS (SELECT *, CASE WHEN json_valid(evidence_json) AND json_type(evidence_json::JSON) = 'OBJECT' THEN evidence_json::JSON END AS e FROM i)
      SELECT issue_id, CASE WHEN severity = 'info' THEN 'information'
        WHEN rule_id IN ('AUD-01', 'AUD-05', 'AUD-07', 'AUD-09', 'AUD-10', 'AUD-12', 'AUD-13') THEN 'deterministic'
        WHEN rule_id = 'AUD-04' THEN CASE WHEN e->>'$.canonical_count' IS NOT NULL THEN 'recommendation' ELSE 'deterministic' END
        WHEN rule_id = 'AUD-02' THEN CASE WHEN TRY_CAST(e->>'$.length' AS INTEGER) = 0 THEN 'deterministic' ELSE 'recommendation' END
        WHEN rule_id = 'AUD-03' THEN CASE WHEN e->>'$.h1_count' IS NOT NULL THEN 'deterministic' ELSE 'recommendation' END
        WHEN rule_id = 'AUD-08' AND e->>'$.hamming_distance' IS NULL THEN 'deterministic'
        WHEN rule_id IN ('AUD-08', 'AUD-11') THEN 'recommendation' ELSE 'review' END AS classification,
      CASE WHEN subject_type = 'rendered_page' THEN 'rendered' WHEN rule_id = 'AUD-06' OR subject_type = 'sitemap' THEN 'sitemap'
        WHEN subject_type IN ('link', 'image', 'url') OR rule_id IN ('AUD-08', 'AUD-11') THEN 'graph' ELSE 'raw' END AS evidence_source FROM j""",
)
def gr_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Final class and source of every issue."""
    return graph.provenance(_issues(spark, sf, "issue_id", "rule_id", "severity", "subject_type", "evidence_json")).select("issue_id", "classification", "evidence_source")


# Reads.


@query(
    "q_summary",
    WITH + """, i AS (SELECT DISTINCT * FROM issue), got AS (SELECT DISTINCT fetch_id, crawl_id, status_code FROM fetch_result)
      SELECT crawl_id, 'response' AS kind, CASE WHEN status_code IS NULL THEN 'none' ELSE CAST(status_code // 100 AS VARCHAR) || 'xx' END AS name, count(*) AS n FROM page GROUP BY ALL
      UNION ALL SELECT crawl_id, 'mode', coalesce(extraction_mode, 'none'), count(*) FROM page GROUP BY ALL
      UNION ALL SELECT crawl_id, 'severity', coalesce(severity, 'none'), count(*) FROM i GROUP BY ALL
      UNION ALL SELECT crawl_id, 'rule', coalesce(rule_id, 'none'), count(*) FROM i GROUP BY ALL
      UNION ALL SELECT DISTINCT crawl_id, 'status', coalesce(status, 'none'), 1 FROM crawl_run
      UNION ALL SELECT crawl_id, 'counter', 'discovered', count(*) FROM found GROUP BY ALL
      UNION ALL SELECT crawl_id, 'counter', 'fetched', count(*) FROM got GROUP BY ALL
      UNION ALL SELECT crawl_id, 'counter', 'failed', count(*) FROM got WHERE coalesce(status_code, 0) < 200 OR status_code >= 400 GROUP BY ALL
      UNION ALL SELECT crawl_id, 'counter', 'analysed', count(*) FROM page GROUP BY ALL""",
)
def q_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Status, counters, responses, modes, severities and rules of every crawl."""
    runs = table(spark, sf, "crawl_run", "crawl_id", "status").distinct()
    fetches = table(spark, sf, "fetch_result", "fetch_id", "crawl_id", "status_code").distinct()
    pages = ev.pages(spark, sf, "status_code", "extraction_mode")
    return reads.summary(pages, _issues(spark, sf, "crawl_id", "severity", "rule_id"), runs, ev.discovered(spark, sf), fetches)


@query("q_issue_list", "SELECT issue_id, crawl_id, rule_id, severity FROM (SELECT DISTINCT * FROM issue) WHERE severity = 'error' AND contains(lower(evidence_json), 'shop_50%') = false AND contains(lower(evidence_json), 'hops') ORDER BY issue_id LIMIT 101")
def q_issue_list(spark: SparkSession, sf: str) -> DataFrame:
    """First page of errors whose evidence holds a text."""
    found = reads.filter_issues(_issues(spark, sf), "error", None, "hops")
    return reads.keyset(found.filter(~reads.contains_text(F.col("evidence_json"), "shop_50%")), "issue_id").select("issue_id", "crawl_id", "rule_id", "severity")


@query("q_issue_get", "SELECT DISTINCT issue_id, rule_id, severity, evidence_json FROM issue WHERE issue_id = (SELECT min(issue_id) FROM issue)")
def q_issue_get(spark: SparkSession, sf: str) -> DataFrame:
    """One issue by key."""
    rows = _issues(spark, sf, "issue_id", "rule_id", "severity", "evidence_json")
    return rows.join(rows.agg(F.min("issue_id").alias("issue_id")), "issue_id").select("issue_id", "rule_id", "severity", "evidence_json")


@query("q_page_list", WITH + "SELECT page_id, crawl_id, url, title, status_code FROM page WHERE contains(lower(title), 'desk lamp') AND page_id > 2000 ORDER BY page_id LIMIT 101")
def q_page_list(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a searched list, after a key."""
    rows = ev.pages(spark, sf, "page_id", "title", "status_code").filter(reads.contains_text(F.col("title"), "desk lamp"))
    return reads.keyset(rows, "page_id", after=2000).select("page_id", "crawl_id", "url", "title", "status_code")


@query("q_link_list", WITH + "SELECT link_id, crawl_id, source_url, target_url, kind FROM link ORDER BY link_id LIMIT 1001")
def q_link_list(spark: SparkSession, sf: str) -> DataFrame:
    """The longest page of the edge list."""
    return reads.keyset(ev.links(spark, sf, "source_url", "target_url", "kind"), "link_id", limit=1000).select("link_id", "crawl_id", "source_url", "target_url", "kind")


@query(
    "q_page_detail",
    WITH + """, o AS (SELECT crawl_id, source_url AS url, string_agg(CAST(link_id AS VARCHAR), ' ' ORDER BY link_id) AS ids FROM
        (SELECT * FROM link WHERE source_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY crawl_id, source_url ORDER BY link_id) <= 10000) GROUP BY ALL),
      n AS (SELECT crawl_id, target_url AS url, string_agg(CAST(link_id AS VARCHAR), ' ' ORDER BY link_id) AS ids FROM
        (SELECT * FROM link WHERE target_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY crawl_id, target_url ORDER BY link_id) <= 10000) GROUP BY ALL),
      s AS (SELECT page_id, string_agg(coalesce(format, '') || ':' || coalesce(type_summary, ''), ' ' ORDER BY structured_data_id) AS said FROM (SELECT DISTINCT structured_data_id, page_id, format, type_summary FROM structured_data) GROUP BY page_id),
      x AS (SELECT TRY_CAST(subject_id AS BIGINT) AS page_id, string_agg(rule_id || ':' || coalesce(severity, ''), ' ' ORDER BY issue_id) AS said FROM (SELECT DISTINCT * FROM issue) WHERE subject_type = 'page' AND rule_id IS NOT NULL GROUP BY 1),
      m AS (SELECT * FROM page_record QUALIFY row_number() OVER (PARTITION BY crawl_id, url, extraction_mode ORDER BY extracted_at DESC, page_id DESC) = 1),
      d AS (SELECT a.crawl_id, a.url, concat_ws(' ', CASE WHEN coalesce(a.title, '') <> coalesce(b.title, '') THEN 'title' END, CASE WHEN coalesce(a.meta_description, '') <> coalesce(b.meta_description, '') THEN 'meta_description' END,
          CASE WHEN coalesce(a.canonical_url, '') <> coalesce(b.canonical_url, '') THEN 'canonical_url' END, CASE WHEN coalesce(a.content_hash, '') <> coalesce(b.content_hash, '') THEN 'content_hash' END) AS differs
        FROM m a JOIN m b ON a.crawl_id = b.crawl_id AND a.url = b.url WHERE a.extraction_mode = 'raw' AND b.extraction_mode = 'rendered')
      SELECT p.crawl_id, p.page_id, p.url, p.title, p.status_code, coalesce(o.ids, '') AS outlinks, coalesce(n.ids, '') AS inlinks, coalesce(s.said, '') AS structured_data, coalesce(x.said, '') AS issues, d.differs AS render_differences
      FROM page p LEFT JOIN o USING (crawl_id, url) LEFT JOIN n USING (crawl_id, url) LEFT JOIN s ON s.page_id = p.page_id LEFT JOIN x ON x.page_id = p.page_id LEFT JOIN d ON d.crawl_id = p.crawl_id AND d.url = p.url""",
)
def q_page_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Every page with its links both ways, structured data, issues and differences of its rendered form, in short texts."""
    fields = ("title", "meta_description", "canonical_url", "content_hash")
    modes = table(spark, sf, "page_record", "crawl_id", "url", "page_id", "extracted_at", "extraction_mode", *fields)
    modes = modes.groupBy("crawl_id", "url", "extraction_mode").agg(F.max_by(F.struct(*fields), F.struct("extracted_at", "page_id")).alias("p")).select("crawl_id", "url", "extraction_mode", "p.*")
    data = table(spark, sf, "structured_data", "structured_data_id", "page_id", "format", "type_summary").distinct()
    full = reads.page_detail(ev.pages(spark, sf, "page_id", "title", "status_code"), ev.links(spark, sf), data, _issues(spark, sf), modes, list(fields))
    short = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), " "), F.lit(""))
    pair = lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.lit(":"), F.coalesce(b, F.lit("")))
    return full.select(
        "crawl_id", "page_id", "url", "title", "status_code", short("outlinks", lambda x: x["link_id"].cast("string")).alias("outlinks"), short("inlinks", lambda x: x["link_id"].cast("string")).alias("inlinks"),
        short("structured_data", lambda x: pair(x["format"], x["type_summary"])).alias("structured_data"), short("issues", lambda x: pair(x["rule_id"], x["severity"])).alias("issues"),
        F.when(F.col("render_differences").isNotNull(), short("render_differences", lambda x: x["field"])).alias("render_differences"),
    )


_PAIRS = """r AS (SELECT crawl_id, lead(crawl_id) OVER (PARTITION BY project_id ORDER BY started_at, crawl_id) AS next_id FROM (SELECT DISTINCT crawl_id, project_id, started_at FROM crawl_run)),
  p AS (SELECT crawl_id AS a, next_id AS b FROM r WHERE next_id IS NOT NULL)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each crawl with the next one of its project."""
    runs = table(spark, sf, "crawl_run", "crawl_id", "project_id", "started_at").distinct()
    order = Window.partitionBy("project_id").orderBy("started_at", "crawl_id")
    return runs.select("crawl_id", F.lead("crawl_id").over(order).alias("next_id")).filter("next_id is not null")


@query(
    "q_issue_changes",
    f"""WITH i AS (SELECT DISTINCT * FROM issue), {_PAIRS}
      SELECT issue_id, p.b AS crawl_id, 'new' AS change_kind FROM i JOIN p ON i.crawl_id = p.b
      WHERE NOT EXISTS (SELECT 1 FROM i o WHERE o.crawl_id = p.a AND o.rule_id = i.rule_id AND o.subject_type = i.subject_type AND o.evidence_json = i.evidence_json)
      UNION ALL SELECT issue_id, p.b, 'fixed' FROM i JOIN p ON i.crawl_id = p.a
      WHERE NOT EXISTS (SELECT 1 FROM i o WHERE o.crawl_id = p.b AND o.rule_id = i.rule_id AND o.subject_type = i.subject_type AND o.evidence_json = i.evidence_json)""",
)
def q_issue_changes(spark: SparkSession, sf: str) -> DataFrame:
    """New and fixed issues between every two consecutive crawls of a project."""
    issues = _issues(spark, sf, "issue_id", "crawl_id", "rule_id", "subject_type", "evidence_json")
    return reads.issue_changes(issues, _pairs(spark, sf))


@query(
    "q_page_changes",
    WITH + f""", {_PAIRS}, f AS (SELECT p.b AS crawl_id, page.url, coalesce(title, '') AS t, coalesce(canonical_url, '') AS c, coalesce(content_hash, '') AS h, coalesce(CAST(status_code AS VARCHAR), '') AS s FROM page JOIN p ON page.crawl_id = p.a),
      g AS (SELECT page.crawl_id, page.url, coalesce(title, '') AS t, coalesce(canonical_url, '') AS c, coalesce(content_hash, '') AS h, coalesce(CAST(status_code AS VARCHAR), '') AS s FROM page JOIN p ON page.crawl_id = p.b)
      SELECT * FROM (SELECT coalesce(f.crawl_id, g.crawl_id) AS crawl_id, coalesce(f.url, g.url) AS url, CASE WHEN f.url IS NULL THEN 'added' WHEN g.url IS NULL THEN 'removed'
        WHEN (f.t, f.c, f.h, f.s) <> (g.t, g.c, g.h, g.s) THEN 'changed' END AS change_kind FROM f FULL JOIN g ON f.crawl_id = g.crawl_id AND f.url = g.url) WHERE change_kind IS NOT NULL""",
)
def q_page_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Pages added, removed or changed between every two consecutive crawls of a project."""
    fields = ["title", "canonical_url", "content_hash", "status_code"]
    pages = ev.pages(spark, sf, *fields)
    pairs = _pairs(spark, sf)
    before = pages.join(pairs, "crawl_id").drop("crawl_id").withColumnRenamed("next_id", "crawl_id")
    after = pages.join(pairs.select(F.col("next_id").alias("crawl_id")), "crawl_id")
    return reads.compare(before, after, ["crawl_id", "url"], fields)


_ARCHITECTURE = WITH + """, i AS (SELECT crawl_id, target_url AS url, count(*) AS inlinks FROM link WHERE kind = 'internal' GROUP BY ALL),
  o AS (SELECT crawl_id, source_url AS url, count(*) AS outlinks FROM link WHERE kind = 'internal' GROUP BY ALL),
  a AS (SELECT p.crawl_id, p.url, p.page_id, coalesce(p.depth, 0) AS depth, coalesce(i.inlinks, 0) AS inlinks, coalesce(o.outlinks, 0) AS outlinks
      FROM page p LEFT JOIN i ON i.crawl_id = p.crawl_id AND i.url = p.url LEFT JOIN o ON o.crawl_id = p.crawl_id AND o.url = p.url)"""


@query("q_architecture", _ARCHITECTURE + " SELECT page_id, inlinks, outlinks, (2 * inlinks + outlinks) / (depth + 1) AS score, depth > 0 AND inlinks = 0 AS orphan FROM a")
def q_architecture(spark: SparkSession, sf: str) -> DataFrame:
    """Link figures of every page."""
    nodes = reads.architecture(ev.pages(spark, sf, "page_id", "depth", "status_code"), ev.links(spark, sf, "source_url", "target_url", "kind"))
    return nodes.select("page_id", "inlinks", "outlinks", "score", "orphan")


@query("q_architecture_top", _ARCHITECTURE + " SELECT crawl_id, page_id, inlinks, row_number() OVER (PARTITION BY crawl_id ORDER BY inlinks DESC, outlinks DESC, depth, page_id) AS rank FROM a QUALIFY rank <= 20")
def q_architecture_top(spark: SparkSession, sf: str) -> DataFrame:
    """Highest ranked pages of each crawl."""
    nodes = reads.architecture(ev.pages(spark, sf, "page_id", "depth", "status_code"), ev.links(spark, sf, "source_url", "target_url", "kind"))
    return reads.top_nodes(nodes, 20).select("crawl_id", "page_id", "inlinks", F.col("rank").cast("long").alias("rank"))


@query(
    "q_missing_links",
    WITH + """SELECT t.crawl_id, t.url, min(coalesce(p.depth, 0)) + 1 AS depth FROM (SELECT DISTINCT crawl_id, target_url AS url, source_url FROM link WHERE kind = 'internal' AND target_url IS NOT NULL) t
      LEFT JOIN page p ON p.crawl_id = t.crawl_id AND p.url = t.source_url
      WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.crawl_id = t.crawl_id AND f.url = t.url) GROUP BY ALL""",
)
def q_missing_links(spark: SparkSession, sf: str) -> DataFrame:
    """Link targets the frontier lacks."""
    return reads.missing_discoveries(ev.links(spark, sf, "source_url", "target_url", "kind"), ev.discovered(spark, sf), ev.pages(spark, sf, "depth"))


@query(
    "q_verify",
    WITH + """, a AS (SELECT crawl_id, count(*) AS pages, count(DISTINCT url) AS urls, count_if(coalesce(title, '') = '') AS without_title, count_if(content_hash IS NULL) AS without_hash FROM page GROUP BY ALL),
      o AS (SELECT crawl_id, count(*) AS n FROM (SELECT DISTINCT crawl_id, url FROM found) f WHERE NOT EXISTS (SELECT 1 FROM page p WHERE p.crawl_id = f.crawl_id AND p.url = f.url) GROUP BY ALL),
      l AS (SELECT crawl_id, count(*) AS n FROM link GROUP BY ALL), i AS (SELECT crawl_id, count(*) AS n FROM (SELECT DISTINCT * FROM issue) GROUP BY ALL)
      SELECT a.crawl_id, a.pages, a.urls, CAST(a.without_title AS BIGINT) AS without_title, CAST(a.without_hash AS BIGINT) AS without_hash, coalesce(o.n, 0) AS outstanding, coalesce(l.n, 0) AS links, coalesce(i.n, 0) AS issues,
      a.pages = a.urls AND coalesce(o.n, 0) = 0 AND a.without_hash = 0 AS pass
      FROM a LEFT JOIN o USING (crawl_id) LEFT JOIN l USING (crawl_id) LEFT JOIN i USING (crawl_id)""",
)
def q_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Invariants of every crawl."""
    return reads.verify(ev.pages(spark, sf, "title", "content_hash"), ev.links(spark, sf, "kind"), ev.discovered(spark, sf), _issues(spark, sf, "crawl_id", "issue_id"))


@query(
    "q_progress",
    """WITH d AS (SELECT DISTINCT crawl_id, crawl_url_id, url, discovery_kind, depth FROM discovery), p AS (SELECT DISTINCT crawl_id, url, true AS done FROM page_record)
      SELECT crawl_id, count(*) AS discovered, CAST(count_if(discovery_kind = 'seed') AS BIGINT) AS seeds, CAST(count_if(discovery_kind = 'sitemap') AS BIGINT) AS from_sitemaps,
      max(depth) AS max_depth, CAST(count_if(done IS NULL) AS BIGINT) AS queued FROM d LEFT JOIN p USING (crawl_id, url) GROUP BY crawl_id""",
)
def q_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Frontier counters of every crawl; queued are urls without a page yet."""
    kind = F.col("discovery_kind")
    done = table(spark, sf, "page_record", "crawl_id", "url").distinct().withColumn("done", F.lit(True))
    rows = ev.discovered(spark, sf).join(done, ["crawl_id", "url"], "left")
    return rows.groupBy("crawl_id").agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(kind == "seed").alias("seeds"), F.count_if(kind == "sitemap").alias("from_sitemaps"),
        F.max("depth").alias("max_depth"), F.count_if(F.col("done").isNull()).alias("queued"),
    )


@query("q_crawl_list", "SELECT crawl_id, project_id, status FROM (SELECT DISTINCT crawl_id, project_id, status FROM crawl_run) WHERE crawl_id > '4' ORDER BY crawl_id LIMIT 101")
def q_crawl_list(spark: SparkSession, sf: str) -> DataFrame:
    """A page of the list of crawls, after a key."""
    rows = table(spark, sf, "crawl_run", "crawl_id", "project_id", "status").distinct()
    return reads.keyset(rows, "crawl_id", after="4")


@query("q_observation_list", "SELECT observation_id, project_id, provider, scope FROM (SELECT DISTINCT observation_id, project_id, provider, scope FROM integration_observation) ORDER BY observation_id LIMIT 101")
def q_observation_list(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of the list of provider observations."""
    rows = table(spark, sf, "integration_observation", "observation_id", "project_id", "provider", "scope").distinct()
    return reads.keyset(rows, "observation_id")


_DIFF_FIELDS = ("title", "meta_description", "canonical_url", "robots_directives", "language", "content_hash", "text_length")


@query(
    "q_rendered_diff",
    "WITH "
    + ", ".join(
        f"{m} AS (SELECT * FROM page_record WHERE extraction_mode = '{m}' QUALIFY row_number() OVER (PARTITION BY url ORDER BY extracted_at DESC, page_id DESC) = 1)" for m in ("raw", "rendered")
    )
    + " UNION ALL ".join(
        ("" if i else " ") + f"SELECT a.url, '{f}' AS field, coalesce(CAST(a.{f} AS VARCHAR), '') AS a_value, coalesce(CAST(b.{f} AS VARCHAR), '') AS b_value FROM raw a JOIN rendered b USING (url) WHERE coalesce(CAST(a.{f} AS VARCHAR), '') <> coalesce(CAST(b.{f} AS VARCHAR), '')"
        for i, f in enumerate(_DIFF_FIELDS)
    ),
)
def q_rendered_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Fields that differ between the latest raw and the latest rendered extraction of a url, in long form."""
    rows = table(spark, sf, "page_record", "url", "page_id", "extracted_at", "extraction_mode", *_DIFF_FIELDS)
    latest = rows.groupBy("url", "extraction_mode").agg(F.max_by(F.struct(*_DIFF_FIELDS), F.struct("extracted_at", "page_id")).alias("p")).select("url", "extraction_mode", "p.*")
    return reads.field_differences(latest.filter("extraction_mode = 'raw'"), latest.filter("extraction_mode = 'rendered'"), ["url"], list(_DIFF_FIELDS))


@query("q_artifact_bytes", "SELECT crawl_id, CAST(coalesce(sum(decoded_bytes), 0) AS BIGINT) AS bytes, count(*) AS fetches FROM (SELECT DISTINCT fetch_id, crawl_id, decoded_bytes FROM fetch_result) GROUP BY crawl_id")
def q_artifact_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Stored bytes of every crawl."""
    rows = table(spark, sf, "fetch_result", "fetch_id", "crawl_id", "decoded_bytes").distinct()
    return rows.groupBy("crawl_id").agg(F.coalesce(F.sum("decoded_bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("fetches"))


@query(
    "q_segments",
    """SELECT crawl_id, segment, count(*) AS n, min(page_id) AS first_key, max(page_id) AS last_key, sha256(string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY CAST(page_id AS VARCHAR))) AS checksum FROM (SELECT crawl_id, page_id,
      CAST((row_number() OVER (PARTITION BY crawl_id ORDER BY page_id) - 1) // 100 AS BIGINT) AS segment FROM (SELECT DISTINCT crawl_id, page_id FROM page_record)) GROUP BY ALL""",
)
def q_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger of segments of a hundred pages with the checksum of their keys."""
    return reads.segments(table(spark, sf, "page_record", "crawl_id", "page_id"), "crawl_id", "page_id", 100)


@query(
    "q_storage_projection",
    """SELECT crawl_id, CAST(ceil(CAST(bytes AS DECIMAL(38,0)) * total / done) AS BIGINT) AS projected FROM
      (SELECT crawl_id, CAST(coalesce(sum(decoded_bytes), 0) AS BIGINT) AS bytes, count(*) AS done FROM (SELECT DISTINCT fetch_id, crawl_id, decoded_bytes FROM fetch_result) GROUP BY crawl_id)
      JOIN (SELECT crawl_id, count(DISTINCT crawl_url_id) AS total FROM discovery GROUP BY crawl_id) USING (crawl_id)""",
)
def q_storage_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes each crawl will need at its end."""
    done = q_artifact_bytes(spark, sf)
    total = ev.discovered(spark, sf).groupBy("crawl_id").agg(F.count(F.lit(1)).alias("total"))
    return done.join(total, "crawl_id").select("crawl_id", reads.projected_storage(F.col("bytes"), F.col("fetches"), F.col("total")).alias("projected"))


@query("q_due_schedules", "SELECT project_id, max(finished_at) AS last_run FROM crawl_run r WHERE NOT EXISTS (SELECT 1 FROM crawl_run a WHERE a.project_id = r.project_id AND a.finished_at IS NULL) GROUP BY project_id ORDER BY last_run, project_id LIMIT 10")
def q_due_schedules(spark: SparkSession, sf: str) -> DataFrame:
    """Projects due for another crawl: those without an open one, the longest idle first."""
    runs = table(spark, sf, "crawl_run", "project_id", "finished_at")
    last = runs.groupBy("project_id").agg(F.max("finished_at").alias("next_run")).withColumns({"schedule_id": F.col("project_id"), "enabled": F.lit(True)})
    out = reads.due(last, runs.filter("finished_at is null"), F.lit("9999-01-01").cast("timestamp"), 10)
    return out.select("project_id", F.col("next_run").alias("last_run"))


@query("q_next_version", "SELECT rule_id, coalesce(max(rule_version), 0) + 1 AS next_version FROM issue GROUP BY rule_id")
def q_next_version(spark: SparkSession, sf: str) -> DataFrame:
    """Next version of every rule."""
    return table(spark, sf, "issue", "rule_id", "rule_version").groupBy("rule_id").agg((F.coalesce(F.max("rule_version"), F.lit(0)) + 1).alias("next_version"))


@query("q_conformance")
def q_conformance(spark: SparkSession, sf: str) -> DataFrame:
    """Scorecard of the page rules against the cases' expected findings."""
    expected = table(spark, sf, "fixture_case", "case_id", "expected_findings").dropDuplicates(["case_id"]).select("case_id", F.inline("expected_findings"))
    return reads.scorecard(rp_page_findings(spark, sf), expected, "case_id")


@query(
    "q_coverage",
    """WITH c AS (SELECT DISTINCT case_id, expected_findings FROM fixture_case), e AS (SELECT case_id, unnest(expected_findings, recursive := true) FROM c),
      k AS (SELECT 'AUD-' || lpad(CAST(i AS VARCHAR), 2, '0') AS rule_id FROM range(1, 21) t(i)), a AS (SELECT count(*) AS controls FROM c WHERE len(expected_findings) = 0),
      q AS (SELECT rule_id, count(DISTINCT case_id) AS n FROM e GROUP BY rule_id)
      SELECT k.rule_id, coalesce(q.n, 0) AS positive_cases, a.controls AS control_cases, CASE WHEN q.n > 0 AND a.controls > 0 THEN 'baseline' WHEN q.n > 0 OR a.controls > 0 THEN 'partial' ELSE 'missing' END AS status
      FROM k CROSS JOIN a LEFT JOIN q USING (rule_id)""",
)
def q_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Which rules the cases cover: cases that expect a finding, and cases without any as controls."""
    cases = table(spark, sf, "fixture_case", "case_id", "expected_findings").dropDuplicates(["case_id"])
    known = [f"AUD-{i:02}" for i in range(1, 21)]
    # A case without findings is a control of every rule.
    clean = cases.filter(F.size("expected_findings") == 0).select("case_id", F.explode(F.array(*map(F.lit, known))).alias("rule_id"))
    catalog = spark.createDataFrame([(k,) for k in known], "rule_id string")
    return reads.coverage(catalog, cases.select("case_id", F.inline("expected_findings")), clean)


# Declarative extractions.

DEFINITIONS = [
    audits.Definition("title", "head > title"),
    audits.Definition("item-links", "//ul//li/a", mode="xpath", take="attribute", attribute="href", max_matches=1000),
    audits.Definition("headings", "h1", take="count"),
    audits.Definition("year", r"© (\d{4})", mode="regex", condition="regex", pattern="^20"),
]


@query("ca_audits")
def ca_audits(spark: SparkSession, sf: str) -> DataFrame:
    """Results of four definitions on all fetched documents."""
    return audits.run_audits(_html(spark, sf), "fetch_id", DEFINITIONS)


@query("ca_title", "SELECT DISTINCT fetch_id, trim(regexp_replace(regexp_extract(body, '(?is)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS value FROM fetch_result WHERE regexp_matches(body, '^\\s*<') AND regexp_matches(body, '(?i)<title>')")
def ca_title(spark: SparkSession, sf: str) -> DataFrame:
    """Values of one selector."""
    out = audits.run_audits(_html(spark, sf), "fetch_id", DEFINITIONS[:1])
    return out.filter("condition_met").select("fetch_id", F.explode("values").alias("value"))


# External metrics.


@query(
    "src_field_metrics",
    """SELECT observation_id, metric, json_extract_string(result, '$.metrics.' || metric || '.percentiles.p75') AS p75, CAST(json_array_length(result, '$.metrics.' || metric || '.histogram') AS BIGINT) AS bins
      FROM (SELECT observation_id, result, unnest(json_keys(result, '$.metrics')) AS metric FROM (SELECT DISTINCT observation_id, result FROM integration_observation
      WHERE provider = 'chrome-ux-report' AND json_valid(result) AND json_type(result::JSON) = 'OBJECT') WHERE json_type(result::JSON, '$.metrics') = 'OBJECT')""",
)
def src_field_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Field metrics of the observations, one row per metric; bins come as numbers or texts."""
    rows = table(spark, sf, "integration_observation", "observation_id", "provider", "result").filter("provider = 'chrome-ux-report'").select("observation_id", "result").distinct()
    parsed = rows.select("observation_id", F.from_json("result", "metrics map<string, struct<percentiles: struct<p75: string>, histogram: array<string>>>").alias("m"))
    out = parsed.select("observation_id", F.explode("m.metrics").alias("metric", "v"))
    return out.select("observation_id", "metric", F.col("v.percentiles.p75").alias("p75"), F.when(F.col("v.histogram").isNotNull(), F.size("v.histogram")).cast("long").alias("bins"))


_OBSERVED = """o AS (SELECT DISTINCT observation_id, provider, result FROM integration_observation),
  v AS (SELECT observation_id, provider, CASE WHEN json_type(result::JSON) = 'VARCHAR' THEN result::JSON->>'$' ELSE result END AS j FROM o WHERE json_valid(result)),
  j AS (SELECT observation_id, provider, j::JSON AS j FROM v WHERE json_valid(j) AND json_type(j::JSON) = 'OBJECT')"""


@query(
    "src_lab_scores",
    f"""WITH {_OBSERVED}, k AS (SELECT observation_id, j, 'score' AS kind, unnest(json_keys(j, '$.scores')) AS name FROM j WHERE provider = 'pagespeed-insights' AND json_type(j, '$.scores') = 'OBJECT'
      UNION ALL SELECT observation_id, j, 'metric', unnest(json_keys(j, '$.metrics')) FROM j WHERE provider = 'pagespeed-insights' AND json_type(j, '$.metrics') = 'OBJECT')
      SELECT observation_id, json_extract_string(j, '$.requested_url') AS requested_url, json_extract_string(j, '$.strategy') AS strategy, kind, name,
        TRY_CAST(json_extract_string(j, '$.' || kind || 's."' || name || '"') AS DOUBLE) AS value FROM k""",
)
def src_lab_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores and metrics of lab observations, one row each."""
    return metrics.lab(_observed(spark, sf, "pagespeed-insights"))


@query(
    "src_search_rows",
    f"""WITH {_OBSERVED}, r AS (SELECT observation_id, unnest(range(0, CAST(json_array_length(j, '$.rows') AS BIGINT))) AS position, j FROM j WHERE provider = 'google-search-console' AND json_type(j, '$.rows') = 'ARRAY'),
      s AS (SELECT observation_id, position, json_extract(j, '$.rows[' || position || ']') AS r FROM r)
      SELECT observation_id, CAST(position AS INTEGER) AS position, json_extract_string(r, '$.keys[0]') AS search_text, json_extract_string(r, '$.keys[1]') AS page, TRY_CAST(json_extract_string(r, '$.clicks') AS DOUBLE) AS clicks,
        TRY_CAST(json_extract_string(r, '$.impressions') AS DOUBLE) AS impressions, TRY_CAST(json_extract_string(r, '$.ctr') AS DOUBLE) AS ctr, TRY_CAST(json_extract_string(r, '$.position') AS DOUBLE) AS rank FROM s""",
)
def src_search_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Search performance rows of the observations, one row each."""
    return metrics.search(_observed(spark, sf, "google-search-console"))


@query(
    "src_analytics_rows",
    f"""WITH {_OBSERVED}, r AS (SELECT observation_id, unnest(range(0, CAST(json_array_length(j, '$.rows') AS BIGINT))) AS position, j FROM j WHERE provider = 'google-analytics-4' AND json_type(j, '$.rows') = 'ARRAY'),
      s AS (SELECT observation_id, position, json_extract_string(j, '$.property_id') AS property_id, json_extract(j, '$.rows[' || position || ']') AS r FROM r), k AS (SELECT *, unnest(json_keys(r)) AS name FROM s WHERE json_type(r) = 'OBJECT')
      SELECT observation_id, property_id, CAST(position AS INTEGER) AS position, name, json_extract_string(r, '$."' || name || '"') AS value FROM k""",
)
def src_analytics_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Analytics rows of the observations in long form, one row per dimension or metric."""
    return metrics.analytics(_observed(spark, sf, "google-analytics-4"))


def _observed(spark: SparkSession, sf: str, provider: str) -> DataFrame:
    return table(spark, sf, "integration_observation", "observation_id", "provider", "result").filter(F.col("provider") == provider).select("observation_id", "result").distinct()
