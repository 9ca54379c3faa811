"""Queries of operators that other plans don't reach: previews, policies, seeds, sitemaps, vocabulary, artifacts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlmill.functions import html, robots, urls
from crawlmill.operators import frontier, reads, rules
from crawlmill.plans import roles
from crawlmill.plans.site import SCOPE_EXCLUDE, SCOPE_INCLUDE, SCOPE_QUERY, Query, _html
from crawlmill.session import shared_folder
from crawlmill.sources import exports
from crawlmill.sources.tables import table
from crawlmill.streaming import progress

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    """Register a query and the SQL it equals."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "url_same",
    """SELECT kind, count(*) AS n FROM link_record WHERE target_url IS NOT NULL AND source_url IS NOT NULL
      AND regexp_replace(target_url, '#.*$', '') = regexp_replace(source_url, '#.*$', '') GROUP BY kind""",
)
def url_same(spark: SparkSession, sf: str) -> DataFrame:
    """Links of a page to itself, fragments aside."""
    rows = table(spark, sf, "link_record", "source_url", "target_url", "kind").filter("target_url is not null and source_url is not null")
    return rows.filter(urls.same_url(F.col("target_url"), F.col("source_url"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "url_preview",
    f"""WITH u AS (SELECT DISTINCT url FROM page_record WHERE url IS NOT NULL ORDER BY url LIMIT 100),
      v AS (SELECT url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS h, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM u)
      SELECT url, CASE WHEN NOT (h = 'merrovik.example' OR suffix(h, '.merrovik.example')) THEN 'host is outside crawl scope' WHEN NOT regexp_matches(p, '{SCOPE_INCLUDE}') THEN 'path does not match include scope'
        WHEN regexp_matches(p, '{SCOPE_EXCLUDE}') THEN 'path matches exclude scope' WHEN regexp_matches(q, '{SCOPE_QUERY}') THEN 'query matches exclude scope' ELSE 'allowed' END AS decision FROM v""",
)
def url_preview(spark: SparkSession, sf: str) -> DataFrame:
    """Scope decisions of the first hundred urls, which is as many as a preview shows."""
    first = table(spark, sf, "page_record", "url").filter("url is not null").distinct().orderBy("url").limit(100)
    return first.select("url", urls.scope_decision(F.col("url"), ["merrovik.example"], True, [SCOPE_INCLUDE], [SCOPE_EXCLUDE], None, [SCOPE_QUERY]).alias("decision"))


@query(
    "url_robots_policy",
    """SELECT policy, count(*) AS n FROM (SELECT CASE WHEN status_code BETWEEN 200 AND 299 THEN 'parse' WHEN status_code IN (401, 403) THEN 'disallow_all' WHEN status_code IN (404, 410) THEN 'allow_all' ELSE 'retry' END AS policy
      FROM (SELECT DISTINCT fetch_id, status_code FROM fetch_result)) GROUP BY policy""",
)
def url_robots_policy(spark: SparkSession, sf: str) -> DataFrame:
    """What the status of every fetch would mean, were it that of a robots file."""
    rows = table(spark, sf, "fetch_result", "fetch_id", "status_code").distinct()
    return rows.groupBy(urls.robots_status_policy(F.col("status_code")).alias("policy")).agg(F.count(F.lit(1)).alias("n"))


_OCTETS = "SELECT c_custkey, c_custkey * 7919 % 256 AS a, c_custkey * 104729 % 256 AS b, c_custkey % 256 AS c, c_custkey * 31 % 256 AS d FROM {0}"


@query(
    "url_ip",
    f"""SELECT c_custkey, CASE WHEN a = 127 THEN 'loopback' WHEN a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) THEN 'private' WHEN a = 169 AND b = 254 THEN 'link_local'
      WHEN a BETWEEN 224 AND 239 THEN 'multicast' WHEN a = 0 AND b = 0 AND c = 0 AND d = 0 THEN 'unspecified' WHEN a = 255 AND b = 255 AND c = 255 AND d = 255 THEN 'non_global'
      WHEN a = 0 OR a >= 240 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b BETWEEN 18 AND 19) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) THEN 'reserved'
      ELSE 'public' END AS class FROM ({_OCTETS.format('customer')})""",
)
def url_ip(spark: SparkSession, sf: str) -> DataFrame:
    """Class of addresses role-played from the customers' keys."""
    key = F.col("c_custkey")
    octets = [key * 7919 % 256, key * 104729 % 256, key % 256, key * 31 % 256]
    return table(spark, sf, "customer", "c_custkey").select("c_custkey", urls.ip_class(F.concat_ws(".", *[o.cast("string") for o in octets])).alias("class"))


@query(
    "src_seeds",
    "SELECT CAST(row_number() OVER (ORDER BY p) AS BIGINT) AS number, url FROM (SELECT url, min(crawl_url_id) AS p FROM discovery WHERE discovery_kind = 'seed' AND url IS NOT NULL GROUP BY url)",
)
def src_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds as an ordered list, each url at its first place."""
    from pyspark.sql import Window

    rows = table(spark, sf, "discovery", "crawl_url_id", "url", "discovery_kind").filter("discovery_kind = 'seed'")
    first = frontier.seeds_of_list(rows, "crawl_url_id", "url")  # at most ten thousand
    return first.select(F.row_number().over(Window.partitionBy().orderBy("position")).cast("long").alias("number"), "url")


SYNTHETIC_PAGES = 20_000


@query(
    "src_synthetic",
    f"""WITH l AS (SELECT i, 10 * i + k AS t FROM range(0, {SYNTHETIC_PAGES}) a(i), range(1, 11) b(k))
      SELECT 'https://site.example/p/' || i AS source_url, count(*) AS links, max(t) AS last FROM l WHERE t < {SYNTHETIC_PAGES} GROUP BY i""",
)
def src_synthetic(spark: SparkSession, sf: str) -> DataFrame:
    """Links of the synthetic campaign by source."""
    links = frontier.synthetic(spark, SYNTHETIC_PAGES)
    return links.groupBy("source_url").agg(F.count(F.lit(1)).alias("links"), F.max(F.regexp_extract("target_url", r"(\d+)$", 1).cast("long")).alias("last"))


@query(
    "src_sitemaps",
    f"""WITH {roles.sql()}, m AS (SELECT sitemap_id, count(*) AS n FROM r_found GROUP BY sitemap_id)
      SELECT 'https://shop.example/sitemap.xml' AS sitemap_url, 0 AS depth, 'sitemapindex' AS kind, count(*) + 1 AS locations FROM m
      UNION ALL SELECT 'https://shop.example/sitemap-' || sitemap_id || '.xml', 1, 'urlset', n FROM m UNION ALL SELECT 'https://shop.example/sitemap-gone.xml', 1, 'missing', 0""",
)
def src_sitemaps(spark: SparkSession, sf: str) -> DataFrame:
    """An index of sitemap files and what each lists, parsed from XML and followed from the top; one file is missing."""
    entry = lambda tag, u: F.concat(F.lit(f"<{tag}><loc>"), u, F.lit(f"</loc></{tag}>"))
    name = lambda c: F.concat(F.lit("https://shop.example/sitemap-"), c, F.lit(".xml"))
    whole = lambda tag, c: F.concat(F.lit(f'<{tag} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(c, ""), F.lit(f"</{tag}>"))
    listed = roles.role(spark, sf, "r_found").groupBy("sitemap_id").agg(whole("urlset", F.collect_list(entry("url", F.col("url")))).alias("body"))
    files = listed.select(name(F.col("sitemap_id").cast("string")).alias("sitemap_url"), "body")
    own = F.concat(F.collect_list(entry("sitemap", F.col("sitemap_url"))), F.array(entry("sitemap", name(F.lit("gone")))))
    top = F.lit("https://shop.example/sitemap.xml")
    index = files.agg(whole("sitemapindex", own).alias("body")).select(top.alias("sitemap_url"), "body")
    found = robots.discover_sitemaps(index.select("sitemap_url"), files.unionByName(index))
    return found.select("sitemap_url", "depth", "kind", F.coalesce(F.size("locations"), F.lit(0)).cast("long").alias("locations")).withColumn("locations", F.greatest("locations", F.lit(0).cast("long")))


# A small vocabulary, as a file of terms would give it.
TYPES = ("Answer", "Article", "BreadcrumbList", "ListItem", "Offer", "Organization", "Person", "Place", "PostalAddress", "Product", "Question", "Review", "Thing")
NEWER = {"ImageObject": "MediaObject", "FAQPage": "WebPage"}


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "structured_data", "structured_data_id", "evidence_json").distinct()
    said = F.from_json("evidence_json", "types array<string>, properties array<string>, contexts array<string>, nodes array<struct<path: string, types: array<string>, properties: array<string>>>")
    empty = F.array().cast("array<string>")
    rows = rows.select("structured_data_id", said.alias("s")).filter("s is not null")
    return rows.select("structured_data_id", F.lit(0).alias("block_index"), *[F.coalesce(F.col(f"s.{c}"), empty).alias(c) for c in ("types", "properties", "contexts")], F.col("s.nodes").alias("nodes"))


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("type", t, None) for t in TYPES] + [("type", t, n) for t, n in NEWER.items()], "kind string, name string, superseded_by string")


_LIST = "(" + ", ".join(f"'{t}'" for t in (*TYPES, *NEWER)) + ")"


@query(
    "rp_vocabulary",
    f"""WITH s AS (SELECT DISTINCT structured_data_id, evidence_json FROM structured_data WHERE json_valid(evidence_json)),
      o AS (SELECT structured_data_id, evidence_json::JSON AS j FROM s WHERE json_type(evidence_json::JSON) = 'OBJECT'),
      c AS (SELECT structured_data_id, j, coalesce(list_bool_or(list_transform(CASE WHEN json_type(j, '$.contexts') = 'ARRAY' THEN json_extract_string(j, '$.contexts[*]') END, lambda x: rtrim(lower(trim(x)), '/') IN ('https://schema.org', 'http://schema.org'))), false) AS own FROM o),
      t AS (SELECT structured_data_id, own, unnest(CASE WHEN json_type(j, '$.types') = 'ARRAY' THEN json_extract_string(j, '$.types[*]') END) AS t FROM c),
      n AS (SELECT structured_data_id, regexp_replace(trim(t), '^(schema:|https?://schema\\.org/)', '', 'i') AS name FROM t WHERE own OR regexp_matches(lower(trim(t)), '^(schema:|https?://schema[.]org/)'))
      SELECT structured_data_id, name, CASE WHEN name NOT IN {_LIST} THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM n WHERE name <> '' AND NOT regexp_matches(name, '[:/]') AND (name NOT IN {_LIST} OR name IN ('{"', '".join(NEWER)}')) GROUP BY ALL""",
)
def rp_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Unknown and superseded types of the structured data, by a small vocabulary."""
    blocks = _blocks(spark, sf).withColumn("properties", F.array().cast("array<string>"))
    found = rules.vocabulary_findings(blocks, ["structured_data_id"], _terms(spark))
    return found.groupBy("structured_data_id", "name", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("rp_guidance")
def rp_guidance(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes whose types fit none of a property's domains or ranges, by a small vocabulary."""
    nodes = _blocks(spark, sf).select("structured_data_id", "block_index", F.inline("nodes")).filter("types is not null and properties is not null and path is not null")
    properties = spark.createDataFrame([("price", ["Offer"], []), ("review", ["Product", "Organization"], ["Review"]), ("address", ["Organization", "Person"], ["PostalAddress"])], "name string, domains array<string>, ranges array<string>")
    parents = spark.createDataFrame([("Product", "Thing"), ("Organization", "Thing"), ("Person", "Thing"), ("Article", "Thing"), ("Offer", "Thing"), ("Review", "Thing"), ("PostalAddress", "Thing")], "name string, parent string")
    return rules.guidance_findings(nodes, ["structured_data_id"], properties, rules.type_closure(parents))


@query("ext_discovered")
def ext_discovered(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred distinct references of every fetched document, those of link elements included."""
    rows = _html(spark, sf).select("fetch_id", html.discovered(F.col("url"), F.col("body"), 100).alias("found"))
    return rows.select("fetch_id", F.posexplode("found").alias("position", "url"))


@query("q_record_diff")
def q_record_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Fields that differ between the records of the first and the last document fetched for a url, in long form."""
    rows = table(spark, sf, "fetch_result", "fetch_id", "requested_url", "final_url", "body", "started_at").filter("body is not null and body rlike '^\\\\s*<' and requested_url is not null")
    ends = rows.groupBy("requested_url").agg(F.min(F.struct("started_at", "fetch_id")).alias("a"), F.max(F.struct("started_at", "fetch_id")).alias("b")).filter("a.fetch_id <> b.fetch_id")
    own = rows.dropDuplicates(["fetch_id"]).select("fetch_id", html.page(F.coalesce("final_url", "requested_url"), F.col("body")).alias("page"))
    side = lambda name: ends.select("requested_url", F.col(f"{name}.fetch_id").alias("fetch_id")).join(own, "fetch_id").select("requested_url", "page")
    return reads.record_differences(side("a"), side("b"), ["requested_url"])


@query("st_committed", "SELECT crawl_id, count(*) AS rows, count(DISTINCT crawl_url_id) AS urls FROM discovery GROUP BY crawl_id")
def st_committed(spark: SparkSession, sf: str) -> DataFrame:
    """Discoveries as a stream of files, committed batch by batch; a stream that starts over replaces what it wrote."""
    rows = table(spark, sf, "discovery", "crawl_id", "crawl_url_id")
    folder = f"{shared_folder(spark)}/st_committed-{uuid.uuid4().hex}"
    stream = progress.file_stream(spark, f"{sf}/discovery.parquet*", table(spark, sf, "discovery").schema).select(*rows.columns)
    for attempt in range(2):  # the second one has lost its checkpoint
        progress.commit_batches(stream, f"{folder}/rows", f"{folder}/checkpoint-{attempt}").awaitTermination()
    return spark.read.parquet(f"{folder}/rows").groupBy("crawl_id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("crawl_url_id").alias("urls"))


# Sinks.

_ISSUE = ("issue_id", "crawl_id", "rule_id", "rule_version", "subject_type", "subject_id", "severity", "classification", "evidence_source")


@query(
    "snk_issues",
    "SELECT " + ", ".join(f"CASE WHEN regexp_matches(CAST({c} AS VARCHAR), '^[\\t\\r\\n ]*[=+@-]') THEN chr(39) || CAST({c} AS VARCHAR) ELSE CAST({c} AS VARCHAR) END AS {c}" for c in (*_ISSUE, "evidence_json")) + " FROM (SELECT DISTINCT * FROM issue)",
)
def snk_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of the issue report as they are written."""
    rows = table(spark, sf, "issue").dropDuplicates(["issue_id"])
    return rows.select(*[exports.guarded(F.col(c)).alias(c) for c in (*_ISSUE, "evidence_json")])


@query(
    "snk_expired",
    """WITH a AS (SELECT DISTINCT fetch_id, crawl_id, decoded_bytes, started_at + INTERVAL 30 DAY AS expires_at FROM fetch_result), n AS (SELECT max(started_at) AS now FROM fetch_result)
      SELECT crawl_id, count(*) AS expired, CAST(coalesce(sum(decoded_bytes), 0) AS BIGINT) AS bytes FROM a, n WHERE expires_at <= now GROUP BY crawl_id""",
)
def snk_expired(spark: SparkSession, sf: str) -> DataFrame:
    """Artifacts past their thirty days at the time of the last fetch, by crawl."""
    rows = table(spark, sf, "fetch_result", "fetch_id", "crawl_id", "decoded_bytes", "started_at").distinct()
    now = rows.agg(F.max("started_at")).first()[0]
    held = rows.withColumn("expires_at", F.col("started_at") + F.expr("interval 30 day"))
    return exports.expired(held, F.lit(now)).groupBy("crawl_id").agg(F.count(F.lit(1)).alias("expired"), F.coalesce(F.sum("decoded_bytes"), F.lit(0)).alias("bytes"))


@query(
    "snk_orphaned",
    "SELECT DISTINCT requested_url AS path FROM fetch_result f WHERE requested_url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM page_record p WHERE p.url = f.requested_url)",
)
def snk_orphaned(spark: SparkSession, sf: str) -> DataFrame:
    """Stored documents no page record names."""
    files = table(spark, sf, "fetch_result", "requested_url").filter("requested_url is not null").select(F.col("requested_url").alias("path")).distinct()
    return exports.orphaned_files(files, table(spark, sf, "page_record", "url").select(F.col("url").alias("path")))
