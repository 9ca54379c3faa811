"""Queries of the frontier, streaming and export operators, and those over role-played evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlmill.operators import frontier, graph
from crawlmill.plans import roles, site
from crawlmill.plans.site import Query
from crawlmill.sources import evidence as ev
from crawlmill.sources import exports
from crawlmill.sources.tables import table

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
    "st_frontier",
    """WITH RECURSIVE e AS (SELECT DISTINCT source_url, target_url FROM link_record WHERE kind = 'internal' AND source_url IS NOT NULL AND target_url IS NOT NULL AND source_url <> target_url),
      r(url, depth) AS (SELECT url, 0 FROM discovery WHERE discovery_kind = 'seed' AND url IS NOT NULL
        UNION SELECT e.target_url, r.depth + 1 FROM r JOIN e ON e.source_url = r.url WHERE r.depth < 30)
      SELECT url, min(depth) AS depth FROM r GROUP BY url""",
)
def st_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """Breadth-first crawl of the internal links from the seeds, until a round finds nothing new."""
    seeds = table(spark, sf, "discovery", "url", "discovery_kind").filter("discovery_kind = 'seed'")
    return frontier.crawl(seeds, table(spark, sf, "link_record", "source_url", "target_url", "kind").filter("kind = 'internal'")).select("url", "depth")


@query(
    "st_latest_attempt",
    "SELECT requested_url, fetch_id, status_code FROM (SELECT DISTINCT fetch_id, requested_url, status_code, started_at FROM fetch_result) WHERE requested_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY requested_url ORDER BY started_at DESC, fetch_id DESC) = 1",
)
def st_latest_attempt(spark: SparkSession, sf: str) -> DataFrame:
    """The last fetch of every url."""
    rows = table(spark, sf, "fetch_result", "requested_url", "fetch_id", "status_code", "started_at").filter("requested_url is not null")
    return frontier.latest_attempt(rows, "requested_url", ["started_at", "fetch_id"]).select("requested_url", "fetch_id", "status_code")


@query(
    "st_outcome",
    """SELECT requested_url, attempt, CASE WHEN status_code BETWEEN 200 AND 399 THEN 'analysed'
      WHEN status_code IN (408, 425, 429, 500, 502, 503, 504) AND attempt < 3 THEN 'retry_wait' ELSE 'failed' END AS state FROM (
      SELECT requested_url, status_code, row_number() OVER (PARTITION BY requested_url ORDER BY started_at, fetch_id) AS attempt, count(*) OVER (PARTITION BY requested_url) AS n
      FROM (SELECT DISTINCT fetch_id, requested_url, status_code, started_at FROM fetch_result WHERE requested_url IS NOT NULL)) WHERE attempt = n""",
)
def st_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """State of every url after its attempts."""
    rows = table(spark, sf, "fetch_result", "requested_url", "fetch_id", "status_code", "started_at").filter("requested_url is not null").distinct()
    attempts = rows.withColumn("attempt", F.row_number().over(Window.partitionBy("requested_url").orderBy("started_at", "fetch_id")))
    return frontier.outcome(attempts.select("requested_url", "attempt", "status_code"), "requested_url").select("requested_url", F.col("attempt").cast("long").alias("attempt"), "state")


STATES = ("pending", "running", "paused", "completed", "failed")


@query(
    "st_status_transitions",
    f"""WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events)),
      e AS (SELECT user_id, ts, event_id, {list(STATES)}[CAST((i - 1) % {len(STATES)} + 1 AS INT)] AS s FROM events JOIN k USING (event_type)),
      t AS (SELECT lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, s AS to_state FROM e)
      SELECT from_state, to_state, (from_state, to_state) IN ({", ".join(f"('{a}', '{b}')" for a, n in frontier.TRANSITIONS.items() for b in n)}) AS allowed, count(*) AS n
      FROM t WHERE from_state IS NOT NULL AND from_state <> to_state GROUP BY ALL""",
)
def st_status_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of state in the event log, whose types stand for crawl states in alphabetic order, and whether each is allowed."""
    rows = table(spark, sf, "events", "user_id", "ts", "event_id", "event_type")
    kinds = rows.select("event_type").distinct().withColumn("i", F.row_number().over(Window.partitionBy().orderBy("event_type")))  # a handful
    state = F.element_at(F.array(*map(F.lit, STATES)), ((F.col("i") - 1) % len(STATES) + 1).cast("int"))
    log = rows.join(kinds, "event_type").withColumn("state", state)
    return frontier.transitions(log, "user_id", "state", ["ts", "event_id"]).groupBy("from_state", "to_state", "allowed").agg(F.count(F.lit(1)).alias("n"))


@query(
    "st_host_politeness",
    "SELECT event_id, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS start_s FROM events",
)
def st_host_politeness(spark: SparkSession, sf: str) -> DataFrame:
    """Start times when each key gets one request at a time."""
    rows = table(spark, sf, "events", "event_id", "user_id", "ts", "value")
    return frontier.start_times(rows, "user_id", ["ts", "event_id"], "value").select("event_id", F.round("start_s", 3).alias("start_s"))


@query(
    "q_event_severity",
    """WITH r AS (SELECT DISTINCT crawl_id, status, finished_at FROM crawl_run)
      SELECT crawl_id, CASE WHEN status IN ('failed', 'limit_reached') OR finished_at IS NULL THEN 'warning' ELSE 'info' END AS severity FROM r""",
)
def q_event_severity(spark: SparkSession, sf: str) -> DataFrame:
    """Severity of the last event of every crawl, written as an event log writes it; a crawl without an end was recovered."""
    runs = table(spark, sf, "crawl_run", "crawl_id", "status", "finished_at").distinct()
    said = F.to_json(F.struct(F.col("status"), F.when(F.col("finished_at").isNull(), True).alias("recovered")))
    return runs.select("crawl_id", frontier.event_severity(said).alias("severity"))


@query(
    "st_lease",
    """WITH d AS (SELECT DISTINCT crawl_id, crawl_url_id, url, depth, discovery_kind FROM discovery)
      SELECT crawl_url_id, url, depth FROM d WHERE NOT EXISTS (SELECT 1 FROM page_record p WHERE p.crawl_id = d.crawl_id AND p.url = d.url)
      ORDER BY CASE discovery_kind WHEN 'seed' THEN 2 WHEN 'sitemap' THEN 1 ELSE 0 END DESC, coalesce(depth, 0), crawl_url_id LIMIT 1000""",
)
def st_lease(spark: SparkSession, sf: str) -> DataFrame:
    """The next thousand urls to fetch: those not extracted yet, seeds and sitemap entries first."""
    kind = F.col("discovery_kind")
    done = table(spark, sf, "page_record", "crawl_id", "url").distinct()
    open_ = ev.discovered(spark, sf).join(done, ["crawl_id", "url"], "left_anti")
    rows = open_.withColumns({"state": F.lit("queued"), "lease_until": F.lit(None).cast("timestamp"), "priority": F.when(kind == "seed", 2).when(kind == "sitemap", 1).otherwise(0)})
    return frontier.lease(rows, F.current_timestamp(), 1000).select("crawl_url_id", "url", "depth")


# Whole-site rules over role-played evidence, and all of them together.
_ROLE = "WITH " + roles.sql()


def _role(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [roles.role(spark, sf, f"r_{n}") for n in names]


@query("gr_exact_duplicates", _ROLE + " SELECT page_id, content_hash AS value, n - 1 AS copies FROM (SELECT *, count(*) OVER (PARTITION BY crawl_id, content_hash) AS n FROM r_page WHERE content_hash <> '') WHERE n > 1")
def gr_exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of equal content, with the number of others."""
    (pages,) = _role(spark, sf, "page")
    return graph.duplicates(pages, "content_hash").select("page_id", "value", (F.col("duplicate_count") - 1).alias("copies"))


@query(
    "gr_hreflang",
    _ROLE + """ SELECT h.page_id, h.language_code, h.target_url FROM r_hreflang h JOIN r_page s ON s.page_id = h.page_id LEFT JOIN r_page t ON t.url = h.target_url
      WHERE t.page_id IS NULL OR NOT EXISTS (SELECT 1 FROM r_hreflang b WHERE b.page_id = t.page_id AND b.target_url = s.url)""",
)
def gr_hreflang(spark: SparkSession, sf: str) -> DataFrame:
    """Language alternates that are not returned."""
    return graph.hreflang_without_return(*_role(spark, sf, "page", "hreflang")).drop("crawl_id")


_IMAGES = """SELECT i.crawl_id, i.image_id, coalesce(u.status_code, 0) AS status_code FROM r_image i LEFT JOIN r_url u ON u.url = i.url
      WHERE EXISTS (SELECT 1 FROM r_shown s JOIN r_page p ON p.page_id = s.page_id WHERE s.image_id = i.image_id) AND (u.state IS NULL OR u.state = 'failed' OR u.status_code >= 400)"""


@query("gr_image_fail", f"{_ROLE} {_IMAGES}")
def gr_image_fail(spark: SparkSession, sf: str) -> DataFrame:
    """Images of extracted pages whose fetch failed."""
    return graph.failing_images(*_role(spark, sf, "image", "shown", "page", "url"))


@query("gr_sitemap_failed", _ROLE + " SELECT sitemap_id, status FROM r_sitemap WHERE status <> 'ok'")
def gr_sitemap_failed(spark: SparkSession, sf: str) -> DataFrame:
    """Sitemap files that could not be read."""
    return graph.failed_sitemaps(*_role(spark, sf, "sitemap")).drop("crawl_id")


@query("gr_robots_blocked", _ROLE + " SELECT crawl_url_id, url FROM r_url WHERE robots_decision = 'disallowed'")
def gr_robots_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """Urls robots rules refuse."""
    return graph.robots_blocked(*_role(spark, sf, "url")).drop("crawl_id")


def _finalize_sql(role: bool = True) -> str:
    """All findings in SQL: the rules of both sites, then those only the role-played one has evidence for.

    Without ``role`` the rules of the delivered crawls alone.
    """
    out = []

    def add(rule: str, severity: str, kind: str, subject: str, evidence: str, rows: str) -> None:
        out.append(f"SELECT crawl_id, '{rule}' AS rule_id, '{severity}' AS severity, '{kind}' AS subject_type, CAST({subject} AS VARCHAR) AS subject_id, '{{' || {evidence} || '}}' AS evidence_json FROM ({rows})")

    member = lambda name, value: f"""'"{name}":' || {value}"""
    both = lambda *m: " || ',' || ".join(m)
    noindex = "lower(coalesce({0}.robots_directives, '')) LIKE '%noindex%'"
    for page, link, found, url in (("page", "link", "entry", "known"), ("r_page", "r_link", "r_found", "r_url"))[: 1 + role]:
        bad = "(t.state IS NULL OR t.state = 'failed' OR t.status_code >= 400)"
        add("AUD-01", "error", "link", "link_id", member("status_code", "s"), f"SELECT l.crawl_id, l.link_id, coalesce(t.status_code, 0) AS s FROM {link} l LEFT JOIN {url} t ON t.crawl_id = l.crawl_id AND t.url = l.target_url WHERE l.kind = 'internal' AND l.target_url IS NOT NULL AND {bad}")
        for field in ("title", "meta_description"):
            add("AUD-02", "warning", "page", "page_id", both(f"""'"field":"{field}"'""", member("duplicate_count", "n")), f"SELECT * FROM (SELECT crawl_id, page_id, count(*) OVER (PARTITION BY crawl_id, {field}) AS n FROM {page} WHERE trim(coalesce({field}, '')) <> '') WHERE n > 1")
        add(
            "AUD-04", "error", "page", "page_id", both(member("target_status", "s"), member("target_crawled", "c"), member("target_noindex", "x")),
            f"""SELECT * FROM (SELECT p.crawl_id, p.page_id, p.canonical_url, coalesce(t.status_code, 0) AS s, t.url IS NOT NULL AS c, coalesce(q.canonical_url, '') AS o, coalesce({noindex.format('q')}, false) AS x FROM {page} p
              LEFT JOIN {url} t ON t.crawl_id = p.crawl_id AND t.url = p.canonical_url LEFT JOIN {page} q ON q.crawl_id = t.crawl_id AND q.url = t.url WHERE p.canonical_url IS NOT NULL) WHERE NOT c OR s <> 200 OR (o <> '' AND o <> canonical_url) OR x""",
        )
        add("AUD-06", "info", "page", "page_id", member("in_sitemap", "false"), f"SELECT * FROM {page} p WHERE status_code = 200 AND NOT {noindex.format('p')} AND NOT EXISTS (SELECT 1 FROM {found} f WHERE f.crawl_id = p.crawl_id AND f.url = p.url)")
        add(
            "AUD-06", "warning", "url", "url", both(member("status_code", "s"), member("noindex", "x")),
            f"""SELECT * FROM (SELECT f.crawl_id, f.url, coalesce(t.status_code, 0) AS s, coalesce({noindex.format('q')}, false) AS x FROM (SELECT DISTINCT * FROM {found}) f
              LEFT JOIN {url} t ON t.crawl_id = f.crawl_id AND t.url = f.url LEFT JOIN {page} q ON q.crawl_id = t.crawl_id AND q.url = t.url) WHERE s <> 200 OR x""",
        )
        add("AUD-08", "warning", "page", "page_id", member("duplicate_count", "(n - 1)"), f"SELECT * FROM (SELECT crawl_id, page_id, count(*) OVER (PARTITION BY crawl_id, content_hash) AS n FROM {page} WHERE trim(coalesce(content_hash, '')) <> '') WHERE n > 1")
        add("AUD-11", "warning", "page", "page_id", both(member("depth", "depth"), member("threshold", "4")), f"SELECT * FROM {page} WHERE depth > 4")
        add("AUD-11", "warning", "page", "page_id", member("inlinks", "0"), f"SELECT * FROM {page} p WHERE depth > 0 AND NOT EXISTS (SELECT 1 FROM {link} l WHERE l.crawl_id = p.crawl_id AND l.kind = 'internal' AND l.target_url = p.url)")
        add("AUD-11", "info", "page", "page_id", member("nofollow_links", "n"), f"SELECT p.crawl_id, p.page_id, count(*) AS n FROM {page} p JOIN {link} l ON l.crawl_id = p.crawl_id AND l.source_url = p.url WHERE l.kind = 'internal' AND (' ' || lower(replace(l.rel, ',', ' ')) || ' ') LIKE '% nofollow %' GROUP BY p.crawl_id, p.page_id")
    if role:
        add("AUD-06", "error", "sitemap", "sitemap_id", """'"status":"' || status || '"'""", "SELECT * FROM r_sitemap WHERE status <> 'ok'")
        add("AUD-07", "warning", "url", "crawl_url_id", """'"robots_decision":"disallowed"'""", "SELECT * FROM r_url WHERE robots_decision = 'disallowed'")
        add(
            "AUD-09", "warning", "page", "page_id", """'"hreflang":"' || language_code || '","reciprocal":false'""",
            """SELECT h.crawl_id, h.page_id, h.language_code FROM r_hreflang h JOIN r_page s ON s.page_id = h.page_id LEFT JOIN r_page t ON t.url = h.target_url
              WHERE t.page_id IS NULL OR NOT EXISTS (SELECT 1 FROM r_hreflang b WHERE b.page_id = t.page_id AND b.target_url = s.url)""",
        )
        add("AUD-10", "error", "image", "image_id", member("status_code", "status_code"), _IMAGES)
        add("AUD-08", "warning", "page", "id", both(member("hamming_distance", "distance"), member("match", "match_id")), f"SELECT '{roles.CRAWL}' AS crawl_id, * FROM similar_pages")
    similar = site.ORACLES["gr_near_duplicates"].replace("WITH ", "", 1)
    head, tail = similar.rsplit("SELECT id, match_id", 1)
    views = f"""WITH {ev.SQL}, known AS (SELECT crawl_id, url, CASE WHEN coalesce(status_code, 0) = 0 THEN 'failed' ELSE 'analysed' END AS state, status_code FROM page),
      entry AS (SELECT crawl_id, url FROM found WHERE discovery_kind = 'sitemap'), {roles.sql()}, {head.rstrip()}, similar_pages AS (SELECT id, match_id{tail}), every AS ({' UNION ALL '.join(out)})"""
    return f"""{views} SELECT *, CASE WHEN severity = 'info' THEN 'information' WHEN rule_id IN ('AUD-01', 'AUD-07', 'AUD-09', 'AUD-10', 'AUD-04') THEN 'deterministic' WHEN rule_id = 'AUD-02' THEN 'recommendation'
        WHEN rule_id = 'AUD-08' AND evidence_json NOT LIKE '%hamming_distance%' THEN 'deterministic' WHEN rule_id IN ('AUD-08', 'AUD-11') THEN 'recommendation' ELSE 'review' END AS classification,
      CASE WHEN rule_id = 'AUD-06' THEN 'sitemap' WHEN subject_type IN ('link', 'image', 'url') OR rule_id IN ('AUD-08', 'AUD-11') THEN 'graph' ELSE 'raw' END AS evidence_source FROM every"""


@query("gr_finalize_delivered", _finalize_sql(role=False))
def gr_finalize_delivered(spark: SparkSession, sf: str) -> DataFrame:
    """The findings of the delivered crawls alone, by the rules they have evidence for."""
    return graph.finalize(ev.pages(spark, sf), ev.links(spark, sf, "source_url", "target_url", "rel", "kind"), ev.discovered(spark, sf))


@query("gr_finalize", _finalize_sql())
def gr_finalize(spark: SparkSession, sf: str) -> DataFrame:
    """All whole-site findings of the delivered crawls and of the role-played one, which has evidence for every rule."""
    pages, links, found, urls, sitemaps, alternates, images, shown = _role(spark, sf, "page", "link", "found", "url", "sitemap", "hreflang", "image", "shown")
    similar = site.gr_near_duplicates(spark, sf).withColumn("crawl_id", F.lit(roles.CRAWL))
    own = ev.pages(spark, sf, *[c for c in pages.columns if c not in ("crawl_id", "url")])
    every = [
        own.unionByName(pages),
        ev.links(spark, sf, "source_url", "target_url", "rel", "kind").unionByName(links),
        ev.discovered(spark, sf).filter("discovery_kind = 'sitemap'").select("crawl_id", "url", "discovery_kind").distinct().unionByName(found, allowMissingColumns=True),
        graph.url_states(own).unionByName(urls.select("crawl_id", "url", "state", "status_code")),
    ]
    return graph.finalize(*every, sitemaps, urls, alternates, images, shown, similar)


# Sinks, as the frames they write.


_REPORT = ("page_id", "url", "title", "meta_description", "canonical_url", "robots_directives", "content_hash", "status_code", "depth", "extraction_mode", "text_length")


@query(
    "snk_pages",
    "WITH " + ev.SQL + " SELECT " + ", ".join(f"CASE WHEN regexp_matches(CAST({c} AS VARCHAR), '^[\\t\\r\\n ]*[=+@-]') THEN chr(39) || CAST({c} AS VARCHAR) ELSE CAST({c} AS VARCHAR) END AS {c}" for c in _REPORT) + " FROM page",
)
def snk_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of the page report as they are written."""
    rows = ev.pages(spark, sf, *[c for c in _REPORT if c != "url"])
    return rows.select(*[exports.guarded(F.col(c)).alias(c) for c in _REPORT])


@query(
    "snk_bundle",
    "WITH " + ev.SQL + """, a AS (SELECT crawl_id, count(*) AS pages, count(*) FILTER (status_code >= 400) AS failing FROM page GROUP BY crawl_id),
      b AS (SELECT crawl_id, string_agg('"' || rule_id || '":' || n, ',' ORDER BY rule_id) AS m FROM (SELECT crawl_id, rule_id, count(*) AS n FROM (SELECT DISTINCT issue_id, crawl_id, rule_id FROM issue) WHERE rule_id IS NOT NULL GROUP BY ALL) GROUP BY crawl_id)
      SELECT crawl_id, '{"pages":' || pages || ',"failing":' || failing || coalesce(',"issues":{' || m || '}', '') || '}' AS bundle FROM a LEFT JOIN b USING (crawl_id)""",
)
def snk_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata-only diagnostics of every crawl."""
    issues = table(spark, sf, "issue", "issue_id", "crawl_id", "rule_id").filter("rule_id is not null").distinct()
    return exports.bundle(ev.pages(spark, sf, "status_code"), issues)


_SEGMENT = ("url", "title", "content_hash", "status_code", "depth", "text_length", "extracted_at", "page_id")


@query(
    "snk_manifest",
    f"""SELECT crawl_id, count(*) AS rows, CAST(sum(('0x' || substr(md5(concat_ws(chr(31), {', '.join(f"coalesce(CAST({'epoch_us(extracted_at)' if c == 'extracted_at' else c} AS VARCHAR), chr(0))" for c in sorted(_SEGMENT))})), 1, 15))::BIGINT) AS VARCHAR) AS checksum
      FROM page_record GROUP BY crawl_id""",
)
def snk_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and checksums of the page snapshot by crawl."""
    return exports.manifest(table(spark, sf, "page_record", "crawl_id", *_SEGMENT), "crawl_id")
