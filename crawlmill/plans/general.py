"""Queries of the general training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlmill.operators import flatten, hierarchy, keystats, snapshots
from crawlmill.sources.tables import table


def hierarchies(spark: SparkSession, sf: str, paths: bool = True) -> DataFrame:
    """Discovery trees and redirect chains in one pass; keys carry the kind of their tree."""
    found = table(spark, sf, "discovery", "crawl_url_id", "discovered_from", "depth").select(
        F.concat(F.lit("d:"), F.col("crawl_url_id").cast("string")).alias("key"),
        F.concat(F.lit("d:"), F.col("discovered_from").cast("string")).alias("parent"),
        F.col("depth").cast("long").alias("recorded"),
    )
    hops = table(spark, sf, "fetch_result", "redirects").select(F.explode("redirects").alias("h")).select("h.source_url", "h.target_url")
    sources = hops.filter("source_url is not null").groupBy("source_url").agg(F.min("target_url").alias("target_url"))
    chains = sources.select(F.concat(F.lit("r:"), F.col("source_url")).alias("key"), F.concat(F.lit("r:"), F.col("target_url")).alias("parent"), F.lit(None).cast("long").alias("recorded"))
    return hierarchy.hierarchy(found.unionByName(chains), paths=paths)


def _tree_kind(key: str = "key"):  # noqa: ANN202
    return F.when(F.substring(key, 1, 1) == "d", "discovery").otherwise("redirect")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes on or below circles, below lost roots, with a wrong depth, or too deep in a redirect chain."""
    h = hierarchies(spark, sf, paths=False)
    steps = F.col("depth")
    finding = (
        F.when(F.col("state") != "tree", F.col("state"))
        .when(_tree_kind() == "redirect", F.when(steps > 10, "too_deep"))
        .when(F.col("root_lost"), "lost_root")
        .when(F.col("recorded") != steps, "wrong_depth")
    )
    real = h.filter((_tree_kind() == "redirect") | ~F.col("lost"))
    return real.select(_tree_kind().alias("tree_kind"), F.expr("substring(key, 3)").alias("node_key"), finding.alias("finding")).filter("finding is not null")


def p3_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Path, depth, root and number of descendants of each node."""
    h = hierarchies(spark, sf).filter((_tree_kind() == "redirect") | ~F.col("lost"))
    names = F.transform("path", lambda k: F.substring(k, 3, 1_000_000))
    return h.select(
        _tree_kind().alias("tree_kind"), F.expr("substring(key, 3)").alias("node_key"), F.expr("substring(root, 3)").alias("root_key"),
        "depth", F.array_join(names, " > ").alias("path"), "n_descendants", "state",
    )


def p3_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Each node with each of its descendants, and how many steps below it they are."""
    h = hierarchies(spark, sf).filter((_tree_kind() == "redirect") | ~F.col("lost"))
    pairs = h.select(_tree_kind().alias("tree_kind"), F.expr("substring(key, 3)").alias("descendant_key"), F.posexplode("path").alias("at", "above"), "depth")
    return pairs.filter("at < depth").select("tree_kind", F.expr("substring(above, 3)").alias("node_key"), "descendant_key", (F.col("depth") - F.col("at")).alias("steps"))


URL_SHARE = 0.02


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Urls on at least two percent of all links, as targets and as sources."""
    links = table(spark, sf, "link_record", "target_url", "source_url")
    found = [keystats.heavy_keys(links, k, URL_SHARE) for k in ("target_url", "source_url")]
    return found[0].unionByName(found[1]).select("key_field", "key_value")


def p5_url_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Links, distinct partners and distinct anchors of every target and source url."""
    links = table(spark, sf, "link_record", "target_url", "source_url", "anchor_text")
    return keystats.url_figures(links, {"target_url": "source_url", "source_url": "target_url"}, "anchor_text")


def _completed(spark: SparkSession, sf: str) -> DataFrame:
    """Completed crawls with their running number in the project."""
    runs = table(spark, sf, "crawl_run", "crawl_id", "project_id", "started_at", "status").filter("status = 'completed'").select("crawl_id", "project_id", "started_at").distinct()
    return runs.withColumn("number", F.row_number().over(Window.partitionBy("project_id").orderBy("started_at", "crawl_id")).cast("long"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Urls added, removed or changed from one completed crawl of a project to the next."""
    runs = _completed(spark, sf)
    pages = table(spark, sf, "page_record", "crawl_id", "page_id", "url", "title", "content_hash", "status_code", "extracted_at")
    rows = pages.join(runs.select("crawl_id", "project_id", "number"), "crawl_id")
    watched = {
        "title": F.coalesce("title", F.lit("")),
        "content_hash": F.coalesce("content_hash", F.lit("")),
        "status_code": F.coalesce("status_code", F.lit(0)),
    }
    bounds = runs.groupBy("project_id").agg(F.min("number").alias("first"), F.max("number").alias("last"))
    found = snapshots.snapshot_changes(rows, "project_id", "number", "url", watched, ["extracted_at", "page_id"], bounds)
    return found.join(runs.select("project_id", "number", "crawl_id"), ["project_id", "number"]).select("crawl_id", "url", "change_kind")


JSON_FIELDS = (("structured_data", "structured_data", "structured_data_id", "evidence_json"), ("issue", "issue", "issue_id", "evidence_json"), ("observation", "integration_observation", "observation_id", "result"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every object inside a JSON field but the outermost."""
    found = [flatten.flatten(table(spark, sf, name, key, field), kind, key, field, ("object_path",), ("object",)) for kind, name, key, field in JSON_FIELDS]
    return found[0].unionByName(found[1]).unionByName(found[2]).filter("object_path <> '$'").distinct()


def p7_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The flat tables, one row per part with its table tag, key, parent and members."""
    found = [flatten.flatten(table(spark, sf, name, key, field), kind, key, field) for kind, name, key, field in JSON_FIELDS]
    return found[0].unionByName(found[1]).unionByName(found[2])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p3_hierarchy": p3_hierarchy,
    "p3_descendants": p3_descendants,
    "p5_found": p5_found,
    "p5_url_figures": p5_url_figures,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_parts": p7_parts,
}


def _figures_sql(key: str, partner: str) -> str:
    return f"""SELECT '{key}' AS key_field, {key} AS key_value, count(*) AS links, count(nullif(anchor_text, '')) AS with_text,
      count(DISTINCT {partner}) AS partners, count(DISTINCT nullif(anchor_text, '')) AS texts FROM link_record WHERE {key} IS NOT NULL GROUP BY {key}"""


def _heavy_sql(key: str) -> str:
    return f"""SELECT '{key}' AS key_field, {key} AS key_value FROM link_record WHERE {key} IS NOT NULL GROUP BY {key}
      HAVING count(*) >= {URL_SHARE} * (SELECT count(*) FROM link_record)"""


# Every node's chain of parents, walked to its end or to a node met before.
_WALK = """
  WITH RECURSIVE d AS (SELECT crawl_url_id AS id, min(discovered_from) AS p, min(depth) AS depth FROM discovery GROUP BY 1),
  h AS (SELECT DISTINCT unnest(redirects) AS r FROM fetch_result),
  e AS (SELECT r.source_url AS s, min(r.target_url) AS t FROM h WHERE r.source_url IS NOT NULL GROUP BY 1),
  n AS (SELECT 'discovery' AS k, CAST(id AS VARCHAR) AS v, CAST(p AS VARCHAR) AS p, depth FROM d
        UNION ALL SELECT 'redirect', s, t, NULL FROM e
        UNION ALL SELECT DISTINCT 'redirect', t, CAST(NULL AS VARCHAR), NULL FROM e WHERE t IS NOT NULL AND t NOT IN (SELECT s FROM e)),
  w(k, v, recorded, last, cur, steps, seen) AS (
    SELECT k, v, depth, v, p, 0, [v] FROM n
    UNION ALL
    SELECT w.k, w.v, w.recorded, n.v, n.p, w.steps + 1, list_append(w.seen, n.v)
    FROM w JOIN n ON n.k = w.k AND n.v = w.cur WHERE w.cur IS NOT NULL AND NOT list_contains(w.seen, w.cur)),
  z AS (SELECT *, list_position(seen, cur) AS met FROM w QUALIFY row_number() OVER (PARTITION BY k, v ORDER BY steps DESC) = 1),
  y AS (SELECT k, v, recorded, cur, CASE WHEN cur IS NULL OR coalesce(met, 0) = 0 THEN 'tree' WHEN met = 1 THEN 'cycle' ELSE 'below_cycle' END AS state,
      CASE WHEN cur IS NULL THEN seen WHEN coalesce(met, 0) = 0 THEN list_append(seen, cur) ELSE seen[:met] END AS up, CASE WHEN met > 0 THEN list_min(seen[met:]) END AS low FROM z),
  t AS (SELECT k, v, recorded, cur, state, len(up) - 1 AS depth, list_reverse(up) AS path, coalesce(low, up[-1]) AS root FROM y)"""

ORACLES: dict[str, str] = {
    "p5_found": f"{_heavy_sql('target_url')} UNION ALL {_heavy_sql('source_url')}",
    "p5_url_figures": f"{_figures_sql('target_url', 'source_url')} UNION ALL {_figures_sql('source_url', 'target_url')}",
    "p3_found": _WALK + """,
  f AS (SELECT k, v, CASE
      WHEN state <> 'tree' THEN state
      WHEN k = 'redirect' THEN CASE WHEN depth > 10 THEN 'too_deep' END
      WHEN cur IS NOT NULL THEN 'lost_root'
      WHEN recorded <> depth THEN 'wrong_depth' END AS finding FROM t)
  SELECT k AS tree_kind, v AS node_key, finding FROM f WHERE finding IS NOT NULL""",
    "p3_hierarchy": _WALK + """,
  b AS (SELECT k, a, count(*) AS n FROM (SELECT k, unnest(path[:-2]) AS a FROM t) GROUP BY k, a)
  SELECT t.k AS tree_kind, t.v AS node_key, t.root AS root_key, t.depth, array_to_string(t.path, ' > ') AS path, coalesce(b.n, 0) AS n_descendants, t.state
  FROM t LEFT JOIN b ON b.k = t.k AND b.a = t.v""",
    "p3_descendants": _WALK + """
  SELECT k AS tree_kind, a AS node_key, v AS descendant_key, depth + 1 - i AS steps FROM
    (SELECT k, v, depth, unnest(path[:-2]) AS a, unnest(range(1, len(path))) AS i FROM t)""",
    "p6_found": """
  WITH runs AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_at, crawl_id) AS n
      FROM (SELECT DISTINCT crawl_id, project_id, started_at FROM crawl_run WHERE status = 'completed')),
  p AS (SELECT project_id, n, url, coalesce(title, '') AS t, coalesce(content_hash, '') AS h, coalesce(status_code, 0) AS s
      FROM page_record JOIN runs USING (crawl_id) WHERE url IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY crawl_id, url ORDER BY extracted_at DESC, page_id DESC) = 1),
  c AS (SELECT coalesce(b.project_id, a.project_id) AS project_id, coalesce(b.n, a.n + 1) AS n, coalesce(b.url, a.url) AS url,
      CASE WHEN a.url IS NULL THEN 'added' WHEN b.url IS NULL THEN 'removed'
           WHEN a.t <> b.t OR a.h <> b.h OR a.s <> b.s THEN 'changed' END AS change_kind
      FROM p a FULL JOIN p b ON a.project_id = b.project_id AND a.url = b.url AND b.n = a.n + 1)
  SELECT r.crawl_id, c.url, c.change_kind FROM c JOIN runs r ON r.project_id = c.project_id AND r.n = c.n WHERE c.n > 1 AND c.change_kind IS NOT NULL""",
    "p7_found": """
  WITH v AS (SELECT DISTINCT 'structured_data' AS record_kind, CAST(structured_data_id AS VARCHAR) AS record_key, evidence_json AS j FROM structured_data
      UNION SELECT 'issue', CAST(issue_id AS VARCHAR), evidence_json FROM issue UNION SELECT 'observation', observation_id, result FROM integration_observation),
  o AS (SELECT record_kind, record_key, CASE WHEN json_type(j::JSON) = 'VARCHAR' THEN j::JSON->>'$' ELSE j END AS j FROM v WHERE json_valid(j))
  SELECT DISTINCT record_kind, record_key, replace(t.fullkey, '"', '') AS object_path
  FROM o, json_tree(CASE WHEN json_valid(o.j) THEN o.j::JSON END) t WHERE t.type = 'OBJECT' AND t.fullkey <> '$'""",
}
