"""robots.txt and sitemaps: parsing and decisions."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlmill.functions import vectorized
from crawlmill.session import checkpointed

MAX_ROBOTS_BYTES, MAX_RULE = 512 * 1024, 4096
MAX_SITEMAP_BYTES, MAX_SITEMAP_ENTRIES, MAX_SITEMAP_DEPTH = 50 << 20, 50_000, 5
RULES = "array<struct<group_no int, agents array<string>, allow boolean, pattern string, regex string, specificity int, position int, crawl_delay double>>"


def rule_regex(pattern: str) -> tuple[str, str, int]:
    """Pattern without its anchor, regular expression, and number of literal characters."""
    anchored = pattern.endswith("$")
    body = pattern.removesuffix("$")
    said = ".*".join(re.escape(p) for p in body.split("*"))
    return body, f"^{said}" + (r"\z" if anchored else ""), len(body.replace("*", ""))


def parse_robots(text: str | None) -> tuple[list[dict], list[str]]:
    """Rules with their group, and sitemaps. A group without rules has one row that matches nothing.

    Consecutive user-agent lines share a group; empty rules are left out; null or over-long files have none.
    """
    if not text or len(text.encode("utf-8", "replace")) > MAX_ROBOTS_BYTES:
        return [], []
    groups: list[dict] = []
    maps: list[str] = []
    open_group = False
    for raw in text.splitlines():
        name, found, value = raw.split("#", 1)[0].strip().partition(":")
        name, value = name.strip().lower(), value.strip()
        if not found:
            continue
        if name == "user-agent" and value:
            if not open_group:
                groups.append({"agents": [], "rules": [], "delay": 0.0})
                open_group = True
            groups[-1]["agents"].append(value.lower())
        elif name in ("allow", "disallow") and groups and value:
            if len(value) <= MAX_RULE:
                groups[-1]["rules"].append((name == "allow", *rule_regex(value)))
            open_group = False
        elif name == "crawl-delay" and groups:
            try:
                seconds = float(value)
            except ValueError:
                seconds = -1.0
            if 0 <= seconds <= 3600:
                groups[-1]["delay"] = seconds
            open_group = False
        elif name == "sitemap" and re.match(r"https?://", value, re.I):
            maps.append(value)
    rows = []
    for number, group in enumerate(groups):
        for at, (allow, pattern, regex, size) in enumerate(group["rules"] or [(True, None, None, -1)]):
            rows.append({"group_no": number, "agents": group["agents"], "allow": allow, "pattern": pattern, "regex": regex, "specificity": size, "position": len(rows) + at, "crawl_delay": group["delay"]})
    return rows, maps


@vectorized(RULES)
def robots_rules(texts: pd.Series) -> pd.Series:
    """Column form of ``parse_robots``, rules only."""
    return texts.map(lambda t: parse_robots(t)[0])


@vectorized("array<string>")
def robots_sitemaps(texts: pd.Series) -> pd.Series:
    """Sitemaps a robots file lists."""
    return texts.map(lambda t: parse_robots(t)[1])


def robots_decisions(files: DataFrame, requests: DataFrame, agent: str) -> DataFrame:
    """Decision for each request: ``host, path, allowed, matched_rule, crawl_delay``.

    ``files`` has ``host, body``, ``requests`` has ``host, path``. Groups that name the agent most specifically
    apply together; the longest matching rule wins, an allowing one in a tie (the last of equal allowing ones,
    the first of equal refusing ones). Without a file, a group or a rule a path is allowed.
    """
    rules = files.select("host", F.explode(robots_rules("body")).alias("r")).select("host", "r.*")
    named = F.transform("agents", lambda a: F.when(a == "*", 0).when(F.contains(F.lit(agent.lower()), a), F.length(a)).otherwise(-1))
    rules = rules.withColumn("fit", F.array_max(named)).filter("fit >= 0")
    rules = rules.withColumn("best", F.max("fit").over(Window.partitionBy("host"))).filter("fit = best")
    delays = rules.groupBy("host").agg(F.max("crawl_delay").alias("crawl_delay"))
    asked = requests.select("host", "path").distinct()
    hits = asked.join(rules.filter("regex is not null"), "host").filter(F.rlike(F.col("path"), F.col("regex")))
    order = F.struct("specificity", F.col("allow").cast("int"), F.when(F.col("allow"), F.col("position")).otherwise(-F.col("position")))
    won = hits.groupBy("host", "path").agg(F.max_by(F.struct("allow", "pattern"), order).alias("w"))
    return (
        asked.join(won, ["host", "path"], "left").join(delays, "host", "left")
        .select("host", "path", F.coalesce("w.allow", F.lit(True)).alias("allowed"), F.coalesce("w.pattern", F.lit("")).alias("matched_rule"), F.coalesce("crawl_delay", F.lit(0.0)).alias("crawl_delay"))
    )


def parse_sitemap(text: str | None) -> tuple[str, list[str]]:
    """Kind (``urlset``, ``sitemapindex`` or ``invalid``) and locations of a strict XML sitemap."""
    if not text or len(text.encode("utf-8", "replace")) > MAX_SITEMAP_BYTES or "<!ENTITY" in text:
        return "invalid", []
    try:
        root = ET.fromstring(text.encode("utf-8"))
    except (ET.ParseError, ValueError):
        return "invalid", []
    kind = root.tag.rsplit("}", 1)[-1]
    entry = {"urlset": "url", "sitemapindex": "sitemap"}.get(kind)
    if entry is None:
        return "invalid", []
    found = [(loc.text or "").strip() for e in root if e.tag.rsplit("}", 1)[-1] == entry for loc in e if loc.tag.rsplit("}", 1)[-1] == "loc"]
    found = [u for u in found if u]
    return (kind, found) if len(found) <= MAX_SITEMAP_ENTRIES else ("invalid", [])


@vectorized("struct<kind string, locations array<string>>")
def sitemap(texts: pd.Series) -> pd.DataFrame:
    """Column form of ``parse_sitemap``."""
    found = [parse_sitemap(t) for t in texts]
    return pd.DataFrame({"kind": [k for k, _ in found], "locations": [u for _, u in found]})


def discover_sitemaps(roots: DataFrame, documents: DataFrame, max_depth: int = MAX_SITEMAP_DEPTH) -> DataFrame:
    """Follow sitemap indexes breadth first: ``sitemap_url, depth, kind, locations``, each sitemap once.

    ``roots`` has ``sitemap_url``, ``documents`` has ``sitemap_url, body``. The number of rounds is bounded by
    ``max_depth``; a sitemap without a document is ``missing``.
    """
    parsed = checkpointed(documents.select("sitemap_url", sitemap("body").alias("s")).select("sitemap_url", "s.kind", "s.locations"))  # each file is parsed once
    wave = seen = checkpointed(roots.select("sitemap_url").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        inner = wave.join(parsed.filter("kind = 'sitemapindex'"), "sitemap_url").select(F.explode("locations").alias("sitemap_url")).distinct()
        wave = checkpointed(inner.join(seen.select("sitemap_url"), "sitemap_url", "left_anti").withColumn("depth", F.lit(depth)))
        if wave.isEmpty():
            break
        seen = seen.unionByName(wave)
    return seen.join(parsed, "sitemap_url", "left").select("sitemap_url", "depth", F.coalesce("kind", F.lit("missing")).alias("kind"), "locations")


def meta_noindex(meta: Column, header: Column) -> Column:
    """Whether the directives of both, split at commas, semicolons and blanks, hold ``noindex``."""
    both = F.concat_ws(",", F.coalesce(meta, F.lit("")), F.coalesce(header, F.lit("")))
    return F.array_contains(F.split(F.lower(both), "[,; ]"), "noindex")
