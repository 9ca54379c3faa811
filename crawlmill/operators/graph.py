"""Whole-site findings as relational plans over pages, links and discoveries.

Every rule joins on (crawl, url). Keys that own many rows, such as a menu's target or a canonical shared by a
whole site, are resolved once per key and then joined back with large classes spread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill.operators.scale import join_classes
from crawlmill.session import checkpointed

DEEP = 4


def noindex(directives: str) -> Column:
    """Whether the directives hold ``noindex`` anywhere, as whole-site rules read them."""
    return F.lower(F.coalesce(F.col(directives), F.lit(""))).contains("noindex")


def _sized(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))


def url_states(pages: DataFrame) -> DataFrame:
    """Crawl state of urls where only extracted pages are known: a page without a status failed."""
    failed = F.when(F.coalesce("status_code", F.lit(0)) == 0, "failed").otherwise("analysed")
    return pages.select("crawl_id", "url", failed.alias("state"), "status_code")


def _targets(pages: DataFrame, urls: DataFrame | None) -> DataFrame:
    """What is known of a url that something points at: ``state, status_code, canonical_url, noindex``."""
    more = [c for c in ("canonical_url",) if c in pages.columns]
    if urls is None:
        failed = F.when(F.coalesce("status_code", F.lit(0)) == 0, "failed").otherwise("analysed")
        return pages.select("crawl_id", "url", failed.alias("state"), "status_code", *more, noindex("robots_directives").alias("noindex"))
    own = pages.select("crawl_id", "url", *more, noindex("robots_directives").alias("noindex"))
    return urls.select("crawl_id", "url", "state", "status_code").join(own, ["crawl_id", "url"], "left")


def broken_links(links: DataFrame, urls: DataFrame) -> DataFrame:
    """Internal links whose target was not crawled or failed: ``crawl_id, link_id, source_url, target_url, status_code``.

    ``urls`` has ``crawl_id, url, state, status_code``, one row per crawled url; a frame of pages has no state, and its
    null statuses count as failed. Links with a null target are no links.
    """
    inner = links.filter("kind = 'internal' and target_url is not null").select("crawl_id", "link_id", "source_url", "target_url")
    targets = _sized(inner, ["crawl_id", "target_url"])
    known = (urls if "state" in urls.columns else url_states(urls)).withColumnRenamed("url", "target_url").withColumn("status_code", F.coalesce("status_code", F.lit(0)))
    bad = targets.join(known.select("crawl_id", "target_url", "state", "status_code"), ["crawl_id", "target_url"], "left").filter("state is null or state = 'failed' or status_code >= 400")
    bad = bad.withColumn("status_code", F.coalesce("status_code", F.lit(0)))
    return join_classes(inner, bad, ["crawl_id", "target_url"], "__n", ["status_code"], F.col("link_id"), measure=True).select("crawl_id", "link_id", "source_url", "target_url", "status_code")


def shared_values(pages: DataFrame, fields: list[str]) -> DataFrame:
    """Pages of a crawl that share a non-blank value of a field: ``crawl_id, page_id, field, value, duplicate_count``.

    All fields are counted in one pass.
    """
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    rows = pages.select("crawl_id", "page_id", F.inline(each)).filter(F.trim(F.coalesce("value", F.lit(""))) != "")
    shared = _sized(rows, ["crawl_id", "field", "value"]).filter("__n > 1").withColumn("duplicate_count", F.col("__n"))
    return join_classes(rows, shared, ["crawl_id", "field", "value"], "__n", ["duplicate_count"], F.col("page_id"), measure=True)


def duplicates(pages: DataFrame, field: str) -> DataFrame:
    """Pages of a crawl that share a non-blank ``field``: ``crawl_id, page_id, value, duplicate_count``."""
    return shared_values(pages, [field]).drop("field")


def canonical_targets(pages: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """Pages whose canonical was not crawled, failed, points on, or is not indexable."""
    rows = pages.filter("canonical_url is not null").select("crawl_id", "page_id", "canonical_url")
    target = _targets(pages, urls).select("crawl_id", F.col("url").alias("__url"), "state", F.col("status_code").alias("s"), F.col("canonical_url").alias("on"), "noindex")
    state = _sized(rows, ["crawl_id", "canonical_url"]).withColumnRenamed("canonical_url", "__url").join(target, ["crawl_id", "__url"], "left")
    state = state.select(
        "crawl_id", F.col("__url").alias("canonical_url"), "__n", F.coalesce("s", F.lit(0)).alias("target_status"), F.col("state").isNotNull().alias("target_crawled"),
        F.coalesce("on", F.lit("")).alias("target_canonical"), F.coalesce("noindex", F.lit(False)).alias("target_noindex"),
    )
    bad = state.filter("not target_crawled or target_status <> 200 or (target_canonical <> '' and target_canonical <> canonical_url) or target_noindex")
    names = ["target_status", "target_crawled", "target_canonical", "target_noindex"]
    return join_classes(rows, bad, ["crawl_id", "canonical_url"], "__n", names, F.col("page_id"), measure=True)


def missing_from_sitemaps(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Indexable pages no sitemap lists."""
    listed = found.filter("discovery_kind = 'sitemap'").select("crawl_id", "url").distinct()
    return pages.filter((F.col("status_code") == 200) & ~noindex("robots_directives")).select("crawl_id", "page_id", "url").join(listed, ["crawl_id", "url"], "left_anti").select("crawl_id", "page_id", "url")


def bad_sitemap_entries(pages: DataFrame, found: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """Sitemap entries that are not crawled, not successful or not indexable; one row per url and sitemap, if told."""
    names = [c for c in ("crawl_id", "url", "sitemap_id") if c in found.columns]
    listed = found.filter("discovery_kind = 'sitemap'").select(*names).distinct()
    state = _targets(pages, urls).select("crawl_id", "url", "state", "status_code", "noindex")
    out = listed.join(state, ["crawl_id", "url"], "left").select(*names, F.coalesce("status_code", F.lit(0)).alias("status_code"), F.coalesce("noindex", F.lit(False)).alias("noindex"), F.col("state").isNotNull().alias("crawled"))
    return out.filter("status_code <> 200 or noindex")


def failed_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """Sitemap files that could not be read: ``crawl_id, sitemap_id, status``."""
    return sitemaps.filter("status <> 'ok'").select("crawl_id", "sitemap_id", "status")


def robots_blocked(frontier: DataFrame) -> DataFrame:
    """Urls of the frontier a robots file refuses: ``crawl_id, crawl_url_id, url``."""
    return frontier.filter("robots_decision = 'disallowed'").select("crawl_id", "crawl_url_id", "url").distinct()


def failing_images(images: DataFrame, shown: DataFrame, pages: DataFrame, urls: DataFrame) -> DataFrame:
    """Images on extracted pages that were not crawled or failed, one row each: ``crawl_id, image_id, status_code``.

    ``images`` has ``crawl_id, image_id, url``, ``shown`` has ``crawl_id, page_id, image_id``. An image on every page
    costs no more than others: which images are shown at all is found first.
    """
    used = shown.join(pages.select("crawl_id", "page_id"), ["crawl_id", "page_id"], "left_semi").select("crawl_id", "image_id").distinct()
    state = urls.select("crawl_id", "url", "state", "status_code")
    rows = images.select("crawl_id", "image_id", "url").distinct().join(used, ["crawl_id", "image_id"], "left_semi").join(state, ["crawl_id", "url"], "left")
    return rows.filter("state is null or state = 'failed' or status_code >= 400").select("crawl_id", "image_id", F.coalesce("status_code", F.lit(0)).alias("status_code"))


def deep_pages(pages: DataFrame, threshold: int = DEEP) -> DataFrame:
    """Pages deeper than the threshold."""
    return pages.filter(F.col("depth") > threshold).select("crawl_id", "page_id", "depth")


def orphans(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages below the top that no internal link leads to."""
    linked = links.filter("kind = 'internal' and target_url is not null").select("crawl_id", F.col("target_url").alias("url")).distinct()
    return pages.filter("depth > 0").select("crawl_id", "url", "page_id").join(linked, ["crawl_id", "url"], "left_anti").select("crawl_id", "page_id")


def nofollow_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages with internal nofollow links and their number; counted per url before the join."""
    rel = F.concat(F.lit(" "), F.lower(F.regexp_replace(F.coalesce("rel", F.lit("")), ",", " ")), F.lit(" "))
    counted = links.filter((F.col("kind") == "internal") & rel.contains(" nofollow ")).groupBy("crawl_id", F.col("source_url").alias("url")).agg(F.count(F.lit(1)).alias("nofollow_links"))
    return pages.select("crawl_id", "url", "page_id").join(counted, ["crawl_id", "url"]).select("crawl_id", "page_id", "nofollow_links")


def hreflang_without_return(pages: DataFrame, hreflangs: DataFrame) -> DataFrame:
    """Language alternates whose page is missing or does not point back: ``crawl_id, page_id, language_code, target_url``.

    ``pages`` has ``crawl_id, page_id, url``, ``hreflangs`` has ``crawl_id, page_id, language_code, target_url``.
    """
    own = hreflangs.join(pages.select("crawl_id", "page_id", F.col("url").alias("source_url")), ["crawl_id", "page_id"])
    target = pages.select("crawl_id", F.col("page_id").alias("target_page_id"), F.col("url").alias("target_url"))
    back = hreflangs.select("crawl_id", F.col("page_id").alias("target_page_id"), F.col("target_url").alias("source_url")).distinct()
    known = own.join(target, ["crawl_id", "target_url"], "left")
    return known.join(back, ["crawl_id", "target_page_id", "source_url"], "left_anti").select("crawl_id", "page_id", "language_code", "target_url")


def provenance(issues: DataFrame) -> DataFrame:
    """Final class and source of every issue, from rule, severity, subject and the evidence's members."""
    has = lambda name: F.get_json_object("evidence_json", f"$.{name}").isNotNull()
    rule = F.col("rule_id")
    length = F.coalesce(F.get_json_object("evidence_json", "$.length").try_cast("int"), F.lit(-1))
    kind = (
        F.when(F.col("severity") == "info", "information")
        .when(rule.isin("AUD-01", "AUD-05", "AUD-07", "AUD-09", "AUD-10", "AUD-13", "AUD-12"), "deterministic")
        .when(rule == "AUD-04", F.when(has("canonical_count"), "recommendation").otherwise("deterministic"))
        .when(rule == "AUD-02", F.when(length == 0, "deterministic").otherwise("recommendation"))
        .when(rule == "AUD-03", F.when(has("h1_count"), "deterministic").otherwise("recommendation"))
        .when((rule == "AUD-08") & ~has("hamming_distance"), "deterministic")
        .when(rule.isin("AUD-08", "AUD-11"), "recommendation")
        .otherwise("review")
    )
    source = (
        F.when(F.col("subject_type") == "rendered_page", "rendered")
        .when((rule == "AUD-06") | (F.col("subject_type") == "sitemap"), "sitemap")
        .when(F.col("subject_type").isin("link", "image", "url") | rule.isin("AUD-08", "AUD-11"), "graph")
        .otherwise("raw")
    )
    return issues.withColumns({"classification": kind, "evidence_source": source})


def finalize(
    pages: DataFrame, links: DataFrame, found: DataFrame, urls: DataFrame | None = None, sitemaps: DataFrame | None = None, frontier: DataFrame | None = None,
    alternates: DataFrame | None = None, images: DataFrame | None = None, shown: DataFrame | None = None, similar: DataFrame | None = None,
) -> DataFrame:
    """All findings of whole sites with their provenance.

    Returns ``crawl_id, rule_id, severity, subject_type, subject_id, evidence_json, classification, evidence_source``.
    The first three frames are needed; rules whose evidence is not given are left out. ``similar`` is a result of
    near-duplicate search with ``crawl_id, id, match_id, distance``. Pages and links, which most rules share, are read
    and deduplicated once. The same evidence gives the same findings (see ``rebuild``).
    """
    pages, links = checkpointed(pages), checkpointed(links)
    urls = checkpointed(url_states(pages) if urls is None else urls)

    def shaped(rows: DataFrame, rule: str, severity: str, kind: str, subject: str, **evidence: Column | str) -> DataFrame:
        said = F.to_json(F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in evidence.items()]))
        return rows.select("crawl_id", F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(kind).alias("subject_type"), F.col(subject).cast("string").alias("subject_id"), said.alias("evidence_json"))

    no = F.lit(False)
    parts = [
        shaped(broken_links(links, urls), "AUD-01", "error", "link", "link_id", status_code="status_code"),
        shaped(canonical_targets(pages, urls), "AUD-04", "error", "page", "page_id", target_status="target_status", target_crawled="target_crawled", target_noindex="target_noindex"),
        shaped(missing_from_sitemaps(pages, found), "AUD-06", "info", "page", "page_id", in_sitemap=no),
        shaped(bad_sitemap_entries(pages, found, urls), "AUD-06", "warning", "url", "url", status_code="status_code", noindex="noindex"),
        _shared_findings(shared_values(pages, ["title", "meta_description", "content_hash"])),
        shaped(deep_pages(pages), "AUD-11", "warning", "page", "page_id", depth="depth", threshold=F.lit(DEEP)),
        shaped(orphans(pages, links), "AUD-11", "warning", "page", "page_id", inlinks=F.lit(0)),
        shaped(nofollow_links(pages, links), "AUD-11", "info", "page", "page_id", nofollow_links="nofollow_links"),
    ]
    if sitemaps is not None:
        parts.append(shaped(failed_sitemaps(sitemaps), "AUD-06", "error", "sitemap", "sitemap_id", status="status"))
    if frontier is not None:
        parts.append(shaped(robots_blocked(frontier), "AUD-07", "warning", "url", "crawl_url_id", robots_decision=F.lit("disallowed")))
    if alternates is not None:
        parts.append(shaped(hreflang_without_return(pages, alternates), "AUD-09", "warning", "page", "page_id", hreflang="language_code", reciprocal=no))
    if images is not None and shown is not None:
        parts.append(shaped(failing_images(images, shown, pages, urls), "AUD-10", "error", "image", "image_id", status_code="status_code"))
    if similar is not None:
        parts.append(shaped(similar, "AUD-08", "warning", "page", "id", hamming_distance="distance", match="match_id"))
    return provenance(reduce(DataFrame.unionByName, parts))


def _shared_findings(shared: DataFrame) -> DataFrame:
    """Findings of shared titles and descriptions (counted with the page itself) and of equal contents (without)."""
    text = F.col("field") != "content_hash"
    evidence = F.to_json(F.struct(F.when(text, F.col("field")).alias("field"), (F.col("duplicate_count") - F.when(text, 0).otherwise(1)).alias("duplicate_count")))
    rule = F.when(text, "AUD-02").otherwise("AUD-08").alias("rule_id")
    return shared.select("crawl_id", rule, F.lit("warning").alias("severity"), F.lit("page").alias("subject_type"), F.col("page_id").cast("string").alias("subject_id"), evidence.alias("evidence_json"))


def rebuild(findings: DataFrame, path: str) -> None:
    """Write the findings partitioned by crawl; a second run replaces the crawls it holds and no others."""
    findings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("crawl_id").parquet(path)
