"""Read queries: summaries, keyset-paged lists, details, comparisons, rankings and verification."""

from __future__ import annotations

import base64
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlmill.session import checkpointed

DEFAULT_LIMIT, MAX_LIMIT, MAX_SEARCH = 100, 1000, 500
SEVERITIES = ("info", "warning", "error")


def cursor(value: object) -> str:
    """Opaque cursor of a key."""
    return base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")


def from_cursor(text: str) -> object:
    """Key of a cursor; ValueError for anything else."""
    try:
        return json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except (ValueError, UnicodeDecodeError) as x:
        raise ValueError("cursor") from x


def keyset(df: DataFrame, key: str, after: object = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One page of a list ordered by ``key``: at most ``limit`` rows and one more, which says that others follow."""
    if not 0 < limit <= MAX_LIMIT:
        raise ValueError("limit")
    rows = df if after is None else df.filter(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(limit + 1)


def contains_text(column: Column, text: str) -> Column:
    """Case-insensitive search for a text taken literally."""
    if len(text) > MAX_SEARCH:
        raise ValueError("search")
    return F.contains(F.lower(column), F.lit(text.lower()))


def filter_issues(issues: DataFrame, severity: str | None = None, rule_id: str | None = None, search: str | None = None) -> DataFrame:
    """Issues by severity, rule and a text in the evidence; only wanted predicates are built."""
    wanted = []
    if severity:
        if severity not in SEVERITIES:
            raise ValueError("severity")
        wanted.append(F.col("severity") == severity)
    if rule_id:
        if len(rule_id) > 50:
            raise ValueError("rule")
        wanted.append(F.col("rule_id") == rule_id)
    if search:
        wanted.append(contains_text(F.col("evidence_json"), search))
    return issues.filter(reduce(lambda a, b: a & b, wanted)) if wanted else issues


def status_class(status: Column) -> Column:
    """``2xx`` and the like, ``none`` without a status."""
    return F.when(status.isNull(), "none").otherwise(F.concat(F.floor(status / 100).cast("string"), F.lit("xx")))


def summary(pages: DataFrame, issues: DataFrame, runs: DataFrame | None = None, found: DataFrame | None = None, fetches: DataFrame | None = None) -> DataFrame:
    """Counts of a crawl in long form: ``crawl_id, kind, name, n``.

    Kinds are responses by class, extraction modes, severities and rules; with the other frames also the crawl's
    status and the counters of urls discovered, fetched, failed and analysed.
    """
    by = lambda df, kind, name: df.groupBy("crawl_id", F.lit(kind).alias("kind"), name.alias("name"))
    parts = [
        by(pages, "response", status_class(F.col("status_code"))),
        by(pages, "mode", F.coalesce("extraction_mode", F.lit("none"))),
        by(issues, "severity", F.coalesce("severity", F.lit("none"))),
        by(issues, "rule", F.coalesce("rule_id", F.lit("none"))),
    ]
    if runs is not None:
        parts.append(by(runs, "status", F.coalesce("status", F.lit("none"))))
    if found is not None:
        parts.append(by(found, "counter", F.lit("discovered")))
    if fetches is not None:
        status = F.coalesce("status_code", F.lit(0))
        parts += [by(fetches, "counter", F.lit("fetched")), by(fetches.filter((status < 200) | (status >= 400)), "counter", F.lit("failed")), by(pages, "counter", F.lit("analysed"))]
    return reduce(DataFrame.unionByName, [p.agg(F.count(F.lit(1)).alias("n")) for p in parts])


MOST_LINKS, MOST_PARTS = 10_000, 1000


def page_detail(pages: DataFrame, links: DataFrame, data: DataFrame, issues: DataFrame, modes: DataFrame, fields: list[str]) -> DataFrame:
    """Nested document of every page: ``pages`` plus lists of its parts, each in order of ids.

    ``outlinks`` and ``inlinks`` hold the first ``MOST_LINKS`` links each, ``structured_data`` and ``issues`` the first
    ``MOST_PARTS``: a page that a third of all links lead to gathers no more than these, which are chosen before
    anything is gathered. ``render_differences`` names the ``fields`` in which the rendered form of a url (``modes``:
    one row per crawl, url and extraction mode) differs from the raw one; null where it wasn't rendered.
    """

    def first(rows: DataFrame, keys: list[str], order: str, most: int, name: str) -> DataFrame:
        salt = F.pmod(F.xxhash64(order), F.lit(64))  # the first of each part, then of all: one task never sees more than 64 times ``most`` rows of a key
        kept = rows.withColumn("__salt", salt).withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(order))).filter(F.col("__n") <= most)
        kept = kept.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("__n") <= most).drop("__n", "__salt")
        rest = [order, *[c for c in rows.columns if c not in (*keys, order)]]
        return kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))

    at = ["crawl_id", "url"]
    ends = [("outlinks", "source_url", "target_url"), ("inlinks", "target_url", "source_url")]
    out = pages
    for name, own, other in ends:
        rows = links.filter(F.col(own).isNotNull()).select("crawl_id", F.col(own).alias("url"), "link_id", other, "anchor_text", "rel", "kind")
        out = out.join(first(rows, at, "link_id", MOST_LINKS, name), at, "left")
    found = issues.filter("subject_type = 'page' and rule_id is not null").select(F.col("subject_id").try_cast("long").alias("page_id"), "issue_id", "rule_id", "severity", "classification", "evidence_json")
    out = out.join(first(data, ["page_id"], "structured_data_id", MOST_PARTS, "structured_data"), "page_id", "left")
    out = out.join(first(found, ["page_id"], "issue_id", MOST_PARTS, "issues"), "page_id", "left")
    form = lambda mode, mark: modes.filter(F.col("extraction_mode") == mode).select(*at, *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"{mark}_{f}") for f in fields])
    both = form("raw", "a").join(form("rendered", "b"), at)
    each = F.array(*[F.when(F.col(f"a_{f}") != F.col(f"b_{f}"), F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("raw"), F.col(f"b_{f}").alias("rendered"))) for f in fields])
    return out.join(both.select(*at, F.filter(each, lambda x: x.isNotNull()).alias("render_differences")), at, "left")


def compare(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``added``, ``removed`` and ``changed`` rows between two sets, nulls equal to empty: one full outer join."""
    said = lambda df, mark: df.select(*keys, F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields]).alias(mark))
    both = said(before, "old").join(said(after, "new"), keys, "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select(*keys, kind.alias("change_kind")).filter("change_kind is not null")


def issue_changes(issues: DataFrame, pairs: DataFrame) -> DataFrame:
    """New and fixed issues from one crawl to the next: ``issue_id, crawl_id, change_kind``.

    ``pairs`` has ``crawl_id, next_id``. New is an issue of ``next_id`` without one of equal rule, subject type and
    evidence in ``crawl_id``; fixed is one of ``crawl_id`` without such a one in ``next_id``. All pairs are compared
    in one join per kind; a null in a compared field equals none. ``crawl_id`` is the later crawl.
    """
    keys = ["pair", "rule_id", "subject_type", "evidence_json"]
    own = lambda side: issues.join(pairs.select(F.col(side).alias("crawl_id"), F.col("next_id").alias("pair")), "crawl_id").drop("crawl_id")
    before, after = own("crawl_id"), own("next_id")
    new = after.join(before.select(*keys).distinct(), keys, "left_anti").withColumn("change_kind", F.lit("new"))
    fixed = before.join(after.select(*keys).distinct(), keys, "left_anti").withColumn("change_kind", F.lit("fixed"))
    return new.unionByName(fixed).select("issue_id", F.col("pair").alias("crawl_id"), "change_kind")


def architecture(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Per page: inlinks and outlinks among internal links, score, whether it is an orphan.

    Both ends of a link are counted in one aggregation per url before the join, so a target with a tenth of all
    links costs no more than others.
    """
    end = lambda url, i, o: F.struct(F.col(url).alias("url"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    ends = links.filter("kind = 'internal'").select("crawl_id", F.explode(F.array(end("target_url", 1, 0), end("source_url", 0, 1))).alias("e")).select("crawl_id", "e.*")
    counted = ends.filter("url is not null").groupBy("crawl_id", "url").agg(F.sum("i").alias("inlinks"), F.sum("o").alias("outlinks"))
    rows = pages.select("crawl_id", "url", "page_id", F.coalesce("depth", F.lit(0)).alias("depth"), "status_code")
    rows = rows.join(counted, ["crawl_id", "url"], "left").na.fill(0, ["inlinks", "outlinks"])
    score = (2 * F.col("inlinks") + F.col("outlinks")) / (F.col("depth") + 1)
    return rows.withColumns({"score": score, "orphan": (F.col("depth") > 0) & (F.col("inlinks") == 0)})


def top_nodes(nodes: DataFrame, limit: int) -> DataFrame:
    """Highest ranked pages of each crawl: by inlinks, outlinks, depth, id."""
    order = Window.partitionBy("crawl_id").orderBy(F.desc("inlinks"), F.desc("outlinks"), "depth", "page_id")
    return nodes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def missing_discoveries(links: DataFrame, found: DataFrame, pages: DataFrame) -> DataFrame:
    """Internal targets the frontier lacks, with the depth they would have: ``crawl_id, url, depth``."""
    targets = links.filter("kind = 'internal' and target_url is not null").select("crawl_id", F.col("target_url").alias("url"), "source_url").distinct()
    lacking = targets.join(found.select("crawl_id", "url").distinct(), ["crawl_id", "url"], "left_anti")
    sources = pages.select("crawl_id", F.col("url").alias("source_url"), "depth")
    return lacking.join(sources, ["crawl_id", "source_url"], "left").groupBy("crawl_id", "url").agg((F.min(F.coalesce("depth", F.lit(0))) + 1).alias("depth"))


def verify(pages: DataFrame, links: DataFrame, found: DataFrame, issues: DataFrame) -> DataFrame:
    """Invariants per crawl: pages, distinct urls, urls found but not extracted, links, issues, missing fields."""
    missing = F.coalesce("title", F.lit("")) == ""
    a = pages.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("url").alias("urls"), F.count_if(missing).alias("without_title"), F.count_if(F.col("content_hash").isNull()).alias("without_hash"))
    open_ = found.select("crawl_id", "url").distinct().join(pages.select("crawl_id", "url"), ["crawl_id", "url"], "left_anti").groupBy("crawl_id").agg(F.count(F.lit(1)).alias("outstanding"))
    b = links.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("links"))
    c = issues.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("issues"))
    out = a.join(open_, "crawl_id", "left").join(b, "crawl_id", "left").join(c, "crawl_id", "left").na.fill(0)
    return out.withColumn("pass", (F.col("pages") == F.col("urls")) & (F.col("outstanding") == 0) & (F.col("without_hash") == 0))


def field_differences(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str], limit: int = 4096) -> DataFrame:
    """Long form of the fields that differ between two records of a key: ``keys, field, a_value, b_value``."""
    said = lambda df, mark: df.select(*keys, F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])).alias(mark))
    both = said(a, "va").join(said(b, "vb"), keys)
    rows = both.select(*keys, "vb", F.explode("va").alias("field", "a_value")).withColumn("b_value", F.element_at("vb", F.col("field")))
    cut = lambda c: F.substring(c, 1, limit).alias(c)
    return rows.filter("a_value <> b_value").select(*keys, "field", cut("a_value"), cut("b_value"))


def record_differences(a: DataFrame, b: DataFrame, keys: list[str], limit: int = 4096) -> DataFrame:
    """Fields in which two page records of a key differ: ``keys, field, a_value, b_value``.

    Both have ``keys`` and ``page``, a record of ``functions.html.page``. Fifteen fields are compared; lists are
    compared as JSON cut at ``limit`` characters, links and images by their number. Null records have empty fields.
    """
    p = F.col("page")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    cut = lambda c: F.substring(F.coalesce(F.to_json(c), F.lit("[]")), 1, limit)
    number = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("string")
    brief = F.transform(p["structured_data"], lambda d: F.struct(d["format"].alias("format"), d["types"].alias("types"), d["valid"].alias("valid")))
    fields = {
        "title": text(p["title"]), "meta_description": text(p["meta_description"]), "canonical": text(F.get(p["canonicals"], F.lit(0))), "robots": text(p["meta_robots"]),
        "language": text(p["language"]), "content_hash": text(p["content_hash"]), "text_length": text(p["text_bytes"]), "headings": cut(p["headings"]), "link_count": number(p["links"]),
        "image_count": number(p["images"]), "hreflang": cut(p["hreflangs"]), "structured_data": cut(brief), "viewport": text(p["viewport"]), "amp_alternate": text(p["amp_url"]),
        "mobile_alternate": text(p["mobile_alternate"]),
    }
    flat = lambda df: df.select(*keys, *[c.alias(n) for n, c in fields.items()])
    return field_differences(flat(a), flat(b), keys, list(fields), limit)


def segments(rows: DataFrame, scope: str, key: str, size: int) -> DataFrame:
    """Ledger of count windows of ``size`` rows in key order, with a checksum over their keys.

    Rows are numbered per scope without one task holding a scope: keys are counted in ranges first and numbered
    within their range.
    """
    parts = rows.select(F.col(scope).alias("scope"), F.col(key).alias("key")).distinct().repartitionByRange("scope", "key")
    parts = checkpointed(parts.withColumn("part", F.spark_partition_id()))  # the ranges must be the same in both uses
    counts = parts.groupBy("scope", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("scope").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy("scope", "part").orderBy("key")) + F.col("before") - 1
    placed = parts.join(before, ["scope", "part"]).withColumn("segment", F.floor(number / size).cast("long"))
    return placed.groupBy(F.col("scope").alias(scope), "segment").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("key").cast("string"))), ","), 256).alias("checksum")
    )


def scorecard(observed: DataFrame, expected: DataFrame, case: str) -> DataFrame:
    """True and false positives and misses per rule, with precision and recall.

    Both have ``case, rule_id, message, severity, classification, evidence`` (a map of texts, or its JSON). Of each
    case the expected findings are taken in order of their texts; each is paired with the first observed one not yet
    used that has its rule, its message, severity and class where it names them, and its evidence among its own. A
    case's findings, which its checks bound, are the only ones brought together. Repeated rows count each.
    """
    fields = ("rule_id", "message", "severity", "classification")

    def listed(df: DataFrame, name: str) -> DataFrame:
        evidence = F.lit(None).cast("map<string,string>")
        if "evidence" in df.columns:
            evidence = F.col("evidence") if df.schema["evidence"].dataType.typeName() == "map" else F.from_json("evidence", "map<string,string>")
        said = [F.coalesce(F.col(f), F.lit("")).alias(f) for f in fields]
        pairs = F.array_sort(F.map_entries(F.coalesce(evidence, F.create_map().cast("map<string,string>")))).alias("evidence")
        return df.select(case, F.struct(*said, pairs).alias("f")).groupBy(case).agg(F.array_sort(F.collect_list("f")).alias(name))

    both = listed(observed, "seen").join(listed(expected, "wanted"), case, "full_outer")
    kind = "array<struct<rule_id:string,message:string,severity:string,classification:string,evidence:array<struct<key:string,value:string>>>>"
    both = both.select(case, *[F.coalesce(c, F.array().cast(kind)).alias(c) for c in ("seen", "wanted")])

    def fits(e: Column, o: Column) -> Column:
        same = e["rule_id"] == o["rule_id"]
        for f in fields[1:]:
            same = same & ((e[f] == "") | (e[f] == o[f]))
        return same & (F.size(F.array_except(e["evidence"], o["evidence"])) == 0)

    def pair(used: Column, e: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.size("seen") - 1), lambda i: ~F.array_contains(used, i) & fits(e, F.get("seen", i)))
        return F.concat(used, F.array(F.when(F.size("seen") > 0, F.coalesce(F.get(free, F.lit(0)), F.lit(-1))).otherwise(-1)))

    matched = both.withColumn("pairs", F.aggregate("wanted", F.array().cast("array<int>"), pair))
    of = lambda rows, mark: rows.select("rule_id", *[F.lit(int(m == mark)).alias(m) for m in ("t", "f", "n")])
    hits = matched.select(F.explode(F.arrays_zip("wanted", "pairs")).alias("z")).select(F.col("z.wanted.rule_id").alias("rule_id"), F.col("z.pairs").alias("p"))
    rest = matched.select("pairs", F.posexplode("seen").alias("i", "o")).filter(~F.array_contains("pairs", F.col("i"))).select(F.col("o.rule_id").alias("rule_id"))
    every = of(hits.filter("p >= 0"), "t").unionByName(of(hits.filter("p < 0"), "n")).unionByName(of(rest, "f"))
    out = every.groupBy("rule_id").agg(F.sum("t").alias("true_positives"), F.sum("f").alias("false_positives"), F.sum("n").alias("false_negatives"))
    ratio = lambda n, d: F.when(d == 0, F.lit(1.0)).otherwise(n / d)
    t = F.col("true_positives")
    return out.withColumns({"precision": ratio(t, t + F.col("false_positives")), "recall": ratio(t, t + F.col("false_negatives"))})


def coverage(catalog: DataFrame, positive: DataFrame, controls: DataFrame) -> DataFrame:
    """Rules by how cases cover them: ``rule_id, positive_cases, control_cases, status``.

    ``catalog`` lists the rules, ``positive`` and ``controls`` have ``case_id, rule_id``: cases that expect a finding of the
    rule, and cases that must have none. ``baseline`` has both, ``partial`` one, ``missing`` none.
    """
    count = lambda df, name: df.groupBy("rule_id").agg(F.countDistinct("case_id").alias(name))
    rows = catalog.select("rule_id").distinct().join(count(positive, "positive_cases"), "rule_id", "left").join(count(controls, "control_cases"), "rule_id", "left").na.fill(0)
    some = [F.col(c) > 0 for c in ("positive_cases", "control_cases")]
    return rows.withColumn("status", F.when(some[0] & some[1], "baseline").when(some[0] | some[1], "partial").otherwise("missing"))


def projected_storage(storage: Column, done: Column, total: Column) -> Column:
    """Bytes expected at the end: storage times total over done, rounded up, at most the largest long."""
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    wide = F.ceil(storage.cast("decimal(38,0)") * total.cast("decimal(19,0)") / done.cast("decimal(19,0)"))
    return F.when(done > 0, F.least(wide.cast("decimal(38,0)"), most).cast("long")).otherwise(storage)


def due(schedules: DataFrame, active: DataFrame, now: Column, limit: int) -> DataFrame:
    """Enabled schedules that are due and have no active crawl, the longest due first."""
    rows = schedules.filter(F.col("enabled") & (F.col("next_run") <= now)).join(active.select("project_id").distinct(), "project_id", "left_anti")
    return rows.orderBy("next_run", "schedule_id").limit(limit)
