"""Row-local checks of pages and resources, each a native expression; one scan yields all findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill.functions import urls
from crawlmill.functions.robots import meta_noindex

# Default thresholds, sizes and the pattern of language codes.
TITLE, DESCRIPTION, DEEP = (30, 60), (70, 160), 4
LARGE_IMAGE = 512_000
LANGUAGE = r"(?i)^(x-default|[a-z]{2,3}(-[a-z]{2}|-[0-9]{3})?)\z"
SPACE = r"^[\s\u0085   -     　]+|[\s\u0085   -     　]+$"


# Rule, severity, message and class of every finding.
FOUND = {
    "RP-01": ("AUD-01", "error", "Page response is not successful", "deterministic"),
    "RR-01": ("AUD-01", "error", "Resource response is not successful", "deterministic"),
    "RP-02a": ("AUD-02", "error", "Title is missing or empty", "deterministic"),
    "RP-02b": ("AUD-02", "warning", "Title is shorter than the configured threshold", "recommendation"),
    "RP-02c": ("AUD-02", "warning", "Title is longer than the configured threshold", "recommendation"),
    "RP-02d": ("AUD-02", "warning", "Meta description is missing or empty", "deterministic"),
    "RP-02e": ("AUD-02", "info", "Meta description is shorter than the configured threshold", "information"),
    "RP-02f": ("AUD-02", "warning", "Meta description is longer than the configured threshold", "recommendation"),
    "RP-03a": ("AUD-03", "warning", "H1 is missing", "deterministic"),
    "RP-03b": ("AUD-03", "warning", "Page has multiple H1 headings", "deterministic"),
    "RP-03c": ("AUD-03", "info", "Title and H1 are identical", "information"),
    "RP-04a": ("AUD-04", "info", "Canonical is absent", "information"),
    "RP-04b": ("AUD-04", "error", "Page has conflicting canonical elements", "deterministic"),
    "RP-04c": ("AUD-04", "error", "Canonical target is invalid", "deterministic"),
    "RP-05": ("AUD-05", "error", "Page is not indexable", "deterministic"),
    "RP-06": ("AUD-06", "info", "Indexable page was not observed in a sitemap", "information"),
    "RP-07": ("AUD-07", "warning", "URL is blocked by robots.txt", "deterministic"),
    "RP-08": ("AUD-08", "warning", "Page has exact content duplicates", "deterministic"),
    "RP-09": ("AUD-09", "warning", "Hreflang language or region is invalid", "deterministic"),
    "RP-10": ("AUD-10", "warning", "Images are missing alt attributes", "deterministic"),
    "RP-11a": ("AUD-11", "warning", "Page is deeper than the configured threshold", "recommendation"),
    "RP-11b": ("AUD-11", "warning", "Page has no recorded internal inlinks", "recommendation"),
    "RP-11c": ("AUD-11", "info", "Page contains internal nofollow links", "information"),
    "RP-12a": ("AUD-12", "error", "HTTPS page references HTTP resources", "deterministic"),
    "RP-12b": ("AUD-12", "info", "Content-Security-Policy header was not observed", "information"),
    "RP-13a": ("AUD-13", "error", "JSON-LD syntax is invalid", "deterministic"),
    "RP-13b": ("AUD-13", "error", "JSON-LD structure is invalid", "deterministic"),
    "RP-13c": ("AUD-13", "warning", "Compact structured-data types have no observed Schema.org context", "deterministic"),
    "RP-13d": ("AUD-13", "error", "Schema.org type is unknown in bundled vocabulary", "deterministic"),
    "RP-13e": ("AUD-13", "error", "Schema.org property is unknown in bundled vocabulary", "deterministic"),
    "RP-13f": ("AUD-13", "warning", "Schema.org term is superseded", "recommendation"),
    "RP-13g": ("AUD-13", "warning", "Schema.org domain guidance may not match the node type", "recommendation"),
    "RP-13h": ("AUD-13", "warning", "Schema.org range guidance may not match the nested node type", "recommendation"),
    "RP-15a": ("AUD-15", "warning", "Responsive viewport declaration is absent", "recommendation"),
    "RP-15b": ("AUD-15", "warning", "Viewport does not declare device width", "recommendation"),
    "RP-15c": ("AUD-15", "error", "AMP alternate self-references the current page", "deterministic"),
    "RP-15d": ("AUD-15", "error", "Mobile alternate self-references the current page", "deterministic"),
    "RP-16a": ("AUD-16", "warning", "Images omit declared width or height", "recommendation"),
    "RR-16b": ("AUD-16", "warning", "Image resource exceeds the review-size threshold", "recommendation"),
    "RR-16c": ("AUD-16", "warning", "Image uses a legacy web delivery format", "recommendation"),
    "RR-17a": ("AUD-17", "warning", "PDF title metadata was not observed", "recommendation"),
    "RR-17b": ("AUD-17", "warning", "PDF document language was not observed", "recommendation"),
    "RR-17c": ("AUD-17", "warning", "Tagged PDF marker was not observed", "recommendation"),
    "RR-17d": ("AUD-17", "info", "PDF encryption dictionary was observed", "information"),
}


def trimmed(c: Column) -> Column:
    """Trimmed of all Unicode white space; null becomes empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, "")


def finding(condition: Column, rule: str, severity: str, message: str, kind: str, **evidence: Column) -> Column:
    """A finding where ``condition`` holds, else null; evidence is JSON."""
    said = F.to_json(F.struct(*[v.alias(k) for k, v in evidence.items()]))
    fixed = {"rule_id": rule, "severity": severity, "message": message}
    return F.when(condition, F.struct(*[F.lit(v).alias(k) for k, v in fixed.items()], said.alias("evidence"), F.lit(kind).alias("classification")))


def _emit(df: DataFrame, keys: list[str], checks: list[Column], lists: list[Column] = []) -> DataFrame:  # noqa: B006
    """Rows of ``df`` times their findings; a row without any gives none."""
    every = F.concat(F.array(*checks), *lists) if lists else F.array(*checks)
    return df.select(*keys, F.inline(F.filter(every, lambda f: f.isNotNull())))


def page_findings(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of pages: ``keys, rule_id, severity, message, evidence, classification``.

    ``pages`` has ``document_url, status_code, headers`` (map with lower-case names), ``depth, inlinks, in_sitemap,
    robots_blocked, exact_duplicate_count`` and ``page``, a record of ``functions.html.page``. Nulls count as
    empty texts, zero and false. A page's findings are independent of other rows.
    """
    p = F.col("page")
    status, depth, inlinks = (F.coalesce(F.col(c), F.lit(0)) for c in ("status_code", "depth", "inlinks"))
    title, description = F.length(trimmed(p["title"])), F.length(trimmed(p["meta_description"]))
    empty = lambda kind: F.from_json(F.lit("[]"), kind)
    headings = F.coalesce(p["headings"], empty("array<struct<level int, text string>>"))
    h1 = F.filter(headings, lambda h: h["level"] == 1)
    first_h1 = F.when(F.size(h1) > 0, h1[0]["text"])
    canonicals = F.coalesce(p["canonicals"], F.array().cast("array<string>"))
    images, links = F.coalesce(p["images"], F.array().cast(_type(pages, "images"))), F.coalesce(p["links"], F.array().cast(_type(pages, "links")))
    robots_header = F.coalesce(F.element_at("headers", "x-robots-tag"), F.lit(""))
    noindex = meta_noindex(p["meta_robots"], robots_header)
    no_alt = F.size(F.filter(images, lambda i: ~i["alt_present"]))
    no_size = F.size(F.filter(images, lambda i: (i["width"] == 0) | (i["height"] == 0)))
    viewport = F.regexp_replace(F.lower(F.coalesce(p["viewport"], F.lit(""))), " ", "")
    nofollow = F.size(F.filter(links, lambda x: F.array_contains(F.split(F.lower(x["rel"]), "[,; ]"), "nofollow")))
    plain = lambda x: F.lower(x["url"]).startswith("http://")
    mixed = F.size(F.filter(links, plain)) + F.size(F.filter(images, plain))
    https = urls.scheme(F.col("document_url")) == "https"
    no = F.lit
    bad = F.filter(F.coalesce(p["hreflangs"], F.array().cast(_type(pages, "hreflangs"))), lambda h: ~h["language"].rlike(LANGUAGE))
    data = F.coalesce(p["structured_data"], F.array().cast(_type(pages, "structured_data")))
    per_language = F.transform(bad, lambda h: finding(no(True), *FOUND["RP-09"], hreflang=h["language"], target=h["url"]))
    compact = lambda d: F.exists(d["types"], lambda t: (F.trim(t) != "") & ~t.contains(":"))
    known = lambda d: F.exists(d["contexts"], lambda c: F.rtrim(F.lower(F.trim(c)), F.lit("/")).isin("https://schema.org", "http://schema.org") | (c == "[inline context]"))
    syntax = F.transform(data, lambda d, i: finding(~d["valid"], *FOUND["RP-13a"], format=d["format"], block_index=i))
    structure = F.transform(data, lambda d, i: finding(d["valid"] & (F.size(d["structural_errors"]) > 0), *FOUND["RP-13b"], block_index=i, errors=d["structural_errors"]))
    context = F.transform(
        data,
        lambda d, i: finding(d["valid"] & (d["format"] == "json-ld") & compact(d) & ~known(d), *FOUND["RP-13c"], block_index=i, types=d["types"]),
    )
    checks = [
        finding((status < 200) | (status >= 400), *FOUND["RP-01"], status_code=status),
        finding(title == 0, *FOUND["RP-02a"], field=no("title"), length=title),
        finding((title > 0) & (title < TITLE[0]), *FOUND["RP-02b"], field=no("title"), length=title, minimum=no(TITLE[0])),
        finding(title > TITLE[1], *FOUND["RP-02c"], field=no("title"), length=title, maximum=no(TITLE[1])),
        finding(description == 0, *FOUND["RP-02d"], field=no("meta_description"), length=description),
        finding((description > 0) & (description < DESCRIPTION[0]), *FOUND["RP-02e"], field=no("meta_description"), length=description, minimum=no(DESCRIPTION[0])),
        finding(description > DESCRIPTION[1], *FOUND["RP-02f"], field=no("meta_description"), length=description, maximum=no(DESCRIPTION[1])),
        finding(F.size(h1) == 0, *FOUND["RP-03a"], h1_count=no(0)),
        finding(F.size(h1) > 1, *FOUND["RP-03b"], h1_count=F.size(h1)),
        finding(F.coalesce(F.lower(trimmed(first_h1)) == F.lower(trimmed(p["title"])), no(False)) & first_h1.isNotNull(), *FOUND["RP-03c"], title=p["title"], h1=first_h1),
        finding(F.size(canonicals) == 0, *FOUND["RP-04a"], canonical_count=no(0)),
        finding(F.size(canonicals) > 1, *FOUND["RP-04b"], canonicals=canonicals),
        finding((F.size(canonicals) == 1) & ~F.coalesce(F.get(canonicals, 0), no("")).rlike("(?i)^https?://[^/?#]"), *FOUND["RP-04c"], canonical=F.get(canonicals, 0)),
        finding((status != 200) | noindex, *FOUND["RP-05"], status_code=status, noindex=noindex),
        finding(~F.coalesce("in_sitemap", no(False)) & (status == 200) & ~noindex, *FOUND["RP-06"], in_sitemap=no(False)),
        finding(F.coalesce("robots_blocked", no(False)), *FOUND["RP-07"], robots_blocked=no(True)),
        finding(F.coalesce(F.col("exact_duplicate_count"), no(0)) > 0, *FOUND["RP-08"], content_hash=p["content_hash"], duplicate_count=F.col("exact_duplicate_count")),
        finding(no_alt > 0, *FOUND["RP-10"], missing_alt=no_alt, image_count=F.size(images)),
        finding(no_size > 0, *FOUND["RP-16a"], missing_dimensions=no_size, image_count=F.size(images)),
        finding(viewport == "", *FOUND["RP-15a"], viewport=no("")),
        finding((viewport != "") & ~viewport.contains("width=device-width"), *FOUND["RP-15b"], viewport=p["viewport"]),
        finding((p["amp_url"] != "") & urls.same_url(p["amp_url"], F.col("document_url")), *FOUND["RP-15c"], amp_url=p["amp_url"]),
        finding((p["mobile_alternate"] != "") & urls.same_url(p["mobile_alternate"], F.col("document_url")), *FOUND["RP-15d"], mobile_alternate=p["mobile_alternate"]),
        finding(depth > DEEP, *FOUND["RP-11a"], depth=depth, threshold=no(DEEP)),
        finding((depth > 0) & (inlinks == 0), *FOUND["RP-11b"], inlinks=no(0)),
        finding(nofollow > 0, *FOUND["RP-11c"], nofollow_links=nofollow),
        finding(https & (mixed > 0), *FOUND["RP-12a"], mixed_content_references=mixed),
        finding(https & (F.coalesce(F.element_at("headers", "content-security-policy"), no("")) == ""), *FOUND["RP-12b"], header=no("Content-Security-Policy")),
    ]
    return _emit(pages.withColumn("headers", F.coalesce("headers", F.create_map().cast("map<string,string>"))), keys, checks, [per_language, syntax, structure, context])


def _type(pages: DataFrame, field: str) -> str:
    return pages.schema["page"].dataType[field].dataType.simpleString()


def resource_findings(resources: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of resources that are no pages: failing, large or old images, and PDF files without metadata.

    ``resources`` has ``status_code, content_type, decoded_bytes, body``; nulls count as empty and zero.
    """
    kind = F.lower(F.split_part(F.coalesce("content_type", F.lit("")), F.lit(";"), F.lit(1)))
    status, size, body = F.coalesce("status_code", F.lit(0)), F.coalesce("decoded_bytes", F.lit(0)), F.coalesce("body", F.lit(""))
    pdf = (kind == "application/pdf") | body.startswith("%PDF-")
    image = kind.startswith("image/")
    checks = [
        finding((status < 200) | (status >= 400), *FOUND["RR-01"], status_code=status, content_type=kind),
        finding(image & (size > LARGE_IMAGE), *FOUND["RR-16b"], decoded_bytes=size, threshold_bytes=F.lit(LARGE_IMAGE), content_type=kind),
        finding(kind.isin("image/bmp", "image/tiff"), *FOUND["RR-16c"], content_type=kind),
        finding(pdf & ~body.contains("/Title"), *FOUND["RR-17a"], check=F.lit("info_title"), decoded_bytes=size),
        finding(pdf & ~body.contains("/Lang"), *FOUND["RR-17b"], check=F.lit("document_language")),
        finding(pdf & ~body.contains("/Marked true") & ~body.contains("/Marked(true)"), *FOUND["RR-17c"], check=F.lit("marked_content")),
        finding(pdf & body.contains("/Encrypt"), *FOUND["RR-17d"], encrypted=F.lit(True)),
    ]
    return _emit(resources, keys, checks)


def classification() -> Column:
    """Class of a finding by its ``message`` as the table has it; of others by ``severity``."""
    known = F.create_map(*[F.lit(x) for _, _, message, kind in FOUND.values() for x in (message, kind)])
    return F.coalesce(F.try_element_at(known, F.col("message")), F.when(F.col("severity") == "info", "information").otherwise("review"))


def vocabulary_findings(blocks: DataFrame, keys: list[str], terms: DataFrame) -> DataFrame:
    """Unknown and superseded vocabulary terms of structured data.

    ``blocks`` has ``block_index, types, properties, contexts``; ``terms`` has ``kind`` (``type`` or ``property``),
    ``name, superseded_by``. Only terms of the vocabulary are judged: all where its context is declared, else
    those written with its prefix or address. The join is left to the optimizer, ``terms`` being small.
    """
    explicit = F.exists("contexts", lambda c: F.rtrim(F.lower(F.trim(c)), F.lit("/")).isin("https://schema.org", "http://schema.org"))
    both = [blocks.select(*keys, "block_index", explicit.alias("own"), F.lit(kind).alias("kind"), F.explode(column).alias("term")) for kind, column in (("type", "types"), ("property", "properties"))]
    used = both[0].unionByName(both[1])
    name = F.regexp_replace(F.trim("term"), r"(?i)^(schema:|https?://schema\.org/)", "")
    eligible = used.filter("own or " + "lower(trim(term)) rlike '^(schema:|https?://schema[.]org/)'").withColumn("name", name).filter(~F.col("name").rlike("[:/]") & (F.col("name") != ""))
    known = terms.select("kind", "name", "superseded_by", F.lit(True).alias("known"))
    judged = eligible.join(known, ["kind", "name"], "left")
    unknown = F.when(F.col("kind") == "type", FOUND["RP-13d"][2]).otherwise(FOUND["RP-13e"][2])
    message = F.when(F.col("known").isNull(), unknown).when(F.coalesce("superseded_by", F.lit("")) != "", FOUND["RP-13f"][2])
    severity = F.when(F.col("known").isNull(), "error").otherwise("warning")
    return judged.select(*keys, "block_index", "name", F.lit("AUD-13").alias("rule_id"), severity.alias("severity"), message.alias("message"), "superseded_by").filter("message is not null")


def type_closure(parents: DataFrame, rounds: int = 64) -> DataFrame:
    """All ancestors of each type, itself included: ``name, ancestor``; circles end by themselves.

    ``parents`` has ``name, parent``. Pairs double their reach in each round until none is new.
    """
    own = parents.select("name").unionByName(parents.select(F.col("parent").alias("name"))).filter("name is not null").distinct()
    pairs = own.select("name", F.col("name").alias("ancestor")).unionByName(parents.filter("parent is not null").select("name", F.col("parent").alias("ancestor"))).distinct()
    size = pairs.count()
    for _ in range(rounds):
        step = pairs.select(F.col("name").alias("middle"), F.col("ancestor").alias("far"))
        pairs = pairs.join(step, pairs["ancestor"] == step["middle"]).select("name", F.col("far").alias("ancestor")).distinct()
        now = pairs.count()
        if now == size:
            break
        size = now
    return pairs


def guidance_findings(nodes: DataFrame, keys: list[str], properties: DataFrame, closure: DataFrame) -> DataFrame:
    """Nodes whose types fit none of a property's domains, and nested nodes that fit none of its ranges.

    ``nodes`` has ``block_index, path, types, properties`` (one row per typed node), ``properties`` has ``name,
    domains, ranges``, ``closure`` the pairs of ``type_closure``. A property without domains or ranges, and a node
    without types, is not judged. Returns ``keys, block_index, path, property, message``.
    """
    at = [*keys, "block_index"]
    typed = nodes.filter(F.size("types") > 0)
    used = typed.select(*at, "path", "types", F.explode("properties").alias("property")).join(properties.withColumnRenamed("name", "property"), "property")
    nested = typed.select(*at, F.col("path").alias("inner"), F.col("types").alias("inner_types"), F.regexp_replace("path", r"(\[\d+\])+$", "").alias("slot"))
    slot = used.filter(F.size("ranges") > 0).withColumn("slot", F.concat("path", F.lit("."), "property")).join(nested, [*at, "slot"])
    domain, rangy = FOUND["RP-13g"][2], FOUND["RP-13h"][2]
    asked = used.filter(F.size("domains") > 0).select(*at, "path", "property", F.lit(domain).alias("message"), "types", F.col("domains").alias("wanted"))
    asked = asked.unionByName(slot.select(*at, F.col("inner").alias("path"), "property", F.lit(rangy).alias("message"), F.col("inner_types").alias("types"), F.col("ranges").alias("wanted")))
    which = [*at, "path", "property", "message"]
    fits = asked.select(*which, F.explode("types").alias("name"), "wanted").join(closure, "name").filter(F.array_contains("wanted", F.col("ancestor"))).select(*which).distinct()
    return asked.select(*which).distinct().join(fits, which, "left_anti")
