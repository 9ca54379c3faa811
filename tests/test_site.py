import os
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlmill.functions import html
from crawlmill.operators import audits, frontier, graph, neardup, reads, rules
from crawlmill.plans import catalog, site
from crawlmill.sources import exports
from crawlmill.streaming import progress

CLEAN = "<html lang=en><head><title>A healthy page with a good and long title</title><meta name=description content='{d}'><meta name=viewport content='width=device-width'><link rel=canonical href='https://x.example/a'></head><body><h1>Other heading</h1>{b}</body></html>"


def findings(spark, body, **context):
    base = {"document_url": "http://x.example/a", "status_code": 200, "headers": {}, "depth": 0, "inlinks": 1, "in_sitemap": True, "robots_blocked": False, "exact_duplicate_count": 0}
    row = base | context
    kind = "document_url string, status_code int, headers map<string,string>, depth int, inlinks int, in_sitemap boolean, robots_blocked boolean, exact_duplicate_count int, body string"
    df = spark.createDataFrame([(*row.values(), body)], kind)
    df = df.withColumn("page", html.page(F.col("document_url"), F.col("body")))
    return sorted((r.rule_id, r.message, r.severity, r.classification) for r in rules.page_findings(df, []).collect())


def page(b="", d="d" * 80):
    return CLEAN.replace("{d}", d).replace("{b}", b)


def test_page_rules(spark):
    """One defect gives its finding and no other."""
    assert findings(spark, page()) == []
    only = lambda *a, **k: [(r, m) for r, m, _, _ in findings(spark, *a, **k)]
    assert only(page(), status_code=404) == [("AUD-01", "Page response is not successful"), ("AUD-05", "Page is not indexable")]
    assert only(page(d="")) == [("AUD-02", "Meta description is missing or empty")]
    assert only(page("<h1>x</h1>")) == [("AUD-03", "Page has multiple H1 headings")]
    assert only(page("<link rel=canonical href=/b>")) == [("AUD-04", "Page has conflicting canonical elements")]
    assert only(page(), in_sitemap=False) == [("AUD-06", "Indexable page was not observed in a sitemap")]
    assert only(page(), robots_blocked=True) == [("AUD-07", "URL is blocked by robots.txt")]
    assert only(page(), exact_duplicate_count=2) == [("AUD-08", "Page has exact content duplicates")]
    assert only(page("<link rel=alternate hreflang=english_US href=/b>")) == [("AUD-09", "Hreflang language or region is invalid")]
    assert only(page("<img src=i width=1 height=1>")) == [("AUD-10", "Images are missing alt attributes")]
    assert only(page(), depth=5) == [("AUD-11", "Page is deeper than the configured threshold")]
    assert only(page("<img src=http://y.example/i alt='' width=1 height=1>"), document_url="https://x.example/a") == [("AUD-12", "Content-Security-Policy header was not observed"), ("AUD-12", "HTTPS page references HTTP resources")]
    assert only(page("<script type='application/ld+json'>{</script>")) == [("AUD-13", "JSON-LD syntax is invalid")]
    assert only(page("<script type='application/ld+json'>{\"@type\":\"Thing\"}</script>")) == [("AUD-13", "Compact structured-data types have no observed Schema.org context")]
    assert only(page("<link rel=amphtml href=http://x.example/a>")) == [("AUD-15", "AMP alternate self-references the current page")]
    assert only(page("<img src=i alt='' width=1>")) == [("AUD-16", "Images omit declared width or height")]
    nulls = findings(spark, None, status_code=None, headers=None, depth=None, inlinks=None, in_sitemap=None, robots_blocked=None, exact_duplicate_count=None)
    assert ("AUD-02", "Title is missing or empty", "error", "deterministic") in nulls


def test_resource_rules(spark):
    df = spark.createDataFrame([(1, 200, "application/pdf", 5, "%PDF-1.7"), (2, 200, "image/bmp; q", 600_000, ""), (3, None, None, None, None)], "id int, status_code int, content_type string, decoded_bytes long, body string")
    got = {(r.id, r.message) for r in rules.resource_findings(df, ["id"]).collect()}
    assert len([g for g in got if g[0] == 1]) == 3 and (2, "Image uses a legacy web delivery format") in got and (3, "Resource response is not successful") in got


def test_vocabulary(spark):
    blocks = spark.createDataFrame([(1, 0, ["Product", "Nope", "x:y"], ["name", "old"], ["https://schema.org/"]), (2, 0, ["Nope", "schema:Nope"], [], [])], "id int, block_index int, types array<string>, properties array<string>, contexts array<string>")
    terms = spark.createDataFrame([("type", "Product", None), ("property", "name", None), ("property", "old", "name")], "kind string, name string, superseded_by string")
    got = {(r.id, r.name, r.severity) for r in rules.vocabulary_findings(blocks, ["id"], terms).collect()}
    assert got == {(1, "Nope", "error"), (1, "old", "warning"), (2, "Nope", "error")}
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("d", None)], "name string, parent string")
    closure = {(r.name, r.ancestor) for r in rules.type_closure(pairs).collect()}
    assert ("a", "d") in closure and ("x", "x") in closure and len(closure) == 4 + 3 + 2 + 1 + 4


def test_guidance(spark):
    kind = "id int, block_index int, path string, types array<string>, properties array<string>"
    nodes = spark.createDataFrame([(1, 0, "$", ["Product"], ["offers", "cook"]), (1, 0, "$.offers[0]", ["Person"], ["name"]), (1, 0, "$.offers[1]", ["Offer"], []), (1, 0, "$.x", [], ["cook"])], kind)
    props = spark.createDataFrame([("offers", ["Product"], ["Offer"]), ("cook", ["Recipe"], []), ("name", ["Thing"], [])], "name string, domains array<string>, ranges array<string>")
    closure = rules.type_closure(spark.createDataFrame([("Product", "Thing"), ("Person", "Thing"), ("Offer", "Thing"), ("Recipe", "Thing")], "name string, parent string"))
    got = {(r.path, r.property, r.message.split()[1]) for r in rules.guidance_findings(nodes, ["id"], props, closure).collect()}
    assert got == {("$", "cook", "domain"), ("$.offers[0]", "offers", "range")}


def test_vocabulary_builder(spark):
    from crawlmill.sources import vocabulary

    graph = {"@graph": [{"@id": "schema:Product", "@type": "rdfs:Class", "rdfs:subClassOf": {"@id": "schema:Thing"}}, {"@id": "schema:old", "@type": "rdf:Property", "schema:domainIncludes": [{"@id": "schema:Product"}, {"@id": "schema:Thing"}], "schema:rangeIncludes": {"@id": "schema:Text"}, "schema:supersededBy": {"@id": "schema:new"}}, {"@id": 3}]}
    df = spark.createDataFrame([(json.dumps(graph),), (None,), ("{",)], "text string")
    got = {r.name: r for r in vocabulary.terms(df, "text").collect()}
    assert got["Product"].parents == ["Thing"] and got["old"].domains == ["Product", "Thing"] and got["old"].superseded_by == "new" and len(got) == 2


def greedy(sigs, distance):
    """Earlier documents by the first pair of bands met, then the smallest id."""
    out = {}
    band = lambda s, n: (s >> (13 * n)) & 8191 if n < 4 else s >> 52
    for i, s in sorted(sigs.items()):
        best = None
        for p, (a, b) in enumerate(neardup.PAIRS):
            for j, t in sorted(sigs.items()):
                if j < i and band(s, a) == band(t, a) and band(s, b) == band(t, b) and (s ^ t).bit_count() <= distance:
                    best = best or (p, j, (s ^ t).bit_count())
        if best:
            out[i] = best[1:]
    return out


def test_near_duplicates(spark):
    random.seed(4)
    sigs = {}
    for i in range(150):
        s = random.choice(list(sigs.values())) if sigs and random.random() < 0.7 else random.getrandbits(64)
        for _ in range(random.randrange(4)):
            s ^= 1 << random.randrange(64)
        sigs[i] = s
    df = spark.createDataFrame([(i, s - (1 << 64) if s >> 63 else s) for i, s in sigs.items()] + [(None, 1), (999, None)], "id long, sig long")
    for d in (2, 3):
        assert {r.id: (r.match_id, r.distance) for r in neardup.near_duplicates(df, d).collect()} == greedy(sigs, d)
    assert neardup.near_duplicates(df, 0).count() == 0
    with pytest.raises(ValueError):
        neardup.near_duplicates(df, 4)


def test_finalize_twice_is_the_same(spark, sf, tmp_path):
    found = catalog.QUERIES["gr_finalize"](spark, sf)
    for _ in range(2):
        graph.rebuild(found, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == found.count()


def test_reads(spark):
    assert reads.from_cursor(reads.cursor(["a", 5])) == ["a", 5]
    with pytest.raises(ValueError):
        reads.from_cursor("!!")
    df = spark.createDataFrame([(i, "error" if i % 2 else "info", "R", f"50%_{i}") for i in range(10)], "id int, severity string, rule_id string, evidence_json string")
    assert [r.id for r in reads.keyset(reads.filter_issues(df, "error", "R", "50%_"), "id", 3, 2).collect()] == [5, 7, 9]
    for bad in ({"severity": "x"}, {"rule_id": "r" * 51}, {"search": "s" * 501}):
        with pytest.raises(ValueError):
            reads.filter_issues(df, **bad)
    a = spark.createDataFrame([("u", "t", None), ("v", "t", 1), ("w", "t", 1)], "url string, t string, n int")
    b = spark.createDataFrame([("u", "t", None), ("v", "T", 1), ("x", "t", 1)], "url string, t string, n int")
    assert {tuple(r) for r in reads.compare(a, b, ["url"], ["t", "n"]).collect()} == {("v", "changed"), ("w", "removed"), ("x", "added")}
    big = spark.createDataFrame([(2**62, 1, 4), (10, 3, 10), (5, 0, 9)], "s long, d long, t long")
    assert [r[0] for r in big.select(reads.projected_storage(F.col("s"), F.col("d"), F.col("t"))).collect()] == [2**63 - 1, 34, 5]
    seg = reads.segments(spark.range(25).select(F.lit("c").alias("c"), "id"), "c", "id", 10).orderBy("segment").collect()
    assert [(r.segment, r.n, r.first_key, r.last_key) for r in seg] == [(0, 10, 0, 9), (1, 10, 10, 19), (2, 5, 20, 24)]


def test_scorecard(spark):
    schema = "case string, rule_id string, message string, severity string, classification string"
    a = spark.createDataFrame([("1", "R", "m", "e", "c")] * 2 + [("2", "R", "n", "e", "c")], schema)
    e = spark.createDataFrame([("1", "R", "m", "e", "c"), ("3", "R", "m", "e", "c")], schema)
    r = reads.scorecard(a, e, "case").first()
    assert (r.true_positives, r.false_positives, r.false_negatives) == (1, 2, 1) and r.recall == 0.5


def test_scorecard_matches_evidence_in_order(spark):
    """An expected finding takes the first free one that has its evidence; what it doesn't name may differ."""
    kind = "case string, rule_id string, message string, severity string, classification string, evidence "
    seen = [("1", "R", "m", "e", "c", '{"n":1,"k":true}'), ("1", "R", "m", "e", "c", '{"n":2}'), ("2", "R", "m", "e", "c", None), ("3", "S", "m", "e", "c", "{}")]
    wanted = [("1", "R", "", "e", None, {"n": "2"}), ("1", "R", "m", "e", "c", {"k": "true"}), ("2", "R", "m", "e", "c", {"n": "1"}), ("3", "S", "m", "e", "c", None), ("4", "S", "m", "e", "c", {})]
    got = reads.scorecard(spark.createDataFrame(seen, kind + "string"), spark.createDataFrame(wanted, kind + "map<string,string>"), "case").collect()
    assert {r.rule_id: (r.true_positives, r.false_positives, r.false_negatives) for r in got} == {"R": (2, 1, 1), "S": (1, 0, 1)}
    none = spark.createDataFrame([], kind + "string")
    assert reads.scorecard(none, none, "case").count() == 0


def test_discovered_references(spark):
    body = "<base href='/x/'><base href='/y/'><link rel=icon href=' i.png '><a href=a#f>1</a><a href=a>2</a><area href='mailto:x@y.example'><iframe src='//o.example/'></iframe><a href=''>3</a><a href='b'>4</a>"
    found = ["https://s.example/x/i.png", "https://s.example/x/a", "https://o.example/", "https://s.example/x/b"]
    assert html.discover("https://s.example/p", body, 10) == found and html.discover("https://s.example/p", body, 2) == found[:2]
    assert html.discover(None, body, 5) == [] and html.discover("https://s.example/", None, 5) == [] and html.discover("https://s.example/", "", 5) == []
    df = spark.createDataFrame([("https://s.example/p", body), (None, None)], "u string, b string")
    assert [r[0] for r in df.select(html.discovered(F.col("u"), F.col("b"), 2)).collect()] == [found[:2], []]


def test_record_differences(spark):
    def page(body):
        return spark.createDataFrame([("u", "https://s.example/", body)], "k string, url string, body string").select("k", html.page(F.col("url"), F.col("body")).alias("page"))

    a, b = page("<title>A</title><h1>x</h1><a href=/1>l</a>"), page("<title>B</title><h1>x</h1><img src=/i.png><a href=/1>l</a>")
    got = {r.field: (r.a_value, r.b_value) for r in reads.record_differences(a, b, ["k"]).collect()}
    assert got == {"title": ("A", "B"), "image_count": ("0", "1")}
    assert reads.record_differences(a, a, ["k"]).count() == 0 and reads.record_differences(page(None), page(None), ["k"]).count() == 0


def test_page_detail_keeps_the_first_parts(spark, monkeypatch):
    """A page that nearly all links lead to gathers the first ones only; pages without parts have none."""
    monkeypatch.setattr(reads, "MOST_LINKS", 5)
    pages = spark.createDataFrame([("c", "a", 1), ("c", "b", 2)], "crawl_id string, url string, page_id long")
    links = spark.createDataFrame([("c", "b", "a", i, None, None, None) for i in range(400, 0, -1)] + [("c", None, None, 900, None, None, None)], "crawl_id string, source_url string, target_url string, link_id long, anchor_text string, rel string, kind string")
    data = spark.createDataFrame([(7, 1, "f", None)], "structured_data_id long, page_id long, format string, type_summary string")
    issues = spark.createDataFrame([(3, "page", "x", "R", None, None, None), (4, "page", "2", "R", "info", None, None)], "issue_id long, subject_type string, subject_id string, rule_id string, severity string, classification string, evidence_json string")
    modes = spark.createDataFrame([("c", "a", "raw", "t"), ("c", "a", "rendered", None), ("c", "b", "raw", "t")], "crawl_id string, url string, extraction_mode string, title string")
    got = {r.url: r for r in reads.page_detail(pages, links, data, issues, modes, ["title"]).collect()}
    assert [x.link_id for x in got["a"].inlinks] == [x.link_id for x in got["b"].outlinks] == [1, 2, 3, 4, 5]
    assert got["a"].outlinks is None and [x.issue_id for x in got["b"].issues] == [4] and got["a"].structured_data[0].structured_data_id == 7
    assert [(x.field, x.raw, x.rendered) for x in got["a"].render_differences] == [("title", "t", "")] and got["b"].render_differences is None


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("a", 3, "y")], "k string, n int, t string")
    one = exports.record(df, str(tmp_path / "r"), "report", 30).first()
    again = exports.record(df.repartition(3), str(tmp_path / "r"), "report").first()
    assert (one.rows, one.checksum) == (again.rows, again.checksum) == (3, one.checksum) and one.expires_at > one.created_at and again.expires_at is None
    with pytest.raises(ValueError):
        exports.record(df.limit(1), str(tmp_path / "r"), "report")
    assert exports.record(df.limit(0), str(tmp_path / "e"), "report").first().rows == 0
    known = exports.write_segments(df, str(tmp_path / "s"), "k")
    assert exports.write_segments(df, str(tmp_path / "s"), "k", known).count() == 2
    with pytest.raises(ValueError):
        exports.write_segments(df.withColumn("n", F.col("n") + 1), str(tmp_path / "s"), "k", known)
    assert exports.backup(spark, str(tmp_path / "s"), str(tmp_path / "b"), "k").count() == 2
    assert spark.read.parquet(str(tmp_path / "b")).count() == 3


def test_lease_and_events(spark):
    rows = [(1, "queued", 0, 2, None), (2, "queued", None, None, None), (3, "leased", 9, 0, "2020-01-01"), (4, "leased", 9, 0, "2999-01-01"), (5, "done", 9, 0, None), (6, "queued", 5, 3, None)]
    df = spark.createDataFrame(rows, "crawl_url_id int, state string, priority int, depth int, until string").withColumn("lease_until", F.to_timestamp("until"))
    assert [r.crawl_url_id for r in frontier.lease(df, F.current_timestamp(), 3).collect()] == [3, 6, 2]
    said = spark.createDataFrame([('{"status":"failed"}',), ('{"status":"completed"}',), ('{"recovered":true}',), (None,), ("{",)], "p string")
    assert [r[0] for r in said.select(frontier.event_severity(F.col("p"))).collect()] == ["warning", "info", "warning", "info", "info"]


def test_hot_keys_in_ranges(spark):
    """Windows over a key with nearly all rows are cut into ranges and give what one window would."""
    rows = [("hot" if i % 10 else None, i, i % 3, ["pending", "running", "paused"][i * 7 % 3]) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, n int, d int, s string").repartition(5)
    got = {(r.k, r.n): r.start_s for r in frontier.start_times(df, "k", ["n"], "d").collect()}
    before = {}
    for k, n, d, _ in rows:
        assert got[k, n] == before.get(k, 0)
        before[k] = before.get(k, 0) + d
    last, want = {}, set()
    for k, n, _, state in rows:
        if k in last and last[k] != state:
            want.add((k, n, last[k], state))
        last[k] = state
    assert {(r.k, r.n, r.from_state, r.to_state) for r in frontier.transitions(df, "k", "s", ["n"]).collect()} == want
    assert frontier.start_times(df.limit(0), "k", ["n"], "d").count() == 0


def test_audits(spark):
    body = "<main><i>abcdef</i><i>ghijkl</i><i>m</i></main>"
    d = audits.Definition("x", "main i", max_matches=2, max_value_bytes=4, max_total_bytes=8)
    assert audits.execute(d, body) == (["abcd", "ghij"], 3, True, True)
    assert audits.execute(audits.Definition("a", "b", condition="absent"), body)[2]
    assert audits.execute(audits.Definition("a", "i", take="count"), body)[0] == ["3"]
    df = spark.createDataFrame([(1, body, "z"), (2, None, "z")], "id long, body string, values string")
    assert audits.run_audits(df, "id", [d]).count() == 1
    for bad in ([{"id": "a", "selector": "i", "more": 1}], [{"id": "a", "selector": "i"}] * 2, [{"id": "a", "selector": ""}]):
        with pytest.raises(ValueError):
            audits.load(bad)
    assert audits.load(audits.dump([d])) == [d]


def test_frontier(spark):
    links = frontier.synthetic(spark, 200, 5)
    seeds = spark.createDataFrame([("https://site.example/p/0",), (None,)], "url string")
    found = frontier.crawl(seeds, links, 10)
    assert found.count() == 200 and found.agg(F.max("depth")).first()[0] == 4
    assert frontier.crawl(seeds, links, 10, 7).count() == 7
    with pytest.raises(ValueError):
        frontier.seeds_of_list(spark.range(5).select("id", F.col("id").cast("string").alias("u")), "id", "u", 4)
    log = spark.createDataFrame([("c", 1, "pending"), ("c", 2, "running"), ("c", 3, "pending")], "k string, n int, s string")
    assert [(r.to_state, r.allowed) for r in frontier.transitions(log, "k", "s", ["n"]).orderBy("n").collect()] == [("running", True), ("pending", False)]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1+1", ["a"]), (2, " -x", None), (3, None, []), (4, "ok\x01<&", ["b"])], "id int, t string, a array<string>")
    exports.write_csv(df, str(tmp_path / "c"))
    assert {r.t for r in spark.read.csv(str(tmp_path / "c"), header=True, escape='"').collect()} >= {"'=1+1"}
    exports.write_ndjson(df, str(tmp_path / "j"))
    assert all("t" in json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect())
    exports.write_xlsx({"A": df.drop("a"), "B": df.select("id")}, str(tmp_path / "x.xlsx"))
    with zipfile.ZipFile(tmp_path / "x.xlsx") as z:
        assert b"'=1+1" in z.read("xl/worksheets/sheet1.xml") and len(z.namelist()) == 6
    assert [exports.column_letters(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    manifest = exports.write_segments(df.withColumn("k", F.col("id") % 2), str(tmp_path / "s"), "k")
    back = spark.read.parquet(str(tmp_path / "s"))
    assert exports.verify_segments(back, manifest, "k").count() == 0
    assert {r.state for r in exports.verify_segments(back.filter("id <> 2"), manifest, "k").collect()} == {"changed"}


def test_streams(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("url", T.StringType()), T.StructField("attempt", T.IntegerType()), T.StructField("status_code", T.IntegerType())])
    rows = spark.range(40).select("id", F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.concat(F.lit("u"), F.col("id") % 8).alias("url"), (F.col("id") / 8 + 1).cast("int").alias("attempt"), F.when(F.col("id") % 3 == 0, 503).otherwise(200).alias("status_code"))
    for i in range(4):
        rows.filter(F.col("id") % 4 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: progress.file_stream(spark, str(tmp_path / "in"), schema, 2)

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return spark.table(name)

    assert run(progress.first_sightings(stream(), ["url"], "ts"), "append", "seen").count() == 8
    assert run(progress.window_counts(stream(), "ts", "status_code"), "complete", "windows").agg(F.sum("n")).first()[0] == 40
    states = run(progress.attempt_states(stream(), "url"), "update", "states").groupBy("url").agg(F.max_by("state", "attempt").alias("s"))
    assert states.count() == 8
    for _ in range(2):
        progress.commit_batches(stream(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


@pytest.mark.parametrize("name", sorted(k for k in catalog.ORACLES if not k.startswith("p")))
def test_query_matches_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    found = catalog.QUERIES[name](spark, sf)
    cols = ", ".join(f'"{c}"' for c in found.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    strip = lambda rows: sorted(str([plain(v) for v in r]) for r in rows)
    assert strip(found.collect()) == strip(con.execute(f"SELECT {cols} FROM ({catalog.ORACLES[name]})").fetchall())
