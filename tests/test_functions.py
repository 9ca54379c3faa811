import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlmill.functions import html, robots, text, urls


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTPS://Example.COM:443/a/../b/?z=2&a=2&a=1#fragment", "https://example.com/b/?a=1&a=2&z=2"),
        ("https://x.example/a%2Fb", "https://x.example/a%2Fb"),
        ("https://bücher.example", "https://xn--bcher-kva.example/"),
        ("https://x.example./a//b/./c", "https://x.example/a/b/c"),
        ("http://x.example:8080/?", "http://x.example:8080/"),
        ("http://[::1]:80/", "http://[::1]/"),
        ("http://u@x.example/", None), ("ftp://x.example/", None), ("http://x.example:0/", None), ("http://x.example:70000/", None), ("http://", None),
        ("", None), (None, None), ("https://x.example/" + "a" * 9000, None), ("https://x.example/%zz", None),
    ],
)
def test_normalize(raw, want):
    assert urls.normalize_url(raw) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZ09/.%?&=+é#-_~:@ {}|", max_size=40))
def test_normalize_is_idempotent(tail):
    once = urls.normalize_url("https://x.example/" + tail)
    assert once is None or urls.normalize_url(once) == once


def test_resolve():
    assert urls.resolve_url("https://x.example/a/b", "../c#f") == "https://x.example/c"
    assert urls.resolve_url("https://x.example/a/", "mailto:x@y") is None
    assert urls.resolve_url(None, "x") is None and urls.resolve_url("https://x.example/", "") is None


@pytest.mark.parametrize(("ip", "want"), [("127.0.0.1", "loopback"), ("10.1.2.3", "private"), ("169.254.1.1", "link_local"), ("224.0.0.1", "multicast"), ("0.0.0.0", "unspecified"), ("203.0.113.9", "reserved"), ("8.8.8.8", "public"), ("::ffff:10.0.0.1", "private"), ("x", "invalid_ip"), (None, "invalid_ip")])
def test_ip(ip, want):
    assert urls.classify_ip(ip) == want


def test_native_url_columns(spark):
    rows = [("https://x.example/" + "a/" * 10,), ("https://x.example/?" + "&".join(f"p{i}=1" for i in range(51)),), ("https://shop.x.example/s/t?page=2",), ("https://x.example/?a=%z",), (None,)]
    df = spark.createDataFrame(rows, "url string")
    got = [tuple(r) for r in df.select(urls.trap(F.col("url")), urls.segment(F.col("url")), urls.scope_decision(F.col("url"), ["x.example"], True, exclude_query=["page="])).collect()]
    assert [g[0] for g in got][:4] == ["repeated_path_segment", "excessive_query_parameters", "", "malformed_query"]
    assert got[2][1:] == ("/s/", "query matches exclude scope") and got[1][1] == "/"
    with pytest.raises(ValueError):
        urls.scope_decision(F.col("url"), [])
    dates = spark.createDataFrame([("120",), ("99999",), ("Thu, 01 Jan 2026 00:10:00 GMT",), ("x",), (None,)], "v string")
    assert [r[0] for r in dates.select(urls.retry_after_s(F.col("v"), F.lit("2026-01-01").cast("timestamp"))).collect()] == [120, 900, 600, 0, 0]


ROBOTS = """
User-agent: auditbot
User-agent: other
Disallow: /private
Allow: /private/open$
Crawl-delay: 1.5

User-agent: *
Disallow: /
Sitemap: https://x.example/s.xml
"""


def test_robots(spark):
    rules, maps = robots.parse_robots(ROBOTS)
    assert maps == ["https://x.example/s.xml"] and rules[0]["agents"] == ["auditbot", "other"] and rules[0]["crawl_delay"] == 1.5
    files = spark.createDataFrame([("x.example", ROBOTS), ("y.example", None)], "host string, body string")
    asks = spark.createDataFrame([("x.example", p) for p in ("/", "/private/a", "/private/open", "/private/open/b")] + [("y.example", "/a"), ("z.example", "/a")], "host string, path string")
    got = {(r.host, r.path): r.allowed for r in robots.robots_decisions(files, asks, "AuditBot/1.0").collect()}
    assert got == {("x.example", "/"): True, ("x.example", "/private/a"): False, ("x.example", "/private/open"): True, ("x.example", "/private/open/b"): False, ("y.example", "/a"): True, ("z.example", "/a"): True}
    other = {r.path: r.allowed for r in robots.robots_decisions(files, asks.filter("host = 'x.example'"), "someone").collect()}
    assert not any(other.values())


def test_sitemaps(spark):
    index = '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc> b </loc></sitemap><sitemap><loc>a</loc></sitemap></sitemapindex>'
    leaf = "<urlset><url><loc>u1</loc></url><url><loc>u2</loc></url></urlset>"
    assert robots.parse_sitemap(index) == ("sitemapindex", ["b", "a"]) and robots.parse_sitemap("<x/>") == ("invalid", []) and robots.parse_sitemap(None) == ("invalid", [])
    found = robots.discover_sitemaps(spark.createDataFrame([("a",)], "sitemap_url string"), spark.createDataFrame([("a", index), ("b", leaf)], "sitemap_url string, body string"))
    assert {(r.sitemap_url, r.depth, r.kind) for r in found.collect()} == {("a", 0, "sitemapindex"), ("b", 1, "urlset")}


PAGE = """<!doctype html><html lang=en><head><base href="/b/"><title> A &amp; b </title><meta NAME=description content=" d "><meta name="robots" content="noindex">
<meta property="og:title" content="o"><link rel="canonical" href="c"><link rel="alternate" hreflang="de" href="/de"><link rel=next href=n>
<script type="application/ld+json">{"@context":"https://schema.org","@type":["Product",3],"offers":[{"@type":"Offer","price":1}]}</script></head>
<body><h1>Hi <b>x</b></h1><p>one<p>two<div hidden>no</div><noscript><p>no</p></noscript><a href="#top" rel="nofollow">top</a><a href="mailto:x">m</a>
<img src=i.png width=5 alt=""><ul><li>a<li>b</ul><div itemtype="https://schema.org/Thing" style="display : none">gone</div></body></html>"""


def test_extract():
    p = html.extract("https://x.example/p/", PAGE)
    assert (p["language"], p["title"], p["meta_description"], p["meta_robots"]) == ("en", "A & b", "d", "noindex")
    assert p["canonicals"] == ["https://x.example/b/c"] and p["pagination_next"] == "https://x.example/b/n" and p["social"] == {"og:title": "o"}
    assert p["hreflangs"] == [{"language": "de", "raw": "/de", "url": "https://x.example/de"}]
    assert p["visible_text"] == "Hi x one two top m a b" and p["word_count"] == 8
    assert [x["url"] for x in p["links"]] == ["https://x.example/b/"] and p["images"][0]["alt_present"] and p["images"][0]["width"] == 5
    assert p["headings"] == [{"level": 1, "text": "Hi x"}]
    ld, micro = p["structured_data"]
    assert ld["types"] == ["Offer", "Product"] and ld["structural_errors"] == ["@type arrays must contain only strings"] and ld["nodes"][1]["path"] == "$.offers[0]"
    assert micro["format"] == "microdata"
    assert html.extract("x", None) is None and html.extract(None, "")["visible_text"] == ""
    assert not html.json_ld("{")["valid"]


def test_extract_column(spark):
    df = spark.createDataFrame([("https://x.example/", PAGE), (None, None), ("u", "")], "url string, body string")
    got = [r.p.title for r in df.select(html.page(F.col("url"), F.col("body")).alias("p")).collect()]
    assert got == ["A & b", None, ""]


def test_redact():
    said = html.redact('<p data-token="t"><a href="/a?s=1#x">k</a><script>x()</script><input value=v></p>')
    assert said == '<p data-token="[redacted]"><a href="/a">k</a><script>[redacted]</script><input value="[redacted]"></p>'


def test_selectors():
    root = html.parse('<main><div class="product x" data-live><span class="price">$42</span></div><p class="price">no</p><a rel="next" href="/two">n</a></main>')
    assert [n.text() for n in html.select(root, html.css_steps("main > .product[data-live] .price"))] == ["$42"]
    assert [n.get("href") for n in html.select(root, html.xpath_steps("//main//a[@rel='next']"))] == ["/two"]
    for bad in ("a,b", "a:hover", "", ">"):
        with pytest.raises(ValueError):
            html.css_steps(bad)
    for bad in ("a", "//a[1]", "//a[text()='x']"):
        with pytest.raises(ValueError):
            html.xpath_steps(bad)


def test_simhash(spark):
    assert text.simhash(None) is None and text.simhash(" \n") is None and text.simhash_hex("") == ""
    df = spark.createDataFrame([("a b c d",), ("A  b\nc d",), ("a",), (None,), ("",)], "t string")
    got = [r.h for r in df.select(text.hex16(text.simhash64(F.col("t"))).alias("h")).collect()]
    assert got[0] == got[1] == text.simhash_hex("a b c d") and got[2] == text.simhash_hex("a") and got[3] is None and got[4] is None
