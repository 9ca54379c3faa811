import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlmill.llm import boilerplate, format_duplicates, leakage, mixing, mojibake, queries, spam

TEXTS = ["Größe wählen – jetzt", "Élégant théâtre d’ombres dès 25 €", "Żółty półka na książki już od 49 zł", "Складной чайник на плиту для дачи", "PROMOÇÃO: coleção de botões até 12 prestações", "¿Buscas tazón de té? Aquí verás", "Žlutý příbor na cesty s dlouhou zárukou", "小さな毛布 毎日の暮らしに", "±2 °C accuracy", "Ångström guide", "plain ASCII & more", "½ price"]


@pytest.mark.parametrize("text", TEXTS)
def test_right_texts_stay(text):
    assert mojibake.repair(text) == (text, "", False)


@pytest.mark.parametrize("text", TEXTS[:7])
@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac-roman", "cp437"])
def test_round_trip(text, codec):
    """What a wrong decoder did is undone, once and twice."""
    wrong = text.encode("utf-8").decode(codec, "replace")
    if "�" in wrong:
        assert mojibake.repair(wrong)[2]
        return
    assert mojibake.repair(wrong)[0] == text and mojibake.repair(wrong)[2]


def test_other_garbled_texts():
    assert mojibake.repair("Gr&#195;&#188;ne T&#195;&#188;rklingel")[0] == "Grüne Türklingel"
    assert mojibake.repair("Складной чайник".encode("koi8-r").decode("cp1251"))[0] == "Складной чайник"
    assert mojibake.repair("Складной чайник на плиту".encode("cp1251").decode("latin-1"))[0] == "Складной чайник на плиту"
    assert mojibake.repair("Größe wÃ¤hlen")[0] == "Größe wählen"
    assert mojibake.repair("Peque�o")[2] and mojibake.repair("CiepÅy parasol")[2]
    assert mojibake.repair("Tom &amp; Jerry") == ("Tom &amp; Jerry", "", False)
    assert mojibake.repair(None) == (None, "", False) and mojibake.repair("")[2] is False
    assert mojibake.repair("GrÃ¼ne " * 20_000)[0] == "Grüne " * 20_000


def test_search_is_exhaustive(monkeypatch):
    """The result is the cheapest of all texts within three steps, also where hundreds of states are reached."""
    texts = ["ÐÑÐ¾ÑÐ½ÑÐ¹ ÑÑÑÐ» Ð´Ð»Ñ ÑÐ°Ð´Ð°", "Ð¡ÐºÐ»Ð°Ð´Ð½Ð¾Ð¹ ÑÐ°Ð¹Ð½Ð¸Ðº", "ÐÐ¾Ð²ÑÐ¹ ÑÑÑÐ»", "GrÃƒÂ¼ne TÃƒÂ¼rklingel &#195;&#188;"]
    most = 0
    for text in texts:
        level, reached = {text: 0.0}, {text: 0.0}
        for _ in range(3):
            following = {}
            for state, way in level.items():
                for _, out, step in mojibake.neighbours(state):
                    if way + step < reached.get(out, 1e9):
                        following[out] = reached[out] = min(way + step, following.get(out, 1e9))
            level = following
        most = max(most, len(reached))
        best, steps, wrong = mojibake.repair(text)
        cheapest = min(mojibake.cost(t) + w for t, w in reached.items())
        assert wrong and mojibake.cost(best) + reached[best] <= cheapest + mojibake.CHARSET_COST + mojibake.GAIN
    assert most > 80


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_repair_never_fails(text):
    mojibake.repair(text)


def test_repair_column(spark):
    df = spark.createDataFrame([(1, "GrÃ¼ne", "x"), (2, None, "x"), (3, "", "x"), (4, "ok", "x"), (1, "GrÃ¼ne", "x")], "id long, t string, original string")
    got = mojibake.repair_column(df, ["id"], "t").collect()
    assert [(r.id, r.repaired, r.garbled) for r in got] == [(1, "Grüne", True)] * 2
    assert mojibake.repair_column(df.limit(0), ["id"], "t").count() == 0


def test_format_duplicates_against_brute_force(spark):
    random.seed(5)
    base = [("Red lamp", "A lamp"), ("Blå lampe", "Æ"), ("", ""), ("Größe!", None), ("ab", "cd"), ("dc", "ba"), ("x", "")]
    rows = []
    for i in range(300):
        a, b = random.choice(base)
        a, b = (random.choice([str.upper, str.lower, lambda s: f" {s}. ", lambda s: s])(x) if x else x for x in (a, b))
        if random.random() < 0.3:
            a, b = b, a
        rows.append((random.choice("cd"), i, a, b, "e"))
    rows += rows[:40] + [(None, 900, "Red lamp", "A lamp", "e"), ("c", None, "Red lamp", "A lamp", "e")]
    df = spark.createDataFrame(rows, "crawl string, id long, a string, b string, __n string")
    groups = defaultdict(set)
    norm = lambda s: re.sub(r"[^\w]|_", "", (s or "").lower())
    for c, i, a, b, _ in rows:
        key = tuple(sorted((norm(a), norm(b))))
        if c and i is not None and any(key):
            groups[c, key].add(i)
    want = {(c, min(g), i) for (c, _), g in groups.items() if len(g) > 1 for i in g}
    got = {tuple(r) for r in format_duplicates.duplicate_members(df, "crawl", "id", "a", "b").collect()}
    assert got == want
    copies = {(r.crawl, r.first_id): r.copies for r in format_duplicates.collapse(df, "crawl", "id", "a", "b").collect()}
    assert copies == {(c, min(g)): len(g) for (c, _), g in groups.items() if len(g) > 1}
    assert format_duplicates.duplicate_members(df.limit(0), "crawl", "id", "a", "b").count() == 0


def block_texts(body):
    return [b[0] for b in boilerplate.blocks(body)]


def test_blocks():
    assert block_texts("<html><head><title>t</title></head><body><div>a<p>one<p>two &amp; <b>b</b>&nbsp; c<ul><LI>x<li>y</UL></div><!-- <p>no</p> --><script><p>no</p></script><td>z") == ["one", "two & b c", "x", "y", "z"]
    assert block_texts("<table><tr><td>a<td>b<tr><td>c</table><blockquote><p>q</blockquote><pre>1\n 2</pre><hr><div> </div>") == ["a", "b", "c", "q", "1 2"]
    for none in (None, "", "%PDF-1.7 <<", '{"a": "<p>x</p>"}', "plain"):
        assert block_texts(none) == []
    assert len(block_texts("<p>" + "w " * 500_000)) == 1 and len(block_texts("<div>" * 3000 + "<p>x")) == 1


def test_tree():
    x = np.array([[i % 7, i % 3] for i in range(300)], float)
    y = ((x[:, 0] > 3) & (x[:, 1] < 2)).astype(float)
    tree = boilerplate.grow(x, y)
    assert ((boilerplate.predict(tree, x) > 0.5) == y.astype(bool)).all()


def flattened(body):
    """The page without any container: sectioning tags are gone, text outside of blocks becomes a paragraph."""
    regions = "|".join(sorted(boilerplate.REGION - {"body"}))
    return re.sub(rf"<(?:{regions})\b[^>]*>([^<]*)", lambda m: f"<p>{m[1]}</p>" if m[1].strip() else "", re.sub(rf"</(?:{regions})>", "", body, flags=re.I), flags=re.I)


def test_boilerplate_accuracy(spark, sf):
    """Held-out pages, as they are and without any container: at least 97 % of kept and of article blocks are right."""
    sf = sf.replace("sf0.001", "sf0.01")  # some hundred labelled pages
    rows = [r.body for r in spark.read.parquet(f"{sf}/fetch_result.parquet").unionByName(spark.read.parquet(f"{sf}/fixture_case.parquet"), allowMissingColumns=True).select("body").distinct().orderBy(F.md5("body")).collect()]
    names = boilerplate.container_names()
    known = [(body, p, said) for body, p in ((r, boilerplate.blocks(r)) for r in rows) if p and (said := boilerplate.label(p, names))]
    assert len(known) > 100
    half = len(known) * 2 // 3
    tree, odds = boilerplate.fit([p for _, p, _ in known[:half]], [s for _, _, s in known[:half]])
    for flat in (False, True):
        right = kept = there = 0
        for body, page, said in known[half:]:
            article = Counter(b[0] for b, one in zip(page, said) if one)
            page = boilerplate.blocks(flattened(body)) if flat else page
            own = boilerplate.predict(tree, np.array(boilerplate.features(page, odds), float)) > 0.5
            found = Counter(b[0] for b, one in zip(page, own) if one)
            right, kept, there = right + (article & found).total(), kept + found.total(), there + article.total()
        assert right > 0.97 * kept and right > 0.97 * there


def test_figures_do_not_see_containers():
    page = "<h1>Lamp</h1><p>One two three.</p><ul><li><a href=/>Home</a></ul><p>Imprint</p>"
    named = page.replace("<h1>", "<header></header><article class=content><h1>").replace("<ul>", "</article><nav><ul>").replace("</ul>", "</ul></nav>")
    odds = {"home": -3.0, "imprint": -2.0, "lamp": 1.0}
    assert boilerplate.features(boilerplate.blocks(page), odds) == boilerplate.features(boilerplate.blocks(named), odds)


def test_article_blocks_without_labels(spark):
    df = spark.createDataFrame([("fetch", "1", None), ("fetch", "2", ""), ("fetch", "3", "<p>x</p>"), (None, None, "text")], "record_kind string, record_key string, body string")
    assert boilerplate.article_blocks(df).count() == 0 and boilerplate.article_blocks(df.limit(0)).count() == 0


def test_md5_of_article_blocks(spark):
    body = "<html><body><nav><a href=/>Home page</a></nav><article><h1>A title</h1>" + "".join(f"<p>Sentence number {i} is long enough to be read.</p>" for i in range(9)) + "</article><footer><p>Imprint</p></footer></body></html>"
    df = spark.createDataFrame([("fetch", str(i), body) for i in range(20)], "record_kind string, record_key string, body string")
    got = boilerplate.article_blocks(df, text=True).filter("record_key = '3'").orderBy("position").collect()
    assert [r.block for r in got][1] == "Sentence number 0 is long enough to be read." and "Imprint" not in [r.block for r in got]
    assert all(r.block_md5 == hashlib.md5(r.block.encode()).hexdigest() for r in got)


def test_leakage_against_brute_force(spark, monkeypatch):
    random.seed(6)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "x_y", "1.5"]
    items = [(i, " ".join(random.choices(vocabulary, k=random.choice([0, 3, 7, 10, 14, 40])))) for i in range(40)] + [(99, None)]
    docs = []
    for d in range(150):
        words = random.choices(vocabulary, k=random.randrange(1, 120))
        if random.random() < 0.6:
            said = (random.choice(items)[1] or "").split()
            cut = said[random.randrange(3) :][: random.randrange(1, 30)]
            words[5:5] = [w.upper() for w in cut]
        docs.append((d, random.choice([" ", "\n", "\xa0", ", "]).join(words), "z"))
    docs += [(200, None, "z"), (201, "", "z"), docs[0]]
    words_of = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = set()
    for i, t in items:
        w = words_of(t)
        n = min(10, len(w))
        runs = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for d, text, _ in docs:
            v = words_of(text)
            if any(tuple(v[k : k + n]) in runs for k in range(len(v) - n + 1)) and n:
                want.add((d, i))
    dd = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    ii = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(dd, ii).collect()} == want and want
    monkeypatch.setattr(leakage, "LOOKUPS", 50)  # few postings at once give the same
    texts = [leakage.words_of(t) for _, t, _ in docs]
    got = {(docs[d][0], int(index.items[k])) for index in leakage.build(items) for d, k, _, _ in leakage.search(index, texts)}
    assert got == want
    assert leakage.leaks(dd, ii.limit(0)).count() == 0 and leakage.leaks(dd.limit(0), ii).count() == 0


def test_leakage_in_parts(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MAX_WORDS", 3)
    ii = spark.createDataFrame([(1, "a b c"), (2, "c d e"), (3, None)], "item_id long, text string")
    dd = spark.createDataFrame([(1, "x a b c d e"), (2, "a b")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(dd, ii).collect()} == {(1, 1), (1, 2)}


def test_leakage_of_many_items():
    """Twenty thousand items are one sparse index of bounded size, searched in one pass."""
    rng = random.Random(9)
    words = [f"w{int(50_000 ** rng.random())}" for _ in range(200_000)]
    items = [(i, " ".join(rng.choices(words, k=40))) for i in range(20_000)]
    (index,) = leakage.build(items)
    size = sum(x.nbytes for x in (index.by_item.keys, index.by_item.values, index.by_block.keys, index.by_block.values, index.pivot_blocks, index.pivot_from, *index.words))
    assert size < 60 * 20_000 * 40
    docs = [rng.choices(words, k=60) for _ in range(300)]
    want = set()
    for d in range(0, 300, 3):
        k = rng.randrange(20_000)
        docs[d][20:20] = items[k][1].split()[7:19]
        want.add((d, k))
    assert want <= {(d, int(index.items[k])) for d, k, _, _ in leakage.search(index, docs)}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB é1.\n\t\xa0　'-,  日", max_size=50))
def test_token_counts_are_exact(text):
    counter = test_token_counts_are_exact.counter = getattr(test_token_counts_are_exact, "counter", None) or mixing.TokenCounter()
    assert counter(text) == len(counter._encode(text))


def test_rake():
    cells = pd.DataFrame({"source": ["a", "a", "b", "c", "d"], "language": ["en", "de", "en", "en", "en"], "topic": ["x", "x", "y", "x", "x"], "tokens": [1000, 500, 100, 50, 70]})
    targets = pd.DataFrame({"source": ["a", "b", "c", "n"], "target_share": [0.5, 0.3, 0.1, 0.1], "max_repeats": [1, 3, 5, 2]})
    out = mixing.rake(cells, targets)
    own = (out["weight"] * out["tokens"]).groupby(out["source"]).sum()
    assert own["d"] == 0 and (out["weight"] <= out["max_repeats"].fillna(0) + 1e-9).all()
    assert np.allclose(own[["a", "b", "c"]] / own.sum(), np.array([0.5, 0.3, 0.1]) / 0.9)
    assert (mixing.rake(cells, targets.iloc[:0])["weight"] == 0).all()
    # Wanted shares of languages and topics that the sources and caps allow are reached.
    free = targets.iloc[:3].assign(max_repeats=9)
    out = mixing.rake(cells, free, total=1000, marginals={"language": {"de": 0.3}, "topic": {"x": 0.7, "nowhere": 0.5}})
    mass = out["weight"] * out["tokens"]
    assert np.isclose(mass[out["language"] == "de"].sum() / mass.sum(), 0.3) and np.isclose(mass.sum(), 1000)
    assert np.allclose(mass.groupby(out["source"]).sum()[["a", "b", "c"]] / mass.sum(), np.array([0.5, 0.3, 0.1]) / 0.9)


def test_mix_reaches_its_targets(spark, sf):
    """On real documents every source is within half a point of its share, and no document over its cap."""
    sf = sf.replace("sf0.001", "sf0.01")
    docs, targets = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "mix_target"))
    said = mixing.shares(mixing.mix(docs, targets), targets).join(targets.select("source", "max_repeats"), "source").collect()
    there = sum(r.target_share for r in said if r.tokens)
    assert all(abs(r.actual_share - r.target_share / there) < 0.005 and r.most_copies <= r.max_repeats for r in said if r.tokens)


def test_mix(spark):
    rows = [(i, "ab"[i % 4 == 0], random.choice(["en", "DE", None, "zz"]), "word " * (5 + i % 7), "k") for i in range(400)] + [(900, None, "en", "x", "k"), (901, "c", "en", "x", "k"), (902, "a", "en", "", "k"), (903, "a", "en", None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, tokens string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen = mixing.mix(docs, targets)
    got = chosen.collect()
    assert len({r.doc_id for r in got}) == len(got) and all(r.copies <= {"a": 1, "b": 3}[r.source] for r in got)
    said = {r.source: r for r in mixing.shares(chosen, targets).collect()}
    assert abs(said["a"].actual_share - 5 / 9) < 0.02 and said["none"].actual_share == 0
    assert sorted(map(tuple, mixing.mix(docs.repartition(3), targets).collect())) == sorted(map(tuple, got))
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("cheap lamp, lamp, buy lamp, free lamp, lamp shop, cheap lamp, lamp near me, lamp, order lamp", True),
        ("\n".join(f"https://site{i}.example/lamp" for i in range(9)), True),
        ("#lamp #buylamp #lamp_shop #lamp9 #freelamp #lamp_2026 #orderlamp #lampdeals #lamp3 #lamp_near_me #toplamp", True),
        ("; ".join(["Size: red", "Tag=XL", "Colour 12 cm", "SKU=red"] * 5), True),
        ("Our nightly audit skipped the stale redirects on the test host. Support closed the ticket without a note, and nobody asked why.", False),
        ("- The picture of the lamp weighs 200 kilobytes, more than the page around it.\n- If the crawler ignored empty titles again, shorten the entries first.", False),
        ("red lamp, buy lamp, lamp", True), ("#lamp #buylamp", True), ("https://lamp.example/a\nhttps://lamp.example/b", True), ("buy lamp buy lamp buy lamp", True),
        ("n/a", False), ("", False), (None, False), ("Title only: case 3", False),
    ],
)
def test_spam(text, want):
    assert (spam.judge(text)[0] > 0.5) == want


STUFFED = (
    "Window blind or buy window blind is window blind. Coffee grinder near me with window blind at coffee grinder. Buy coffee grinder for window blind in coffee grinder near me. "
    "Window blind and coffee grinder by window blind near me. Coffee grinder or buy window blind is coffee grinder. Buy window blind with coffee grinder near me at window blind."
)
REAL = [
    "Our nightly audit skipped the stale redirects on the test host because its table was full.", "Support closed the ticket without a note, and nobody asked why until Thursday.",
    "Visitors who open a category page from their phone wait two seconds before any picture appears.", "Please attach raw responses when you report such cases to our team.",
    "An orphaned page is linked from no other, even if some sitemap names it.", "The export keeps its order now, as was asked for in spring.",
]


@pytest.mark.parametrize(("n", "between", "want"), [(0, False, True), (2, False, True), (3, False, True), (3, True, True), (6, False, False), (6, True, False)])
def test_spam_stuffed_sentences(n, between, want):
    """Keyword repetition written as sentences counts by its own words, however much real text is around it."""
    odd = STUFFED.split(". ")
    text = " ".join(f"{odd[i]}. {(REAL[:n] + [''] * 6)[i]}" for i in range(6)) if between else f"{STUFFED}\n{' '.join(REAL[:n])}"
    words = [len(spam.WORD.findall(x)) for x in (STUFFED, " ".join(REAL[:n]))]
    assert (words[0] > words[1]) == want and (spam.judge(text)[0] > 0.5) == want


def test_spam_share_decides(spark):
    line = "The crawler skipped most redirects of our second host because its table was full. "
    more = "Nobody at the desk had changed any settings before that release came out. Please attach raw responses when you report such a case to us. "
    odd = "lamp, " * 20
    df = spark.createDataFrame([(1, line + more + "\n" + odd, 1), (2, line + "\n" + odd, 1), (3, None, 1), (None, odd, 1), (4, "w " * 300_000 + ".", 1)], "doc_id long, text string, words int")
    assert {r.doc_id for r in spam.judged(df).filter("spam").collect()} >= {2, None}
    assert 1 not in {r.doc_id for r in spam.judged(df).filter("spam").collect()}
    assert spam.judged(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    found = queries.QUERIES[name](spark, sf)
    rows = sorted(map(str, map(tuple, found.collect())))
    assert len(set(rows)) == len(rows)
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in ("page_record", "documents", "eval_item"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
        assert rows == sorted(map(str, con.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.ORACLES[name]})").fetchall()))
