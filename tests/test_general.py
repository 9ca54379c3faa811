import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlmill.operators import flatten, keystats, snapshots
from crawlmill.operators.scale import join_classes


def test_join_classes_with_a_hot_class(spark, monkeypatch):
    """Hot and other classes give the same rows as a plain join."""
    monkeypatch.setattr("crawlmill.operators.scale.HOT_CLASSES", 1)
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    classes = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k < 40").withColumn("v", F.col("k") * 2)
    got = sorted((r.id, r.k, r.v) for r in join_classes(rows, classes, ["k"], "n", ["v"], F.col("id")).collect())
    want = sorted((r.id, r.k, r.v) for r in rows.join(classes, "k").collect())
    assert got == want


def test_dense_sums_against_counter(spark):
    """Exact sums with a hot key, nulls and repeated rows; extra columns don't matter."""
    random.seed(1)
    rows = [("hot" if random.random() < 0.4 else None if random.random() < 0.1 else f"k{random.randrange(300)}", random.randrange(3), "x") for _ in range(5000)]
    df = spark.createDataFrame(rows, "k string, v int, block string").repartition(7)
    got = {r.key_value: (r.rows, r.s) for r in keystats.dense_sums(df, "k", {"s": "v"}).collect()}
    want = defaultdict(lambda: [0, 0])
    for k, v, _ in rows:
        if k is not None:
            want[k][0] += 1
            want[k][1] += v
    assert got == {k: tuple(v) for k, v in want.items()}
    assert keystats.dense_sums(df.limit(0), "k", {"s": "v"}).count() == 0
    assert {r.key_value for r in keystats.heavy_keys(df, "k", 0.3).collect()} == {"hot"}


def test_url_figures(spark):
    rows = [("a", "x", "t"), ("a", "x", ""), ("a", "y", None), ("b", None, "t"), (None, "x", "t")]
    got = {r.key_value: (r.links, r.with_text, r.partners, r.texts) for r in keystats.url_figures(spark.createDataFrame(rows, "k string, p string, t string"), {"k": "p"}, "t").collect()}
    assert got == {"a": (3, 1, 2, 1), "b": (1, 1, 0, 1)}
    both = keystats.url_figures(spark.createDataFrame([*rows, ("x:y", "a", "")], "k string, p string, t string"), {"k": "p", "p": "k"}, "t")
    assert {(r.key_field, r.key_value, r.links, r.partners) for r in both.collect()} == {("k", "a", 3, 2), ("k", "b", 1, 0), ("k", "x:y", 1, 1), ("p", "x", 3, 1), ("p", "y", 1, 1), ("p", "a", 1, 1)}
    assert keystats.url_figures(spark.createDataFrame([], "k string, p string, t string"), {"k": "p"}, "t").count() == 0


def test_snapshots_against_brute_force(spark):
    random.seed(2)
    state, rows = {}, []
    for number in range(1, 5):
        for _ in range(40):
            state[(random.choice("pq"), f"u{random.randrange(60)}")] = random.randrange(3)
        for k in random.sample(sorted(state), 15):
            del state[k]
        rows += [(p, number, u, None if v == 0 else v, number * 100 + i) for i, ((p, u), v) in enumerate(state.items())]
        rows += [(p, number, u, 9, -1) for (p, u) in list(state)[:5]]  # older rows of the same key don't count
    rows = [r for r in rows if not (r[0] == "q" and r[1] == 3)]  # a snapshot without rows
    rows.append((None, 1, "u1", 1, 1))
    df = spark.createDataFrame(rows, "project string, number long, url string, v int, at long")
    bounds = spark.createDataFrame([("p", 1, 4), ("q", 1, 4)], "project string, first long, last long")
    got = {tuple(r) for r in snapshots.snapshot_changes(df, "project", "number", "url", {"v": F.coalesce("v", F.lit(0))}, ["at"], bounds).collect()}
    latest = {}
    for p, n, u, v, at in sorted((r for r in rows if r[0]), key=lambda r: r[4]):
        latest[p, n, u] = v or 0
    want = set()
    for p in "pq":
        for n in range(2, 5):
            old = {u: v for (a, b, u), v in latest.items() if (a, b) == (p, n - 1)}
            new = {u: v for (a, b, u), v in latest.items() if (a, b) == (p, n)}
            want |= {(p, n, u, "added") for u in new.keys() - old.keys()} | {(p, n, u, "removed") for u in old.keys() - new.keys()}
            want |= {(p, n, u, "changed") for u in new.keys() & old.keys() if new[u] != old[u]}
    assert got == want
    # A later run takes up the ordinals of an earlier one and extends them.
    first = snapshots.assign_ordinals(df.filter("number <= 2"), "project", "url", 3)
    watched = {"v": F.coalesce("v", F.lit(0))}
    again = snapshots.snapshot_changes(df, "project", "number", "url", watched, ["at"], bounds, 3, first)
    assert {tuple(r) for r in again.collect()} == want
    assert snapshots.snapshot_changes(df.limit(0), "project", "number", "url", {"v": F.col("v")}, ["at"], bounds).count() == 0


def test_ordinals_persist(spark):
    a = spark.createDataFrame([("p", f"u{i}") for i in range(50)], "s string, k string")
    first = snapshots.assign_ordinals(a, "s", "k", 4)
    b = spark.createDataFrame([("p", f"u{i}") for i in range(30, 80)], "s string, k string")
    known = {(r.k, r.block, r.position) for r in first.collect()}
    second = snapshots.assign_ordinals(b, "s", "k", 4, first).collect()
    assert known <= {(r.k, r.block, r.position) for r in second}
    assert len({(r.block, r.position) for r in second}) == len(second) == 80


@pytest.mark.parametrize("size", [0, 3, 5000, 200_000])
def test_bitmaps(size):
    """AND and AND-NOT of compressed bitmaps equal those of sets, listed and packed containers mixed."""
    rng = np.random.default_rng(size)
    a, b = (np.unique(rng.integers(0, 300_000, n)) for n in (size, 20_000))
    x, y = snapshots.Bitmap.of(a[::-1].copy()), snapshots.Bitmap.of(b)
    assert x.positions().tolist() == a.tolist()
    for mine, other, p, q in ((x, y, a, b), (y, x, b, a)):
        assert mine.combine(other, True).positions().tolist() == np.intersect1d(p, q).tolist()
        assert mine.combine(other, False).positions().tolist() == np.setdiff1d(p, q).tolist()


def paths(text):
    return [p for _, _, _, p, kind, _ in flatten.parts(text) if kind == "object"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a":{"b":[{"c":1},2,[{"d":{}}]]}}', ["$", "$.a", "$.a.b[0]", "$.a.b[2][0]", "$.a.b[2][0].d"]),
        (json.dumps('{"a": {"b": null}}'), ["$", "$.a"]),
        (json.dumps(json.dumps('{"a": {}}')), []),
        ("[{}, {}]", ["$[0]", "$[1]"]),
        ("{", []), ("", []), (None, []), ("NaN", []), ('{"a": NaN}', []), ("3", []), ('"x"', []), ("[]", []), ('{"a":1}x', []),
    ],
)
def test_json_parts(text, want):
    assert paths(text) == want


def test_deep_json_needs_no_recursion():
    deep = 60_000
    assert len(paths('{"a":' * deep + "1" + "}" * deep)) == deep
    assert flatten._load_deep(' { "a" : [ 1 , "x\\n" , { } , [ ] , true ] , "b" : { "c" : -1.5e2 } } ') == json.loads('{"a":[1,"x\\n",{},[],true],"b":{"c":-150.0}}')
    for bad in ("{", "[1,]", '{"a"}', '{"a":1,}', "[1 2]", "1 2", "{1:2}", "]", '{"a":}', "", ",", '[,1]', '{"a" "b"}'):
        with pytest.raises(ValueError):
            flatten._load_deep(bad)


def test_flatten_keeps_links(spark, tmp_path):
    one = '{"x":1,"items":[{"n":"a","tags":["t",null]},{"n":"b"}]}'
    rows = [(1, one, "d"), (1, one, "d"), (2, None, "d"), (None, "{}", "d"), (3, '{"\\ud800":{}}', "d"), (4, '{"a.b":{"x":1},"a":{"b":{"y":2}}}', "d")]
    df = spark.createDataFrame(rows, "id long, j string, tag string")
    flat = flatten.flatten(df, "r", "id", "j")
    every = flat.collect()
    assert len({r.pk for r in every}) == len(every)  # a record delivered twice is read once, no parts share a key
    got = {(r.record_key, r.object_path): r for r in every}
    assert got["1", "$.items[1]"].parent_pk == got["1", "$"].pk and got["1", "$.items[1]"].tag == "r.items"
    assert json.loads(got["1", "$.items[0].tags[0]"].payload) == "t" and got["1", "$.items[0].tags[0]"].parent_pk == got["1", "$.items[0]"].pk
    assert ("3", "$.?") in got
    same = sorted(r.payload for r in every if (r.record_key, r.object_path) == ("4", "$.a.b"))
    assert same == ['{"x":1}', '{"y":2}']
    flatten.write_tables(flat, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert [r.n for r in flatten.typed_table(back, "r.items", "n string").orderBy("pk").collect()] == ["a", "b"]
    assert flatten.flatten(df.limit(0), "r", "id", "j").count() == 0
    assert flatten.flatten(df, "r", "id", "j", ("object_path",), ("object",)).filter("record_key = '1'").count() == 6


def test_queries_and_sql_have_one_name_space():
    from crawlmill.plans import catalog

    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert Counter(k for k in catalog.QUERIES).most_common(1)[0][1] == 1


@pytest.mark.parametrize("name", ["p3_found", "p5_found", "p6_found", "p7_found"])
def test_found_queries_match_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    from crawlmill.plans import catalog

    got = sorted(map(tuple, catalog.QUERIES[name](spark, sf).collect()))
    if name not in catalog.ORACLES:
        assert got
        return
    con = duckdb.connect()
    for t in ("discovery", "fetch_result", "link_record", "page_record", "crawl_run", "structured_data", "issue", "integration_observation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cols = catalog.QUERIES[name](spark, sf).columns
    assert got == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLES[name]})").fetchall())
