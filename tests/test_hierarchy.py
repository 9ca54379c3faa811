import random

import pandas as pd
import pytest

from crawlmill.operators import hierarchy as H

SCHEMA = "key string, parent string, recorded long"


def brute(rows):
    parent = {k: p for k, p in rows}
    every = set(parent) | {p for p in parent.values() if p is not None}
    out = {}
    for k in every:
        seen, cur = [k], parent.get(k)
        while cur is not None and cur not in seen:
            seen.append(cur)
            cur = parent.get(cur)
        if cur is None:
            out[k] = ("tree", len(seen) - 1, seen[-1])
        elif cur == k:
            out[k] = ("cycle", 0, min(seen))
        else:
            out[k] = ("below_cycle", seen.index(cur), min(seen[seen.index(cur) :]))
    return out


@pytest.mark.parametrize(("small", "large"), [(200_000, 200_000), (10, 200_000), (10, 5)])
def test_against_brute_force(spark, monkeypatch, small, large):
    """All three ways (one task, doubling, components never moved) give the brute-force result."""
    monkeypatch.setattr(H, "SMALL", small)
    random.seed(3)
    rows = []
    for i in range(200):
        p = random.choice([None, i - 1 if i else None, random.randrange(200), max(0, i - random.randrange(1, 4))]) if random.random() < 0.9 else 10_000 + i % 5
        rows.append((f"k{i:04}", None if p is None else f"k{p:04}"))
    found = {r.key: r for r in H.hierarchy(spark.createDataFrame([(k, p, 0) for k, p in rows], SCHEMA), large).collect()}
    want = brute(rows)
    assert {k: (r.state, r.depth, r.root) for k, r in found.items()} == want
    below = {}
    for r in found.values():
        for a in r.path[:-1]:
            below[a] = below.get(a, 0) + 1
    assert all(r.n_descendants == below.get(k, 0) for k, r in found.items())


def test_edges(spark):
    """Null keys are dropped, repeated rows count once, a lost parent is a node of its own, no rows give none."""
    rows = [(None, "a", 1), ("a", None, 0), ("b", "a", 1), ("b", "a", 1), ("c", "gone", 3), ("s", "s", 0)]
    found = {r.key: r for r in H.hierarchy(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(found) == {"a", "b", "c", "s", "gone"}
    assert found["c"].root_lost and found["gone"].lost and not found["b"].root_lost
    assert found["s"].state == "cycle" and found["a"].n_descendants == 1
    assert H.hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0
    pairs = {(r.ancestor, r.descendant) for r in H.descendants(H.hierarchy(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert pairs == {("a", "b"), ("gone", "c")}


def test_long_chain(spark):
    rows = [(f"n{i:05}", f"n{i - 1:05}" if i else None, i) for i in range(3000)]
    found = H.hierarchy(spark.createDataFrame(rows, SCHEMA))
    assert found.filter("depth <> recorded").count() == 0


def test_long_chains_by_doubling(spark, monkeypatch):
    """No node of a long chain is taken for one of a circle, be it alone or next to a circle with a long tail."""
    monkeypatch.setattr(H, "SMALL", 10)
    chain = [(f"n{i:05}", f"n{i - 1:05}" if i else None, i) for i in range(300)]
    circle = [(f"c{i:05}", f"c{(i + 1) % 50:05}", 0) for i in range(50)]
    tail = [(f"t{i:05}", f"t{i - 1:05}" if i else "c00003", i + 1) for i in range(90)]
    for rows in (chain, chain + circle + tail):
        found = {r.key: (r.state, r.depth, r.root) for r in H.hierarchy(spark.createDataFrame(rows, SCHEMA), paths=False).collect()}
        want = {"n": ("tree", "n00000"), "c": ("cycle", "c00000"), "t": ("below_cycle", "c00000")}
        assert found == {k: (want[k[0]][0], depth, want[k[0]][1]) for k, _, depth in rows}


def test_paths_in_parts_and_without(spark, monkeypatch):
    """Rows handed on in small parts keep their paths; without paths all else stays."""
    rows = spark.createDataFrame([(f"n{i:03}", f"n{i // 2:03}" if i > 1 else None, i) for i in range(1, 200)], SCHEMA)
    want = {r.key: r for r in H.hierarchy(rows).collect()}
    part = pd.DataFrame([(r.key, r.parent, r.recorded, "n001", False) for r in want.values()], columns=["key", "parent", "recorded", "label", "lost"])
    monkeypatch.setattr(H, "PATH_CHUNK", 5)
    parts = list(H._walk_batches(iter([part[:90], part[90:]])))
    assert len(parts) > 10 and {k: list(p) for q in parts for k, p in zip(q["key"], q["path"])} == {k: list(r.path) for k, r in want.items()}
    for large in (200_000, 5):
        bare = {r.key: r for r in H.hierarchy(rows, large, paths=False).collect()}
        assert all("path" not in bare[k] and (bare[k].depth, bare[k].root, bare[k].state) == (r.depth, r.root, r.state) for k, r in want.items())


@pytest.mark.parametrize(("small", "large"), [(0, 200_000), (60, 3), (100, 200_000)])
def test_whole_circles(spark, monkeypatch, small, large):
    """Circles of any length, with tails, keep one label whenever the doubling ends."""
    monkeypatch.setattr(H, "SMALL", small)
    rows = [(f"chain{i:03}", f"chain{i - 1:03}" if i else None) for i in range(40)]
    for n in (1, 2, 3, 4, 5, 6, 8, 12):
        rows += [(f"{'zyxw'[i % 4]}{n:02}-{i:02}", f"{'zyxw'[(i + 1) % n % 4]}{n:02}-{(i + 1) % n:02}") for i in range(n)]
        rows += [(f"a{n:02}-{i:02}", f"a{n:02}-{i - 1:02}" if i else f"z{n:02}-00") for i in range(7)]
    found = {r.key: r for r in H.hierarchy(spark.createDataFrame([(k, p, 0) for k, p in rows], SCHEMA), large, paths=False).collect()}
    assert {k: (r.state, r.depth, r.root) for k, r in found.items()} == brute(rows)
