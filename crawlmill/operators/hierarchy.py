"""Problem 3: parent-child rows to full hierarchies, with cycle detection.

Every node has at most one parent. Components are found by pointer doubling, whose number of rounds is the
logarithm of the longest chain; each component is then moved to one place and walked depth first with node
colouring. A component too large for one place (more than ``LARGE`` rows) is not moved: its results, which are the
same, come from doubling alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlmill.operators.scale import join_classes
from crawlmill.session import checkpointed

LARGE = 200_000
OUT = "key string, parent string, recorded long, root string, depth long, path array<string>, n_descendants long, state string, lost boolean, root_lost boolean"
OUT_PLAIN = "key string, parent string, recorded long, root string, depth long, state string, lost boolean, root_lost boolean"
SMALL = 200_000  # chains one task finishes
PATH_CHUNK = 2_000_000  # path steps held before rows are handed on


def _advance(active: DataFrame, state: DataFrame, payload: list[str]) -> DataFrame:
    """Rows of ``active`` with the state of the node their ``next`` names; hot targets are spread."""
    sizes = active.groupBy("next").agg(F.count(F.lit(1)).alias("__n"))
    targets = state.select(F.col("key").alias("next"), *[F.col(c).alias(f"t_{c}") for c in payload]).join(sizes, "next")
    return join_classes(active, targets, ["next"], "__n", [f"t_{c}" for c in payload], F.col("key"))


def _labelled(nodes: DataFrame) -> tuple[DataFrame, int]:
    """Component of each node: ``key, parent, recorded, lost, label, cyclic`` and the number of nodes.

    ``label`` is the root, or the smallest node of the circle a chain runs into; ``cyclic`` says which. After r rounds
    ``next`` is 2^r steps ahead and ``low`` the smallest of the 2^r nodes before it. The jumps from a node of a circle
    may meet only some of its nodes, but the stretches between them cover it, so their smallest ``low`` names it.
    """
    loop = F.coalesce(F.col("parent") == F.col("key"), F.lit(False))
    state = nodes.select("key", F.when(~loop, F.col("parent")).alias("next"), loop.alias("cyclic"), F.col("key").alias("low"))
    state = checkpointed(state.select("*", F.when(F.col("next").isNull(), F.col("key")).alias("label")))
    total = state.count()
    rounds, before, circles = 0, -1, False
    while True:
        active = state.filter("label is null")
        left = active.count()
        # A chain with an end has a node at each distance, so every round labels some of its nodes: when a round labels
        # none, all that is left runs in circles. After as many steps as rows left each of them stands on its circle.
        circles = circles or left == before
        if left <= SMALL or (circles and 2**rounds > left):
            break
        before = left
        ahead = active if circles else state
        moved = _advance(active.select("key", "next", "low"), ahead, ["next", "cyclic", "low", "label"]).select(
            "key", F.col("t_next").alias("next"), F.col("t_cyclic").alias("cyclic"), F.least("low", "t_low").alias("low"), F.col("t_label").alias("label")
        )
        done = state.filter("label is not null").select("key", "next", "cyclic", "low", "label")
        state = checkpointed(done.unionByName(moved))
        rounds += 1
    if left:
        if left <= SMALL:
            rest = _finish(state, active)
        else:  # ``next`` stands on the circle, and its ``low`` has passed all of it
            rest = _advance(active.select("key", "next"), active, ["low"]).select("key", F.col("t_low").alias("label"), F.lit(True).alias("cyclic"))
        state = state.filter("label is not null").select("key", "label", "cyclic").unionByName(rest.select("key", "label", "cyclic"))
    return nodes.join(state.select("key", "label", "cyclic"), "key"), total


def _finish(state: DataFrame, active: DataFrame) -> DataFrame:
    """Labels of the last chains, at most ``SMALL`` rows, in one task: their ends are known or a circle."""
    known = state.filter("label is not null").join(active.select(F.col("next").alias("key")).distinct(), "key", "left_semi")
    both = active.select("key", "next", "low", "label", "cyclic").unionByName(known.select("key", "next", "low", "label", "cyclic"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        label = {k: (v, bool(c)) for k, v, c in zip(rows["key"], rows["label"], rows["cyclic"]) if v is not None}
        ahead = {k: n for k, n, v in zip(rows["key"], rows["next"], rows["label"]) if v is None}
        low = dict(zip(rows["key"], rows["low"]))
        for start in ahead:
            trail, at = [], start
            place: dict[str, int] = {}
            while at not in label and at not in place:
                place[at] = len(trail)
                trail.append(at)
                at = ahead[at]
            if at in label:
                end = label[at]
            else:
                end = (min(low[v] for v in trail[place[at] :]), True)
            for v in trail:
                label[v] = end
        keys = list(ahead)
        return pd.DataFrame({"key": keys, "label": [label[k][0] for k in keys], "cyclic": [label[k][1] for k in keys]})

    return both.withColumn("all_rows", F.lit(1)).groupBy("all_rows").applyInPandas(run, "key string, label string, cyclic boolean")


def _walk(rows: pd.DataFrame, paths: bool) -> Iterator[pd.DataFrame]:
    """Depth-first walk of whole components: colours white, grey, black; back edges close circles.

    Paths are written out when rows are handed on, in parts, so deep components need no memory for them.
    """
    keys = rows["key"].tolist()
    parents = rows["parent"].tolist()
    at = {k: i for i, k in enumerate(keys)}
    up = [at.get(p, -1) if p is not None else -1 for p in parents]
    children: list[list[int]] = [[] for _ in keys]
    for i, p in enumerate(up):
        if p >= 0:
            children[p].append(i)
    white, grey, black = 0, 1, 2
    colour = [white] * len(keys)
    on_circle = [False] * len(keys)
    for i in range(len(keys)):  # follow parents; a grey node met again closes a circle
        trail, v = [], i
        while v >= 0 and colour[v] == white:
            colour[v] = grey
            trail.append(v)
            v = up[v]
        if v >= 0 and colour[v] == grey:
            w = v
            while not on_circle[w]:
                on_circle[w] = True
                w = up[w]
        for w in trail:
            colour[w] = black
    labels = rows["label"].tolist()
    lost = rows["lost"].tolist()
    gone = [False] * len(keys)
    depth, below, root, state = [0] * len(keys), [0] * len(keys), [None] * len(keys), ["tree"] * len(keys)
    for start in range(len(keys)):
        if up[start] >= 0 and not on_circle[start]:
            continue
        stack = [start]
        root[start] = labels[start] if on_circle[start] else keys[start]
        state[start] = "cycle" if on_circle[start] else "tree"
        inner = "below_cycle" if on_circle[start] else "tree"
        order = []
        while stack:
            v = stack.pop()
            order.append(v)
            gone[v] = lost[start]
            for c in children[v]:
                if not on_circle[c]:
                    depth[c], root[c], state[c] = depth[v] + 1, root[start], inner
                    stack.append(c)
        for v in reversed(order[1:]):
            below[up[v]] += below[v] + 1
    recorded = rows["recorded"].astype("Int64")
    first = 0
    while first < len(keys):
        last, steps = first, 0
        while last < len(keys) and steps <= PATH_CHUNK:
            steps += depth[last] + 1 if paths else 1
            last += 1
        path: list[list[str] | None] = [None] * (last - first)
        for i in range(first, last) if paths else ():
            trail, v = [keys[i]], i
            for _ in range(depth[i]):
                v = up[v]
                trail.append(keys[v])
            trail.reverse()
            path[i - first] = trail
        cut = slice(first, last)
        more = {"path": path, "n_descendants": below[cut]} if paths else {}
        yield pd.DataFrame({"key": keys[cut], "parent": parents[cut], "recorded": recorded[cut].array, "root": root[cut], "depth": depth[cut], **more, "state": state[cut], "lost": lost[cut], "root_lost": gone[cut]})
        first = last


def _walk_batches(batches: Iterator[pd.DataFrame], paths: bool = True) -> Iterator[pd.DataFrame]:
    """Rows come sorted by component; a component is walked once its last row is here."""
    held: list[pd.DataFrame] = []
    for part in batches:
        if not len(part):
            continue
        last = part["label"].iloc[-1]
        tail = part["label"] == last
        if tail.all() and held and held[-1]["label"].iloc[-1] == last:
            held.append(part)
            continue
        whole = pd.concat([*held, part[~tail]]) if held else part[~tail]
        cut = whole["label"] == last
        if len(whole) and cut.any():
            held, whole = [whole[cut], part[tail]], whole[~cut]
        else:
            held = [part[tail]]
        if len(whole):
            yield from _walk(whole.reset_index(drop=True), paths)
    if held:
        yield from _walk(pd.concat(held).reset_index(drop=True), paths)


def _large(rows: DataFrame, paths: bool) -> DataFrame:
    """Results of components that are never moved to one place: steps by doubling, counts by aggregation."""
    inner = F.when((F.col("parent") != F.col("key")) & ~F.col("on_circle"), F.col("parent"))
    state = rows.select("key", inner.alias("next"), F.when(inner.isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.col("lost").alias("root_lost"))
    state = checkpointed(state.withColumn("path", F.array("key")) if paths else state)
    carried = ["next", "depth", "root_lost", *(["path"] if paths else [])]
    while not state.filter("next is not null").isEmpty():
        moved = _advance(state.filter("next is not null").drop("root_lost"), state, carried)
        further = [F.concat("t_path", "path").alias("path")] if paths else []
        moved = moved.select("key", F.col("t_next").alias("next"), (F.col("depth") + F.col("t_depth")).alias("depth"), F.col("t_root_lost").alias("root_lost"), *further)
        state = checkpointed(state.filter("next is null").unionByName(moved))
    out = rows.join(state.drop("next"), "key")
    kind = F.when(F.col("on_circle"), "cycle").when(F.col("cyclic"), "below_cycle").otherwise("tree")
    if not paths:
        return out.select("key", "parent", "recorded", F.col("label").alias("root"), "depth", kind.alias("state"), "lost", "root_lost")
    counts = state.select(F.explode(F.slice("path", 1, F.size("path") - 1)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    root = F.when(F.col("cyclic"), F.col("label")).otherwise(F.col("path")[0])
    return out.join(counts, "key", "left").select(
        "key", "parent", "recorded", root.alias("root"), "depth", "path", F.coalesce("n", F.lit(0)).alias("n_descendants"), kind.alias("state"), "lost", "root_lost"
    )


def hierarchy(nodes: DataFrame, large: int = LARGE, paths: bool = True) -> DataFrame:
    """Full hierarchy of ``nodes`` (``key string, parent string, recorded long``, one row per key).

    Returns for each node its ``root``, ``depth`` (steps to the end of its chain of parents), ``path`` from the
    root, ``n_descendants``, and ``state``: ``tree``, ``cycle`` (on a circle; a node that is its own parent
    included) or ``below_cycle``. On a circle the root is its smallest node, paths and depths start at the
    circle. A parent that has no row is kept as a node with ``lost`` true, so a chain that ends there has a
    ``lost`` root. Of rows with the same key the smallest counts; rows with a null key are dropped. All
    descendants of a node are the rows whose path holds it (``descendants``). Without ``paths`` there are no columns
    ``path`` and ``n_descendants``. An empty table gives no rows. The result is the same for every ``large``.
    """
    own = nodes.filter("key is not null").groupBy("key").agg(F.min(F.struct("parent", "recorded")).alias("r"))
    own = own.select("key", "r.parent", "r.recorded", F.lit(False).alias("lost"))
    named = own.select(F.col("parent").alias("key")).filter("key is not null").distinct()
    gone = named.join(own.select("key"), "key", "left_anti").select("key", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("recorded"), F.lit(True).alias("lost"))
    every = checkpointed(own.unionByName(gone))
    labelled, total = _labelled(every)
    labelled = checkpointed(labelled)
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    some = not sizes.filter(F.col("members") > large).isEmpty()
    rest = labelled
    if some:  # the labels of large components spread over the tasks
        sized = checkpointed(join_classes(labelled, sizes, ["label"], "members", ["members"], F.col("key")))
        rest, giants = sized.filter(F.col("members") <= large), sized.filter(F.col("members") > large).drop("members")
    parts = max(1, min(4096, total // 20_000 + rest.sparkSession.sparkContext.defaultParallelism))
    walked = rest.select("key", "parent", "recorded", "label", "lost").repartition(parts, "label").sortWithinPartitions("label")
    walked = walked.mapInPandas(lambda batches: _walk_batches(batches, paths), OUT if paths else OUT_PLAIN)
    return walked.unionByName(_large(_mark_circles(giants), paths)) if some else walked


def _mark_circles(rows: DataFrame) -> DataFrame:
    """Nodes of large components that stand on a circle: those still reached after more steps than rows."""
    nodes = rows.filter("cyclic").select("key", F.col("parent").alias("next"))
    reach, steps, size = checkpointed(nodes), 1, rows.filter("cyclic").count()
    while steps < size:
        reach = checkpointed(_advance(reach, reach, ["next"]).select("key", F.col("t_next").alias("next")))
        steps *= 2
    on = reach.select(F.col("next").alias("key")).distinct().withColumn("on_circle", F.lit(True))
    return rows.join(on, "key", "left").withColumn("on_circle", F.coalesce("on_circle", F.lit(False)))


def descendants(found: DataFrame) -> DataFrame:
    """Pairs ``ancestor, descendant`` of all trees, one row each; nothing is gathered per ancestor.

    A node on a circle has those below it that are reached without passing another node of the circle; the
    circle itself is named by ``root``.
    """
    return found.filter("depth > 0").select(F.explode(F.slice("path", 1, F.size("path") - 1)).alias("ancestor"), F.col("key").alias("descendant"))
