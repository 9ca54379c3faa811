"""Problem 6: what changed between consecutive full snapshots.

Keys map to persistent ordinals: a block number from the key's hash and a position in the block. Within a block
a snapshot is a compressed bitmap over the positions plus one column vector per watched field, aligned by
ordinal. AND-NOT of two bitmaps gives additions and removals; comparing the vectors under the AND of both
bitmaps gives the changes. ``assign_ordinals`` returns the table of ordinals, which a later run takes up and
extends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 20_000
CHANGES = ("added", "removed", "changed")
CONTAINER, FEW = 1 << 16, 4096  # positions of a container, and up to how many it lists them one by one


def block_of(scope: str, key: str, blocks: int) -> Column:
    """Block of a key: the same for a key in every run with the same number of blocks."""
    return F.pmod(F.xxhash64(scope, key), F.lit(blocks))


def blocks_for(rows: DataFrame) -> int:
    """Number of blocks that keeps a block of ``rows`` small; a table of ordinals keeps the number it began with."""
    return max(rows.sparkSession.sparkContext.defaultParallelism * 2, rows.count() // ROWS_PER_BLOCK)


def _placed(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """``rows`` with ``__scope, __key, __block`` and their ``__position``: that of ``known``, or a new one behind."""
    order = Window.partitionBy("__block").orderBy("__scope", "__key")
    if known is None:
        return rows.withColumn("__position", F.dense_rank().over(order).cast("long") - 1)
    own = ["__block", "__scope", "__key"]
    listed = rows.join(known.select(*own, F.col("position").alias("__old")), own, "left")
    top = known.groupBy("__block").agg((F.max("position") + 1).alias("__from"))
    fresh = F.dense_rank().over(Window.partitionBy("__block", F.col("__old").isNull()).orderBy("__scope", "__key")).cast("long") - 1
    listed = listed.join(top, "__block", "left").withColumn("__position", F.coalesce("__old", fresh + F.coalesce("__from", F.lit(0))))
    return listed.drop("__old", "__from")


def assign_ordinals(keys: DataFrame, scope: str, key: str, blocks: int, known: DataFrame | None = None) -> DataFrame:
    """Persistent ordinals ``scope, key, block, position``.

    Keys listed in ``known`` (an earlier result with the same ``blocks``) keep their position; others follow
    behind the block's highest one, in key order. Numbering runs per block, so no task holds more than a block.
    Null scopes and keys have none.
    """
    names = {scope: "__scope", key: "__key"}
    own = keys.select(scope, key).filter(F.col(scope).isNotNull() & F.col(key).isNotNull()).withColumn("__block", block_of(scope, key, blocks)).withColumnsRenamed(names)
    old = None if known is None else known.withColumnsRenamed({**names, "block": "__block"})
    new = _placed(own.distinct(), old).select("__scope", "__key", "__block", F.col("__position").alias("position"))
    if old is not None:
        new = old.select(*new.columns).unionByName(new.join(old.select("__scope", "__key"), ["__scope", "__key"], "left_anti"))
    return new.select(F.col("__scope").alias(scope), F.col("__key").alias(key), F.col("__block").alias("block"), "position")


class Bitmap:
    """Compressed set of positions: containers of 65536, each a sorted list if it holds few, else packed bits."""

    def __init__(self, containers: dict[int, np.ndarray]) -> None:
        self.containers = containers

    @classmethod
    def of(cls, positions: np.ndarray) -> Bitmap:
        """From distinct positions in any order."""
        positions = np.sort(positions)
        high = positions // CONTAINER
        cuts = np.flatnonzero(np.diff(high)) + 1
        return cls({int(part[0] // CONTAINER): _packed((part % CONTAINER).astype(np.uint16)) for part in np.split(positions, cuts) if len(part)})

    def combine(self, other: Bitmap, keep_common: bool) -> Bitmap:
        """AND, or AND-NOT where ``keep_common`` is false; containers the other lacks are taken or left whole."""
        out = {}
        for number, mine in self.containers.items():
            theirs = other.containers.get(number)
            if theirs is None:
                if not keep_common:
                    out[number] = mine
                continue
            if mine.dtype == theirs.dtype == np.uint8:
                low = _unpacked(mine & theirs if keep_common else mine & ~theirs)
            else:
                a = _unpacked(mine)
                low = a[np.isin(a, _unpacked(theirs), assume_unique=True, invert=not keep_common)]
            if len(low):
                out[number] = _packed(low)
        return Bitmap(out)

    def positions(self) -> np.ndarray:
        """The positions, ascending."""
        parts = [_unpacked(c).astype(np.int64) + n * CONTAINER for n, c in sorted(self.containers.items())]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _packed(low: np.ndarray) -> np.ndarray:
    if len(low) <= FEW:
        return low
    bits = np.zeros(CONTAINER, bool)
    bits[low] = True
    return np.packbits(bits)


def _unpacked(container: np.ndarray) -> np.ndarray:
    return container if container.dtype == np.uint16 else np.flatnonzero(np.unpackbits(container)).astype(np.uint16)


def _compare(rows: pd.DataFrame, watched: list[str]) -> Iterator[tuple[int, np.ndarray, int]]:
    """For each snapshot of a scope but the first: snapshot, positions, change."""
    size = int(rows["__position"].max()) + 1
    first, last = int(rows["__first"].iloc[0]), int(rows["__last"].iloc[0])
    by_snapshot = dict(tuple(rows.groupby("__snapshot", sort=True)))
    bitmap, vectors = Bitmap({}), [np.zeros(size, np.int64) for _ in watched]
    for snapshot in range(first, last + 1):
        now = by_snapshot.get(snapshot)
        at = now["__position"].to_numpy(np.int64) if now is not None else np.zeros(0, np.int64)
        there = Bitmap.of(at)
        if snapshot > first:
            yield snapshot, there.combine(bitmap, False).positions(), 0
            yield snapshot, bitmap.combine(there, False).positions(), 1
        common = there.combine(bitmap, True).positions() if snapshot > first else np.zeros(0, np.int64)
        differs = np.zeros(len(common), bool)
        for vector, name in zip(vectors, watched):
            old = vector[common]
            if now is not None:
                vector[at] = now[name].to_numpy(np.int64)
            differs |= old != vector[common]
        if snapshot > first:
            yield snapshot, common[differs], 2
        bitmap = there


def snapshot_changes(
    rows: DataFrame, scope: str, snapshot: str, key: str, watched: dict[str, Column], latest: list[str], bounds: DataFrame, blocks: int | None = None, ordinals: DataFrame | None = None
) -> DataFrame:
    """Keys added, removed or changed from one snapshot to the next: ``scope, snapshot, key, change_kind``.

    ``snapshot`` is a running number within ``scope``; ``bounds`` (``scope, first, last``, one row per scope)
    lists which snapshots exist, so that one without rows removes everything. Of several rows of a key in a
    snapshot the one highest by ``latest`` counts. ``watched`` gives the compared fields; each is held as a
    64-bit digest in a vector. Rows with a null scope, snapshot or key are dropped; repeated rows count once.
    ``ordinals`` is the table an earlier run kept (``assign_ordinals`` with the same ``blocks``); its positions are
    used, and keys it lacks get the positions ``assign_ordinals`` would add.

    Keys are spread by the hash of scope and key, so a scope with a third of all rows is as balanced as the
    others: rows are moved once, and picking, numbering and comparing happen where their block is. An empty table
    gives no rows.
    """
    digests = {f"__w{i}": F.xxhash64(c) for i, c in enumerate(watched.values())}
    blocks = blocks or blocks_for(rows)
    own = rows.filter(F.col(scope).isNotNull() & F.col(snapshot).isNotNull() & F.col(key).isNotNull())
    own = own.select(
        F.col(scope).alias("__scope"), F.col(snapshot).alias("__snapshot"), F.col(key).alias("__key"), *[F.col(c).alias(f"__l{i}") for i, c in enumerate(latest)],
        *[d.alias(n) for n, d in digests.items()],
    ).withColumn("__block", block_of("__scope", "__key", blocks))
    named = ["__block", "__scope", "__snapshot", "__key"]
    order = Window.partitionBy(*named).orderBy(*[F.desc(f"__l{i}") for i in range(len(latest))])
    picked = own.repartition("__block").withColumn("__n", F.row_number().over(order)).filter("__n = 1").select(*named, *digests)
    old = None if ordinals is None else ordinals.select(F.col(scope).alias("__scope"), F.col(key).alias("__key"), F.col("block").alias("__block"), "position")
    placed = _placed(picked, old)
    ends = bounds.select(F.col(scope).alias("__scope"), F.col("first").alias("__first"), F.col("last").alias("__last"))
    placed = placed.join(ends, "__scope")
    names = list(digests)

    def run(_: tuple, block: pd.DataFrame) -> pd.DataFrame:
        """One block: bitmaps and vectors of each scope over the block's ordinals."""
        text, scopes, at = block["__key"].to_numpy(), block["__scope"].to_numpy(), block["__position"].to_numpy(np.int64)
        row_of = np.zeros(int(at.max()) + 1, np.int64)
        row_of[at] = np.arange(len(block))
        out = [(s, p, c) for _, part in block.groupby("__scope", sort=False) for s, p, c in _compare(part, names) if len(p)]
        if not out:
            return pd.DataFrame({scope: [], snapshot: [], key: [], "change_kind": []})
        rows_at = row_of[np.concatenate([p for _, p, _ in out])]
        return pd.DataFrame(
            {
                scope: scopes[rows_at], snapshot: np.concatenate([np.full(len(p), s) for s, p, _ in out]), key: text[rows_at],
                "change_kind": np.concatenate([np.full(len(p), CHANGES[c], object) for _, p, c in out]),
            }
        )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return placed.groupBy("__block").applyInPandas(run, f"`{scope}` {kinds[scope]}, `{snapshot}` long, `{key}` {kinds[key]}, change_kind string")
