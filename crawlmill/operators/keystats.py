"""Problem 5: per-key figures when a few keys own most rows, with dense accumulator arrays.

Each equal input split dictionary-encodes its keys and adds into dense arrays with ``bincount``. The key space
is cut into blocks by hash; a split sends, for each block it touched, the block's sorted keys with their arrays.
Blocks are summed by scatter-reduce: the dictionaries are merged and every array is added at the merged codes.
A key reaches the reduction at most once per split however many rows it owns, so no task is longer than others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill.sources.tables import spread

ENTRIES_PER_BLOCK = 200_000  # entries all splits send to a block, at most; large, so that a split's arrays stay long


def partial_arrays(df: DataFrame, key: str, flags: list[str], blocks: int) -> DataFrame:
    """First step: ``block, keys, sums`` of each split; ``sums`` holds one dense array per figure, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[pa.Array] = []
        sums: list[np.ndarray] = []
        for part in batches:  # one dictionary and one set of arrays per batch, merged at the end of the split
            column = part.column(0)
            encoded = column.dictionary_encode()
            codes = encoded.indices
            keep = codes.is_valid().to_numpy(zero_copy_only=False)
            at = codes.drop_null().to_numpy(zero_copy_only=False)
            size = len(encoded.dictionary)
            if not size:
                continue
            arrays = [np.bincount(at, minlength=size)]
            for i in range(1, 1 + len(flags)):
                weights = part.column(i).to_numpy(zero_copy_only=False)[keep]
                arrays.append(np.bincount(at, weights=weights, minlength=size).astype(np.int64))
            names.append(encoded.dictionary)
            sums.append(np.vstack(arrays))
        if not names:
            return
        every = pa.concat_arrays([x.cast(pa.large_string()) for x in names]).dictionary_encode()
        merged = _scatter(every.indices.to_numpy(), np.hstack(sums), len(every.dictionary))
        block = pd.util.hash_array(every.dictionary.to_numpy(zero_copy_only=False), hash_key="crawlmill-blocks") % np.uint64(blocks)
        order = np.argsort(block, kind="stable")
        edges = np.flatnonzero(np.diff(block[order])) + 1
        dictionary = every.dictionary.cast(pa.string())
        for at in np.split(order, edges):
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(block[at[0]])], pa.int64()), pa.array([dictionary.take(pa.array(at)).to_pylist()], pa.list_(pa.string())), pa.array([merged[:, at].ravel()], pa.list_(pa.int64()))],
                names=["block", "keys", "sums"],
            )

    return df.select(key, *[F.col(f).cast("double") for f in flags]).mapInArrow(run, "block long, keys array<string>, sums array<long>")


def _scatter(codes: np.ndarray, arrays: np.ndarray, size: int) -> np.ndarray:
    """Add each array at its codes into dense arrays of ``size``."""
    return np.vstack([np.bincount(codes, weights=row, minlength=size) for row in arrays]).astype(np.int64)


def dense_sums(df: DataFrame, key: str, flags: dict[str, str], size: int | None = None) -> DataFrame:
    """Per key: ``key_value``, ``rows`` and one sum for each name in ``flags`` (a column of 0 and 1, or counts).

    Nulls of ``key`` have no result row; a null flag counts as 0. Sums are exact below 2**53. An empty table
    gives no rows. The number of blocks follows the number of rows, so a block's arrays stay bounded; ``size``, an
    upper bound of that number, saves counting them.
    """
    names = list(flags)
    rows = df.filter(F.col(key).isNotNull()).select(key, *[F.coalesce(F.col(flags[n]), F.lit(0)).alias(n) for n in names])
    rows = spread(rows)
    blocks = max(16, (rows.count() if size is None else size) // ENTRIES_PER_BLOCK)
    partial = partial_arrays(rows, key, names, blocks)
    figures = 1 + len(names)

    def reduce(keys: tuple, parts: pa.Table) -> pa.Table:
        sizes = pc.list_value_length(parts["keys"]).to_numpy()
        every = parts["keys"].combine_chunks().flatten()
        every = (every.combine_chunks() if isinstance(every, pa.ChunkedArray) else every).dictionary_encode()
        codes = every.indices.to_numpy()
        flat = parts["sums"].combine_chunks().flatten()
        flat = (flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).to_numpy()
        arrays, at = np.empty((figures, len(codes)), np.int64), np.concatenate([[0], np.cumsum(sizes)])
        for i, n in enumerate(sizes):
            arrays[:, at[i] : at[i + 1]] = flat[at[i] * figures : at[i + 1] * figures].reshape(figures, n)
        total = _scatter(codes, arrays, len(every.dictionary))
        return pa.table({"key_value": every.dictionary, "rows": total[0], **{n: total[i + 1] for i, n in enumerate(names)}})

    schema = "key_value string, rows long" + "".join(f", {n} long" for n in names)
    return partial.groupBy("block").applyInArrow(reduce, schema)


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Non-null values of ``key`` on at least ``share`` of all rows (rows with a null key count in the whole)."""
    least = math.ceil(df.count() * share - 1e-6)  # a whole number, so a share exactly met isn't lost to rounding
    return dense_sums(df, key, {}).filter(F.col("rows") >= F.lit(max(1, least))).select(F.lit(key).alias("key_field"), "key_value", "rows")


def url_figures(df: DataFrame, ends: dict[str, str], text: str) -> DataFrame:
    """Per key: rows, rows with a non-empty ``text``, distinct partners and distinct non-empty texts.

    ``ends`` names the key columns, each with the column of its partners; the result has ``key_field, key_value``
    and the figures. One scan serves all keys. Distinct values are found by grouping on (key, value), which is
    combined before the shuffle and spreads a hot key over all tasks; only then are they added up per key with
    the dense arrays. Values are told apart by 128 bits of hashes. A null key has no row, a null partner counts as a row only.
    """
    said = F.when(F.col(text) != "", F.col(text))

    def value(side: int, key: str, partner: bool, v: Column) -> Column:
        digests = [F.xxhash64(v).alias("a"), F.xxhash64(F.lit(side + 1), v).alias("b")]
        return F.struct(F.lit(side).alias("side"), F.col(key).alias("k"), F.lit(partner).alias("partner"), v.isNotNull().alias("there"), *digests)

    each = F.array(*[value(i, key, kind, v) for i, (key, partner) in enumerate(ends.items()) for kind, v in ((True, F.col(partner)), (False, said))])
    pairs = df.select(F.inline(each)).filter("k is not null").groupBy("side", "k", "partner", "there", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    partner, there = F.col("partner"), F.col("there")
    sums = {"links": F.when(partner, F.col("n")), "with_text": F.when(~partner & there, F.col("n")), "partners": F.when(partner & there, 1), "texts": F.when(~partner & there, 1)}
    rows = pairs.select(F.concat(F.col("side").cast("string"), F.lit(":"), "k").alias("key"), *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in sums.items()])
    out = dense_sums(rows, "key", {n: n for n in sums}, df.count() * 2 * len(ends))
    field = F.element_at(F.array(*map(F.lit, ends)), F.substring_index("key_value", ":", 1).cast("int") + 1)
    return out.select(field.alias("key_field"), F.expr("substring(key_value, instr(key_value, ':') + 1)").alias("key_value"), *sums)
