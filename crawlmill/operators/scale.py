"""Joins and groupings that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill.session import checkpointed

HOT_CLASSES = 1000  # rows of a broadcast list of the largest classes: its proven size bound
SALTS = 64
SMALL_BYTES = 8_000_000


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, payload: list[str], spread_by: Column, measure: bool = False) -> DataFrame:
    """Inner join of many ``rows`` to one row per class, without a hot class landing in one task.

    The ``HOT_CLASSES`` largest classes by column ``size`` are broadcast (at most that many rows, whatever the
    data), so a class outside that list holds at most 1/1000 of all rows. Rows of hot classes take their
    payload from the broadcast and carry a salt from ``spread_by`` (deterministic, so a repeated task gives the
    same rows) that spreads them evenly over the tasks of the second join, which serves the other classes.
    ``keys`` must not be null. Rows without a class are dropped; repeated rows stay repeated. Where few classes may
    be left, ``measure`` writes them down and measures them first: if they are no larger than ``SMALL_BYTES`` all of
    them are broadcast, and the rows are not moved.
    """
    if measure:
        classes = checkpointed(classes.select(*keys, *{size, *payload}))
        length = sum((F.octet_length(F.col(k).cast("string")) for k in keys), F.lit(16 + 16 * len(payload)))
        if (classes.agg(F.sum(length)).first()[0] or 0) <= SMALL_BYTES:
            return rows.join(F.broadcast(classes.select(*keys, *payload)), keys).select(*rows.columns, *payload)
    hot = classes.orderBy(F.desc(size), *keys).limit(HOT_CLASSES)
    hot = hot.select(*keys, *[F.col(c).alias(f"__hot_{c}") for c in payload], F.lit(True).alias("__hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    salted = marked.withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread_by), F.lit(SALTS)) + 1).otherwise(F.lit(0)))
    cold = classes.select(*keys, *[F.col(c).alias(f"__cold_{c}") for c in payload], F.lit(0).cast("long").alias("__salt"), F.lit(True).alias("__cold"))
    joined = salted.withColumn("__salt", F.col("__salt").cast("long")).join(cold, [*keys, "__salt"], "left")
    kept = joined.filter(F.col("__hot") | F.col("__cold"))
    return kept.select(*rows.columns, *[F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in payload])


def ranged(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` cut into ranges by key and order, with the range's number in ``__part``.

    Ranges are of like size whatever the keys, so a window over (key, ``__part``) never gathers a hot key in one
    task. The cut is kept, since ranges chosen anew might differ.
    """
    return checkpointed(rows.repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id()))


def join_parts(parts: DataFrame, figures: DataFrame, key: str) -> DataFrame:
    """Rows of ``ranged`` with the figures of their key and range; null keys meet each other."""
    of = figures.withColumnsRenamed({key: "__key", "__part": "__of"})
    return parts.join(of, parts[key].eqNullSafe(of["__key"]) & (parts["__part"] == of["__of"])).drop("__key", "__of")
