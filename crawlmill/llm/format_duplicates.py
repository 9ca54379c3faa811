"""Problem 2: records that differ only in whitespace, letter case, punctuation or the order of two fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill.operators.scale import join_classes
from crawlmill.session import checkpointed


def stripped(field: str) -> Column:
    """Lower-cased field without any character that is not a letter, mark or digit; null becomes empty."""
    return F.regexp_replace(F.lower(F.coalesce(F.col(field), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", "")


def _classes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Classes with more than one record: key, smallest id, number of rows. Combined before the shuffle."""
    sizes = rows.groupBy(*keys).agg(F.min("__id").alias("__first"), F.max("__id").alias("__last"), F.count(F.lit(1)).alias("__n"))
    return sizes.filter(F.col("__first") < F.col("__last")).drop("__last")


def duplicate_members(df: DataFrame, scope: str, id_column: str, first: str, second: str) -> DataFrame:
    """Members of groups of equal records: ``scope``, ``first_id``, ``member_id``.

    Partitions are refined step by step. All rows are grouped by a cheap invariant, the lengths of both
    stripped fields; only rows of classes with several records get the next key, the letter histogram of both
    fields; only rows of its classes with several records get the costly key, a 128-bit digest of both texts in
    an order that does not depend on which field holds which. Every refinement is a pre-aggregated grouping
    and a join in which large classes are spread.

    Nulls count as empty; records whose two fields are both empty form no group. A row delivered twice (same
    id) counts once. A null scope or id drops the row. An empty table gives no rows.
    """
    a, b = stripped(first), stripped(second)
    rows = (
        df.select(F.col(scope).alias("__scope"), F.col(id_column).alias("__id"), a.alias("__a"), b.alias("__b"))
        .filter(F.col("__scope").isNotNull() & F.col("__id").isNotNull() & ((F.col("__a") != "") | (F.col("__b") != "")))
        .select("__scope", "__id", F.least("__a", "__b").alias("__a"), F.greatest("__a", "__b").alias("__b"))
        .select("*", F.length("__a").alias("__la"), F.length("__b").alias("__lb"))
    )
    lengths = ["__scope", "__la", "__lb"]
    by_length = join_classes(rows, _classes(rows.select(*lengths, "__id"), lengths), lengths, "__n", [], F.col("__id"))

    letters = F.array_sort(F.split(F.concat("__a", "__b"), ""))
    by_length = checkpointed(by_length.select("*", F.xxhash64(F.array_join(letters, "")).alias("__letters")))
    histogram = [*lengths, "__letters"]
    by_letters = join_classes(by_length, _classes(by_length.select(*histogram, "__id"), histogram), histogram, "__n", [], F.col("__id"))

    digest = F.md5(F.concat_ws("\x00", "__a", "__b"))
    by_letters = checkpointed(by_letters.select("__scope", "__id", digest.alias("__text")))
    exact = ["__scope", "__text"]
    members = join_classes(by_letters, _classes(by_letters, exact), exact, "__n", ["__first"], F.col("__id"))
    return members.select(F.col("__scope").alias(scope), F.col("__first").alias("first_id"), F.col("__id").alias("member_id")).distinct()


def collapse(df: DataFrame, scope: str, id_column: str, first: str, second: str) -> DataFrame:
    """One record per group of equal records with its number of copies: ``scope``, ``first_id``, ``copies``.

    Records without an equal one are not listed (their number of copies is 1).
    """
    return duplicate_members(df, scope, id_column, first, second).groupBy(scope, "first_id").agg(F.count(F.lit(1)).alias("copies"))
