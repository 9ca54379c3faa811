"""Near duplicates by SimHash: Hamming distance up to three.

Candidates meet on three of six bands, 32 bits, which two signatures that differ in at most three bits must share;
which match counts is told by pairs of five bands.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill.session import checkpointed

MASK = 8191
PAIRS = tuple(itertools.combinations(range(5), 2))
WIDTHS = (11, 11, 11, 11, 10, 10)
TRIPLES = tuple(itertools.combinations(range(6), 3))


def _band(sig: Column, n: int) -> Column:
    shifted = F.shiftrightunsigned(sig, 13 * n) if n else sig
    return shifted.bitwiseAND(F.lit(MASK)) if n < 4 else shifted


def _key(sig: Column, triple: tuple[int, ...]) -> Column:
    """Three bands of a signature in one number."""
    out = F.lit(0).cast("long")
    for n in triple:
        part = F.shiftrightunsigned(sig, sum(WIDTHS[:n])).bitwiseAND(F.lit((1 << WIDTHS[n]) - 1).cast("long"))
        out = F.shiftleft(out, WIDTHS[n]).bitwiseOR(part)
    return out


def near_duplicates(rows: DataFrame, distance: int = 3) -> DataFrame:
    """Each document's earlier near duplicate: ``id, match_id, distance`` for signatures ``id, sig`` (long).

    Two signatures that differ in at most three bits share at least three of six bands, so every pair of them
    meets in one of twenty triples. Of the earlier documents within ``distance`` the one with the first equal pair
    of five bands counts, then the smallest. Equal signatures are joined once per distinct value: the first of
    them takes the result of the join, the others it, or the first one. Null signatures have no match.
    ``distance`` 0 turns the search off.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance between 0 and 3")
    known = checkpointed(rows.filter("sig is not null and id is not null").select("id", "sig").distinct())  # used five times
    first = known.groupBy("sig").agg(F.min("id").alias("id"))
    keys = F.array(*[F.struct(F.lit(t).alias("t"), _key(F.col("sig"), triple).alias("bits")) for t, triple in enumerate(TRIPLES)])
    spread = first.select("id", "sig", F.explode(keys).alias("k")).select("id", "sig", "k.*")
    earlier = spread.select(F.col("id").alias("match_id"), F.col("sig").alias("other"), "t", "bits")
    differs = F.col("sig").bitwiseXOR(F.col("other"))
    gap = F.bit_count(differs)
    pair = F.coalesce(*[F.when((_band(differs, a) == 0) & (_band(differs, b) == 0), p) for p, (a, b) in enumerate(PAIRS)])
    close = spread.join(earlier, ["t", "bits"]).filter((F.col("match_id") < F.col("id")) & (gap <= distance))
    met = close.select("id", "sig", F.struct(pair.alias("p"), "match_id", gap.alias("distance")).alias("m"))
    best = met.groupBy("sig").agg(F.min("m").alias("m"))
    found = known.join(first.select("sig", F.col("id").alias("first_id")), "sig").join(best, "sig", "left")
    same = F.struct(F.lit(0).alias("p"), F.col("first_id").alias("match_id"), F.lit(0).alias("distance"))
    pick = F.when(F.col("id") == F.col("first_id"), F.col("m")).when(F.col("m.p") == 0, F.col("m")).otherwise(same)
    out = found.select("id", pick.alias("m")).filter("m is not null").select("id", "m.match_id", "m.distance")
    return out if distance else out.limit(0)
