"""Problem 9: mixing sources to target shares of tokens, with a cap on repeats.

Documents are counted in tokens of a public tokenizer and summed by cell (source, language, topic). Iterative
proportional fitting rakes the cells' weights to the wanted shares of sources, languages and topics (of the last
two the corpus's own where none are given), every weight at most the source's cap. A document's wanted number of
copies is its cell's weight; whole copies are given to all, the rest by systematic sampling through each source in
order of length. So what a source gets differs from its wanted tokens by little more than its longest document.
"""

from __future__ import annotations

import base64
import csv
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlmill.sources.tables import spread

# Blanks.
BLANK = r"\t-\r \x85\xa0  -     　"
PIECE = re.compile(rf" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
TOPICS_FILE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "topics.csv")
MAX_CELLS = 100_000
ROWS_PER_BUCKET = 10_000


def encoder(path: str | None = None, pattern: str | None = None):  # noqa: ANN201
    """Byte-level BPE from a rank file and the pattern of its pieces; what isn't given is the installed public one's."""
    import tiktoken

    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class TokenCounter:
    """Exact token counts. Byte-level BPE never joins across a blank before a word, so pieces are counted once
    per worker and remembered."""

    def __init__(self, path: str | None = None, pattern: str | None = None) -> None:
        self._encode = encoder(path, pattern).encode_ordinary
        self._known: dict[str, int] = {}

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        total, known = 0, self._known
        for piece in PIECE.findall(text):
            n = known.get(piece)
            if n is None:
                if len(known) > 500_000:
                    known.clear()
                n = known[piece] = len(self._encode(piece))
            total += n
        return total


def topics(path: str = TOPICS_FILE) -> re.Pattern | None:
    """One pattern of all topics in a table of topic and pattern, or None for an empty table."""
    with open(path, encoding="utf-8", newline="") as f:
        listed = [(row["topic"], row["pattern"]) for row in csv.DictReader(f)]
    return re.compile("|".join(f"(?P<{k}>{v})" for k, v in listed)) if listed else None


def topic_of(text: str, pattern: re.Pattern | None) -> str:
    """Topic most of whose words the text holds; the first in case of ties, ``other`` if none."""
    counts = dict.fromkeys(pattern.groupindex, 0) if pattern else {}
    for m in pattern.finditer(text.lower()) if pattern else ():
        counts[m.lastgroup] += 1
    best = max(counts, key=counts.get, default="other")
    return best if counts.get(best) else "other"


def counted(docs: DataFrame, tokenizer: str | None = None, pattern: str | None = None, topics_file: str = TOPICS_FILE) -> DataFrame:
    """``doc_id, source, language, topic, tokens``; a language that is no code of two or three letters becomes ``und``."""
    language = F.lower(F.trim("lang"))
    known = F.coalesce(language.rlike("^[a-z]{2,3}$"), F.lit(False))
    rows = docs.select("doc_id", "source", F.when(known, language).otherwise("und").alias("language"), F.coalesce("text", F.lit("")).alias("text"))
    said = topics(topics_file)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = TokenCounter(tokenizer, pattern)
        for part in batches:
            part["topic"] = [topic_of(t, said) for t in part["text"]]
            part["tokens"] = [count(t) for t in part["text"]]
            yield part[["doc_id", "source", "language", "topic", "tokens"]]

    return spread(rows).mapInPandas(run, "doc_id long, source string, language string, topic string, tokens long")


Marginals = dict[str, dict[str, float]]


def rake(cells: pd.DataFrame, targets: pd.DataFrame, rounds: int = 200, total: float | None = None, marginals: Marginals | None = None) -> pd.DataFrame:
    """Weights (copies per document) of cells: ``cells`` plus ``weight``.

    ``total`` is the wanted number of tokens; by default the largest at which every source that has documents
    can reach its share within its cap. Sources without a target get weight 0; targets without tokens are left
    out and the others keep their proportions. ``marginals`` gives wanted shares by ``language`` and ``topic``;
    values it doesn't name share the rest as the corpus does. Where the sides contradict each other or the caps,
    the shares of sources hold.
    """
    cells = cells.merge(targets, on="source", how="left").reset_index(drop=True)
    cap = np.where(cells["target_share"] > 0, cells["max_repeats"], 0).astype(float)
    tokens = cells["tokens"].to_numpy(float)
    names = cells["source"].to_numpy()
    share = {s: t for s, t in zip(targets["source"], targets["target_share"]) if t > 0 and tokens[names == s].sum() > 0}
    whole = sum(share.values())
    share = {s: t / whole for s, t in share.items()}
    usable = np.isin(names, list(share))
    cap[~usable] = 0
    if not share or not whole:
        return cells.assign(weight=0.0)
    most = min((tokens * cap)[names == s].sum() / t for s, t in share.items())
    total = most if total is None else min(total, most)
    weight = np.where(usable, np.minimum(1.0, cap), 0.0)
    sides = []
    for side in ("language", "topic"):
        values = cells[side].to_numpy()
        own = {v: tokens[usable & (values == v)].sum() for v in sorted(set(values[usable]))}
        given = {v: t for v, t in (marginals or {}).get(side, {}).items() if own.get(v)}
        scale = max(1.0, sum(given.values()))
        others = sum(n for v, n in own.items() if v not in given)
        rest = 1 - sum(given.values()) / scale
        wish = {v: given[v] / scale if v in given else rest * n / others for v, n in own.items() if n}
        whole = sum(wish.values())
        sides.append([(usable & (values == v), t / whole * total) for v, t in wish.items()])
    by_source = [(names == s, t * total) for s, t in share.items()]
    for _ in range(rounds):
        before = weight.copy()
        for side in sides:
            for rows, wanted in side:
                now = (tokens * weight)[rows].sum()
                if now > 0:
                    weight[rows] = np.minimum(weight[rows] * (wanted / now), cap[rows])
        for rows, wanted in by_source:
            weight[rows] = _scaled(weight[rows], tokens[rows], cap[rows], wanted)
        if np.abs(weight - before).max() < 1e-9:
            break
    return cells.assign(weight=weight)


def _scaled(weight: np.ndarray, tokens: np.ndarray, cap: np.ndarray, wanted: float) -> np.ndarray:
    """Weights in proportion, at most ``cap``, whose tokens sum to ``wanted`` (which the caps allow)."""
    weight = np.maximum(weight, 1e-12)
    lo, hi = 0.0, 1.0
    while (np.minimum(weight * hi, cap) * tokens).sum() < wanted * (1 - 1e-12) and hi < 1e18:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        if (np.minimum(weight * mid, cap) * tokens).sum() < wanted:
            lo = mid
        else:
            hi = mid
    return np.minimum(weight * hi, cap)


def mix(
    docs: DataFrame, targets: DataFrame, tokenizer: str | None = None, pattern: str | None = None, seed: int = 7, topics_file: str = TOPICS_FILE, marginals: Marginals | None = None
) -> DataFrame:
    """The selection: ``doc_id, source, language, topic, tokens, copies``, documents with no copy left out.

    ``docs`` has ``doc_id, source, lang, text``, ``targets`` has ``source, target_share, max_repeats``. Documents
    of a null source, of one without a target, or without tokens are never chosen. The number of copies never
    exceeds ``max_repeats``. ``tokenizer`` is the path of a rank file, ``pattern`` that of its pieces,
    ``topics_file`` a table of topics, ``marginals`` the wanted shares of languages and topics. Only sums of cells
    reach the driver; their number doesn't grow with the documents.
    """
    from crawlmill.session import checkpointed

    cell = ["source", "language", "topic"]
    wanted = targets.select("source", "target_share", "max_repeats").filter("source is not null and target_share > 0 and max_repeats > 0").dropDuplicates(["source"])
    aims = wanted.limit(MAX_CELLS + 1).toPandas()
    if len(aims) > MAX_CELLS:
        raise ValueError("too many sources")
    rows = checkpointed(counted(docs.filter(F.col("source").isin(aims["source"].tolist())), tokenizer, pattern, topics_file).filter("tokens > 0"))
    sized = rows.withColumn("size", F.floor(F.log2(F.col("tokens")) * 8).cast("int"))
    sums = sized.groupBy(*cell, "size").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).limit(MAX_CELLS + 1).toPandas()
    if len(sums) > MAX_CELLS:
        raise ValueError("too many sources, languages and topics")
    session = rows.sparkSession
    if not len(sums):
        return rows.withColumn("copies", F.lit(0).cast("long")).limit(0)
    cells = rake(sums.groupby(cell, as_index=False)["tokens"].sum(), aims, marginals=marginals)
    sums = sums.merge(cells[[*cell, "weight"]], on=cell)
    sums["buckets"] = np.maximum(1, np.ceil(sums["n"] / ROWS_PER_BUCKET)).astype(int)
    plan = session.createDataFrame(sums[[*cell, "size", "weight", "buckets"]])
    order = F.xxhash64(F.lit(seed), "doc_id")
    placed = sized.join(F.broadcast(plan), [*cell, "size"]).withColumn("bucket", F.pmod(order, F.col("buckets")))
    part = F.col("weight") - F.floor("weight")
    # Wanted part-copies of the source's documents before each group: by length first, so that neighbours are alike.
    counts = placed.groupBy(*cell, "size", "bucket", "weight").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("source").orderBy("size", "language", "topic", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum(F.col("n") * part).over(ahead), F.lit(0.0))).drop("n", "weight")
    ranked = placed.withColumn("at", F.row_number().over(Window.partitionBy(*cell, "size", "bucket").orderBy("tokens", order, "doc_id")))
    ranked = ranked.join(counts, [*cell, "size", "bucket"])
    start = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1_000_000)) / 1_000_000
    reached = F.col("before") + F.col("at") * part + start
    extra = F.when(part > 0, F.floor(reached) - F.floor(reached - part)).otherwise(0)
    return ranked.withColumn("copies", (F.floor("weight") + extra).cast("long")).filter("copies > 0").select("doc_id", *cell, "tokens", "copies")


def shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares really reached: ``source, target_share, actual_share, documents, tokens, most_copies``.

    A source in ``targets`` without documents has an actual share of 0.
    """
    own = selection.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies")
    )
    own = own.withColumn("actual_share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))
    zero = F.lit(0).cast("long")
    return targets.select("source", "target_share").join(own, "source", "left").select(
        "source", "target_share", F.coalesce("actual_share", F.lit(0.0)).alias("actual_share"),
        *[F.coalesce(c, zero).alias(c) for c in ("documents", "tokens", "most_copies")],
    )
