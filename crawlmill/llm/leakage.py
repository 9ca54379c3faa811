"""Problem 8: passages of held-out evaluation items inside a training corpus.

The items form an inverted index of BM25 weights: posting lists of items by term, and of blocks of items with each
term's largest weight in the block. Every document is cut into overlapping passages, each free of words that no
item has, since a shared run cannot hold one; a passage is a query. As in block-max WAND, a pivot decides which
blocks are looked at: every run of ten words of an item holds its rarest word, so only the posting lists of such
words are walked. A block met there is opened where the sum of its largest weights reaches its threshold, and only
then are its items scored. The threshold of an item is the smallest score any passage can have that holds ten
consecutive words of it (or all, if it has fewer), so the retrieval loses none; the shared words are then
verified. Items of fewer than ten words have an index per length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlmill.sources.tables import spread

RUN, PASSAGE, BLOCK = 10, 40, 16
K1, B = 1.2, 0.75
MAX_WORDS = 10_000_000  # words of the items of one index (some 300 MB), which is sent to every task; more take further passes
LOOKUPS = 4_000_000  # postings looked up at once
WORD = re.compile(r"[^\W_]+")
OUT = "doc_id long, item_id long, score double, shared_words long, item_words long"


@dataclass
class Postings:
    """Sparse matrix of weights: a sorted key ``term * width + column`` for each that isn't zero."""

    keys: np.ndarray
    values: np.ndarray
    width: int

    def sums(self, terms: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Sum over each row of ``terms`` of the weights at that row's column."""
        wanted = terms * self.width + columns[:, None]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], 0.0).sum(1)


@dataclass
class Index:
    """Inverted index of the items: term numbers, postings, thresholds, pivots and the words to verify."""

    terms: dict[str, int]
    items: np.ndarray
    by_item: Postings
    by_block: Postings
    pivot_from: np.ndarray  # per term: where its blocks begin among ``pivot_blocks``
    pivot_blocks: np.ndarray
    least: np.ndarray  # per item, ascending
    block_least: np.ndarray  # per block
    words: list[np.ndarray]
    run: int  # length of a shared run


def words_of(text: str | None) -> list[str]:
    """Words: longest runs of letters or digits, letter case ignored."""
    return WORD.findall(text.lower()) if text else []


def build(items: list[tuple[int, str | None]]) -> list[Index]:
    """Indexes of items (id, text) by length of a shared run; items without words are in none."""
    said = [(i, words_of(t)) for i, t in items]
    by_run: dict[int, list[tuple[int, list[str]]]] = {}
    for i, w in said:
        if w:
            by_run.setdefault(min(RUN, len(w)), []).append((i, w))
    return [_index(run, own) for run, own in sorted(by_run.items())]


def _index(run: int, said: list[tuple[int, list[str]]]) -> Index:
    terms: dict[str, int] = {}
    for _, w in said:
        for x in w:
            terms.setdefault(x, len(terms))
    n, mean = len(said), sum(len(w) for _, w in said) / len(said)
    coded = [np.array([terms[x] for x in w], np.int64) for _, w in said]
    own = [np.unique(w, return_counts=True) for w in coded]
    having = np.bincount(np.concatenate([t for t, _ in own]), minlength=len(terms) + 1)
    idf = np.log(1 + (n - having + 0.5) / (having + 0.5))
    weights, least = [], np.empty(n)
    for k, (w, (t, tf)) in enumerate(zip(coded, own)):
        weights.append(idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean)))
        sums = np.concatenate([[0.0], np.cumsum(weights[k][np.searchsorted(t, w)])])
        least[k] = (sums[run:] - sums[:-run]).min() - 1e-6
    order = np.argsort(least, kind="stable")  # items of a block have like thresholds
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    term = np.concatenate([t for t, _ in own])
    item = np.repeat(place, [len(t) for t, _ in own])
    value = np.concatenate(weights)
    blocks = -(-n // BLOCK)
    # The rarest word of each run, and the blocks of items it stands for.
    pivots = []
    for k, w in enumerate(coded):
        rank = having[w] * (len(terms) + 1) + w
        rarest = np.unique(np.lib.stride_tricks.sliding_window_view(rank, run).min(1) % (len(terms) + 1))
        pivots.append(rarest * blocks + place[k] // BLOCK)
    pairs = np.unique(np.concatenate(pivots))
    starts = np.searchsorted(pairs, np.arange(len(terms) + 2) * blocks)
    return Index(
        terms, np.array([said[k][0] for k in order]), _postings(term * n + item, value, n), _postings(term * blocks + item // BLOCK, value, blocks),
        starts, pairs % blocks, least[order], least[order][::BLOCK].copy(), [coded[k] for k in order], run,
    )


def _postings(keys: np.ndarray, values: np.ndarray, width: int) -> Postings:
    """Postings with the largest value of each key."""
    order = np.argsort(keys, kind="stable")
    keys, starts = np.unique(keys[order], return_index=True)
    return Postings(keys, np.maximum.reduceat(values[order], starts), width)


def _met(index: Index, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of passage and block that the passage's pivot words lead to."""
    flat = ids.ravel()
    first = index.pivot_from[flat]
    n = index.pivot_from[flat + 1] - first
    before = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(before, n) + np.repeat(first, n)
    blocks = len(index.block_least)
    pairs = np.unique(np.repeat(np.arange(len(flat)) // ids.shape[1], n) * blocks + index.pivot_blocks[at])
    return pairs // blocks, pairs % blocks


def _scored(index: Index, ids: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Passage, item and score of all that reach the item's threshold."""
    passages, blocks = _met(index, ids)
    step = max(1, LOOKUPS // PASSAGE)
    for lo in range(0, len(passages), step):
        p, b = passages[lo : lo + step], blocks[lo : lo + step]
        opened = index.by_block.sums(ids[p], b) >= index.block_least[b] - 1e-6
        p, b = p[opened], b[opened]
        for at in range(0, len(p), max(1, step // BLOCK)):
            cut = slice(at, at + max(1, step // BLOCK))
            items = b[cut, None] * BLOCK + np.arange(BLOCK)
            own, items = np.repeat(p[cut], BLOCK), items.ravel()
            own, items = own[items < len(index.items)], items[items < len(index.items)]
            scores = index.by_item.sums(ids[own], items)
            for k in np.flatnonzero(scores >= index.least[items]):
                yield int(own[k]), int(items[k]), float(scores[k])


def search(index: Index, docs: list[list[str]]) -> list[tuple[int, int, float, int]]:
    """Leaks: number of the document, of the item, best passage score, words of the item in shared runs."""
    unknown, run = len(index.terms), index.run
    get = index.terms.get
    flat = [unknown]
    ends = []
    for d in docs:
        flat += [get(w, unknown) for w in d]
        flat.append(unknown)  # no passage reaches over a document's end
        ends.append(len(flat))
    flat = np.array(flat, np.int64)
    breaks = np.flatnonzero(flat == unknown)
    long = np.diff(breaks) > run
    first, last = breaks[:-1][long] + 1, breaks[1:][long]  # stretches of known words
    if not len(first):
        return []
    windows = [(s, min(s + PASSAGE, e)) for f, e in zip(first.tolist(), last.tolist()) for s in range(f, max(f + 1, e - run + 1), PASSAGE - run + 1)]
    starts, stops = np.array(windows).T
    owner = np.searchsorted(np.array(ends), starts, side="right")
    at = starts[:, None] + np.arange(PASSAGE)
    ids = np.where(at < stops[:, None], flat[np.minimum(at, len(flat) - 1)], unknown)
    found: dict[tuple[int, int], float] = {}
    walked = np.cumsum((index.pivot_from[ids + 1] - index.pivot_from[ids]).sum(1))
    part = walked // LOOKUPS + np.arange(len(ids)) // 2000  # passages taken together: bounded in number and in lookups
    cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    for lo, hi in zip(cuts, [*cuts[1:], len(ids)]):
        for p, k, score in _scored(index, ids[lo:hi]):
            key = (int(owner[lo + p]), k)
            found[key] = max(found.get(key, 0.0), score)
    # Runs of the documents found, to verify the shared words.
    runs: dict[int, set] = {d: set() for d, _ in found}
    for f, e, d in zip(first.tolist(), last.tolist(), np.searchsorted(np.array(ends), first, side="right").tolist()):
        if d in runs:
            said = flat[f:e].tolist()
            runs[d].update(tuple(said[i : i + run]) for i in range(e - f - run + 1))
    out = []
    for (d, k), score in found.items():
        item = index.words[k].tolist()
        covered = np.zeros(len(item), bool)
        for i in range(len(item) - run + 1):
            if tuple(item[i : i + run]) in runs[d]:
                covered[i : i + run] = True
        if covered.any():
            out.append((d, k, score, int(covered.sum())))
    return out


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold passages of items: ``doc_id, item_id, score, shared_words, item_words``.

    A leak is ten consecutive words in common, or all words of a shorter item in sequence. Texts are read whole;
    null and empty ones have no leaks, nor have items without words. Of items with one id each text counts.
    The items are a held-out set: one pass serves all whose texts have at most ``MAX_WORDS`` words together (some
    hundred thousand items), so what is sent to a task is bounded; larger sets take a pass each for as many.
    Repeated rows give repeated leaks.
    """
    listed = items.select("item_id", "text").distinct().orderBy("item_id", "text")
    queries = spread(docs.filter("text is not null and text <> ''").select("doc_id", "text"))
    found, held, words = [], [], 0
    for r in listed.toLocalIterator():
        n = len(words_of(r["text"]))
        if held and words + n > MAX_WORDS:
            found.append(_run(queries, build(held)))
            held, words = [], 0
        held.append((r["item_id"], r["text"]))
        words += n
    found += [_run(queries, build(held))] if words else []
    if not found:
        return queries.sparkSession.createDataFrame([], OUT)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _run(queries: DataFrame, indexes: list[Index]) -> DataFrame:
    shared = queries.sparkSession.sparkContext.broadcast(indexes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            ids = part["doc_id"].to_numpy()
            texts = part["text"].tolist()
            for lo in range(0, len(texts), 500):
                docs = [words_of(t) for t in texts[lo : lo + 500]]
                for own in shared.value:
                    found = search(own, docs)
                    if found:
                        yield pd.DataFrame(
                            [(ids[lo + d], own.items[k], s, c, len(own.words[k])) for d, k, s, c in found],
                            columns=["doc_id", "item_id", "score", "shared_words", "item_words"],
                        )

    return queries.mapInPandas(run, OUT)
