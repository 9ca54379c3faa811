"""Problem 10: pages of repeated keywords, link lists or product tags instead of sentences.

Lines are cut into pieces at separators and sentence ends; a piece is reduced to a shape: a class of its number
of words, its capitals, the separator behind it, and whether it is a link or a tag. The shapes of a page are
grouped; a page is flagged when more than half of its words stand in shapes that no sentence has. A sentence that makes do, together with the neighbours most like it, with
the same few words again and again counts as keyword repetition, whatever else the page holds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlmill.sources.tables import spread

SHORT_PIECE, LONG_RUN = 5, 45
FEW_SHAPES = 6  # shapes named in the result
TOP_WORDS, TOP_SHARE, TOP_LEAST = 6, 0.55, 20
REACH, ALIKE, GROUP_DISTINCT, AGAIN = 6, 3, 0.5, 0.6
RUN_LEAST, RUN_DISTINCT, LONG_DISTINCT, SHORT_DISTINCT = 12, 0.8, 0.72, 0.5
SENTENCE_LEAST, SENTENCE_PIECES = 8, 4

WORD = re.compile(r"[^\W_]+")
LINK = re.compile(r"\[[^\]\n]*\]\([^)\n]*\)|https?://\S+|\bwww\.\S+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}\b(?:/\S*)?", re.I)
# What ends a piece: separators, a sentence's end, a dash between blanks, a tag's beginning or a tab. One class of
# characters stands first, so that other characters are passed over at once.
CUT = re.compile(
    r"[,;|/•·»›→>.!?…。\s#](?:(?<=[,;|/•·»›→>])[,;|/•·»›→>]*(?=\s|$)|(?<=\s)\s*[-–—/|•·→>»*]+\s+|(?<=[.!?…。])[.!?…。]*(?=\s|$)|(?<=\s#)(?=\w)|(?<=\t)\t*)"
)
DOTTED = re.compile(r"\.(?<=\w\.)[a-z]", re.I)
TAG = re.compile(r"^\s*(?:#\w+|\w[\w.]{0,15}\s?[=:]\s?\S.*)$")
SENTENCE_END = set(".!?…。:")


def pieces(line: str) -> Iterator[tuple[str, str]]:
    """Pieces of a line with what ends them: ``.`` a sentence end, ``,`` a separator, `` `` the line's end."""
    at = 0
    for m in CUT.finditer(line):
        mark, start = m.group()[0], m.start()
        if start > at:
            yield line[at:start], "." if mark in ".!?…。" else ","
        at = start if mark == "#" else m.end()
    if at < len(line):
        yield line[at:], " "


def shape(piece: str, end: str, n: int, links: bool) -> str:
    """Class of the number of words, first letter, what follows, kind; ``links``: the line holds some."""
    size = "1" if n < 2 else "3" if n < 4 else "5" if n <= SHORT_PIECE else "9" if n < 10 else "n" if n <= LONG_RUN else "x"
    first = piece.lstrip(" -*>#\"“([")[:1]
    kind = "L" if links and LINK.search(piece) else "#" if TAG.match(piece) and n <= SHORT_PIECE else "-"
    return f"{size}{'A' if first.isupper() else 'a'}{end}{kind}"


def _odd(mark: str) -> bool:
    """Whether a shape is none of a sentence."""
    return mark[3] != "-" or mark[0] in "135" or mark[0] == "x"


def _repeated(said: list[list[str]], enough: float) -> tuple[int, int]:
    """Words in sentences of keyword repetition, and the number of these sentences.

    Each sentence is judged with the ``ALIKE`` neighbours that share most words with it, so real sentences before,
    behind or between do not count. Where fewer than ``enough`` words can come together nothing is looked at.
    """
    every = " ".join(map(" ".join, said)).lower().split(" ")
    often = {w for w, n in Counter(every).items() if n > 1}
    ends = list(accumulate(map(len, said)))
    said = [every[b - len(x) : b] for x, b in zip(said, ends)]
    maybe = [i for i, x in enumerate(said) if sum(map(often.__contains__, x)) >= AGAIN * len(x)]
    if sum(len(said[i]) for i in maybe) < enough:
        return 0, 0
    sets = [frozenset(x) for x in said]
    sizes = [len(x) for x in sets]
    words = found = 0
    for i in maybe:
        own = sets[i]
        near = sorted([(-len(own & sets[j]) / sizes[j], j) for j in range(max(0, i - REACH), min(len(said), i + REACH + 1)) if j != i])
        joined = said[i] + [w for _, j in near[:ALIKE] for w in said[j]]
        size = len(joined)
        if size < TOP_LEAST or len(set(joined)) > GROUP_DISTINCT * size:
            continue
        group = Counter(joined)
        if sum(n for _, n in group.most_common(TOP_WORDS)) < TOP_SHARE * size:
            continue
        if sum(group[w] > 1 for w in said[i]) >= AGAIN * len(said[i]):
            words += len(said[i])
            found += 1
    return words, found


def judge(text: str | None) -> tuple[float, int, int, str]:
    """Share of words outside sentences, number of words, of odd pieces, and the page's largest odd shapes.

    Null, empty and wordless texts have a share of 0, and so has a text that is one short piece (a bare title).
    """
    if not text:
        return 0.0, 0, 0, ""
    total, odd_words, odd_pieces = 0, 0, 0
    shapes: Counter = Counter()
    kept: list[list[str]] = []  # words of what is like sentences, one list each
    for line in text.split("\n"):
        links = LINK.findall(line) if "://" in line or "](" in line or DOTTED.search(line) else ()
        if links:
            n = len(WORD.findall(line))
            if n - sum(len(WORD.findall(x)) for x in links) <= 6 * len(links):  # links with labels
                total += n
                odd_words += n
                odd_pieces += len(links)
                shapes["link"] += n
                continue
        held: list[tuple[str, str, list[str]]] = []
        for piece, end in pieces(line):
            words = WORD.findall(piece)
            if words:
                held.append((piece, end, words))
            if end == ",":
                continue
            # The pieces of one sentence: a few clauses of a whole one are no list.
            size = sum(len(w) for _, _, w in held)
            total += size
            kept.append([])
            whole = end == "." and SENTENCE_LEAST <= size <= LONG_RUN and len(held) <= SENTENCE_PIECES and not links
            for part, mark_end, said in held:
                k = len(said)
                if whole and not TAG.match(part):
                    kept[-1] += said
                    continue
                if k > SHORT_PIECE and not links:
                    limit = SHORT_DISTINCT if k < RUN_LEAST else RUN_DISTINCT * (1 if part[0].islower() else 0.75) if k <= LONG_RUN else LONG_DISTINCT
                    if (mark_end == " " or k > LONG_RUN) and len({w.lower() for w in said}) <= limit * k:
                        odd_words += k  # an open run of words that come again
                        odd_pieces += k // SHORT_PIECE
                        shapes["run"] += k
                    else:
                        kept[-1] += said
                    continue
                mark = shape(part, mark_end, k, bool(links))
                if _odd(mark):
                    odd_words += k
                    odd_pieces += 1
                    shapes[mark] += k
                else:
                    kept[-1] += said
            held = []
        if held:  # the line ends within a list
            kept.append([])
            for part, mark_end, said in held:
                k = len(said)
                total += k
                mark = shape(part, mark_end, k, bool(links))
                if k <= SHORT_PIECE or (links and _odd(mark)):
                    odd_words += k
                    odd_pieces += 1
                    shapes[mark] += k
                else:
                    kept[-1] += said
    again, times = _repeated([x for x in kept if x], total / 2 - odd_words)
    if times:
        odd_words += again
        odd_pieces += times
        shapes["repeat"] += again
    share = odd_words / total if total else 0.0
    if odd_pieces == 1 and not shapes.keys() & {"link", "run", "repeat"} and all(s[3] == "-" for s in shapes):
        share = 0.0  # a single short piece without separator, link, tag or repetition is no list
    return share, total, odd_pieces, " ".join(f"{s}:{c}" for s, c in shapes.most_common(FEW_SHAPES))


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, words, odd_share, shapes, spam`` for every document; texts are read whole.

    Null and empty texts are no spam. Repeated rows are judged alike; a null ``doc_id`` stays.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [judge(t) for t in part["text"]]
            share = np.array([f[0] for f in found], float)
            yield pd.DataFrame({"doc_id": part["doc_id"], "words": [f[1] for f in found], "odd_share": share, "shapes": [f[3] for f in found], "spam": share > 0.5})

    return spread(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, words long, odd_share double, shapes string, spam boolean")
