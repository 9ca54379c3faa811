"""Problem 4: the main body of a page without menus, notices, side columns and footers.

A page is cut into flat text blocks. A block is described by its own words and link density, those of its
neighbours, where it stands, and how its words are shared between articles and the rest of the labelled pages. A
decision tree, grown on a small labelled table, says which blocks belong to the article. The labels come from
pages whose containers carry telling names, listed in ``container_names.csv``. Neither names nor containers are
among the figures, which therefore are the same on a page that has none.
"""

from __future__ import annotations

import csv
import hashlib
import html
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlmill.sources.tables import spread

MAX_LABELLED_PAGES = 1500  # bound of the table the tree is grown on
CANDIDATES = 4  # pages looked at for each labelled one
LEAST_PAGES, MOST_ODDS = 3, 4.0  # a word's odds: labelled pages it must be on, and their bound
NAMES_FILE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "container_names.csv")
PAGES_AT_ONCE = 500

# Element classes of HTML.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table"
    " tbody td tfoot th thead tr ul".split()
)
REGION = frozenset("body div section article main aside nav header footer form dialog details".split())
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr option optgroup legend".split())
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
# A comment, an element whose content is no text, a tag, or a declaration.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|head|title|template|iframe|textarea|svg)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>",
    re.S | re.I,
)
NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*["']?([^"'>]*)""", re.I)
IS_HTML = re.compile(r"[\s﻿]*<(?:[a-zA-Z]|!)")
SENTENCE_END = (".", "?", "!", "…", ".”", ".«", "。", ".)", ":", ".»", "”")


class Region:
    """A sectioning container: its tag, the text of its start tag and the container around it."""

    __slots__ = ("rest", "tag", "up")

    def __init__(self, tag: str, rest: str, up: Region | None) -> None:
        self.tag, self.rest, self.up = tag, rest, up


def blocks(body: str | None) -> list[tuple[str, str, int, int, Region, bool]]:
    """Text blocks of a page in order: text, tag, words, linked words, region, whether it is quoted.

    A body that is null, empty or no HTML has none. Omitted end tags are closed as HTML closes them.
    """
    if not body or not IS_HTML.match(body):
        return []
    out: list[tuple[str, str, int, int, Region, bool]] = []
    top = Region("body", "", None)
    # An open element: tag, has no block inside, text parts, linked parts, region its children stand in.
    stack: list[list] = [["body", True, [], [], top, None]]
    link, pos, quotes = False, 0, 0

    def close(down_to: int) -> None:
        nonlocal quotes
        while len(stack) > down_to:
            tag, leaf, parts, linked, _, around = stack.pop()
            if leaf and parts:
                text = "".join(parts)
                if "&" in text:
                    text = html.unescape(text)
                words = text.split()
                if words:
                    n_linked = len("".join(linked).split()) if linked else 0
                    out.append((" ".join(words), tag, len(words), n_linked, around or top, quotes > 0))
            if tag == "blockquote":
                quotes -= 1

    for m in TOKEN.finditer(body):
        start = m.start()
        if start > pos:
            said = body[pos:start]
            if stack:
                here = stack[-1]
                if here[1]:
                    here[2].append(said)
                    if link:
                        here[3].append(said)
        pos = m.end()
        tag = m.group("tag")
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in BLOCK:
            if tag == "a":
                link = not m.group("end")
                if link and stack:
                    stack[-1][3].append(" ")
            elif tag == "br" and stack and stack[-1][1]:
                stack[-1][2].append(" ")
            continue
        if m.group("end"):
            if tag in ("body", "html"):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            link = False
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in ("td", "th", "caption", "table"):
                    break
        if tag in SIBLINGS:
            same, bound = SIBLINGS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in bound:
                    break
                if stack[i][0] in same:
                    close(i)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
        for open_ in reversed(stack):
            if not open_[1]:
                break
            open_[1] = False
        link = False
        if tag == "hr":
            continue
        around = stack[-1][4]
        stack.append([tag, True, [], [], Region(tag, m.group("rest"), around) if tag in REGION else around, around])
        if tag == "blockquote":
            quotes += 1
    if pos < len(body) and stack and stack[-1][1]:
        stack[-1][2].append(body[pos:])
    close(0)
    return out


DIGITS = re.compile(r"\d+")


def tokens(text: str) -> list[str]:
    """Words of a block, numbers alike."""
    return DIGITS.sub("0", text.lower()).split()


def word_odds(pages: list[list[tuple]], labels: list[list[bool]]) -> dict[str, float]:
    """Log odds of each word to stand in an article's block rather than in another one."""
    counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
    on = Counter()
    for page, said in zip(pages, labels):
        seen = set()
        for block, one in zip(page, said):
            words = set(tokens(block[0]))
            counts[bool(one)].update(words)
            seen |= words
        on.update(seen)
    whole = [sum(counts[k].values()) + 1 for k in (True, False)]
    return {
        w: float(np.clip(np.log((counts[True][w] + 0.5) / whole[0] * whole[1] / (counts[False][w] + 0.5)), -MOST_ODDS, MOST_ODDS))
        for w, n in on.items()
        if n >= LEAST_PAGES
    }


def features(page: list[tuple[str, str, int, int, Region, bool]], odds: dict[str, float]) -> list[list[float]]:
    """One row of figures per block: its own, those of two neighbours on each side, and its place."""
    own = []
    for text, tag, n, linked, _, quoted in page:
        known = [odds.get(w, 0.0) for w in tokens(text)]
        own.append(
            [
                n, linked / n, tag[0] == "h" and len(tag) == 2, tag == "p", tag == "li", tag in ("td", "th"), tag == "pre", tag in REGION, quoted or tag == "blockquote",
                text.endswith(SENTENCE_END), sum(known) / n,
            ]
        )
    last = len(page) - 1
    nothing = [0.0] * len(own[0]) if own else []
    top = next((i for i, block in enumerate(page) if block[1] == "h1"), -1)
    out = []
    for i, row in enumerate(own):
        near = [own[j] if 0 <= j <= last else nothing for j in (i - 2, i - 1, i + 1, i + 2)]
        place = [i, last - i, i / (last + 1), i - top if top >= 0 else -1]
        out.append(row + [x for other in near for x in (other[0], other[1], other[9], other[10])] + place)
    return out


def container_names(path: str = NAMES_FILE) -> dict[str, bool]:
    """Names of containers (class, id, role or tag) and whether an article stands in them."""
    with open(path, encoding="utf-8", newline="") as f:
        return {row["name"]: row["article"] == "1" for row in csv.DictReader(f)}


def label(page: list[tuple[str, str, int, int, Region, bool]], names: dict[str, bool]) -> list[bool] | None:
    """Labels from container names, or None where a page's names don't tell. The nearest telling container counts."""
    known, out, some = {}, [], False
    for _, tag, _, _, region, _ in page:
        r, said = region, known.get(id(region))
        if said is None:
            while said is None and r is not None:
                given = {x for group in NAME.findall(r.rest) for x in group.lower().split()}
                told = {names[x] for x in (r.tag, *given) if x in names}
                if told:
                    said = told == {True}
                elif r.tag == "body" or not given:
                    said = False if r.up is None else None
                else:
                    return None  # a name that tells nothing
                r = r.up
            known[id(region)] = said
        out.append(bool(said) and tag not in REGION)
        some |= out[-1]
    return out if some else None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 8) -> list[tuple[int, float, int, int, float]]:
    """Grow a decision tree by Gini impurity: nodes (feature, threshold, left, right, share of positives)."""
    nodes: list[tuple[int, float, int, int, float]] = []

    def split(rows: np.ndarray, level: int) -> int:
        at, share = len(nodes), float(y[rows].mean()) if len(rows) else 0.0
        nodes.append((-1, 0.0, -1, -1, share))
        if level == depth or len(rows) < 2 * least or share in (0.0, 1.0):
            return at
        best = (len(rows) * share * (1 - share) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(rows) + 1)
            cut = np.flatnonzero(v[:-1] < v[1:])
            cut = cut[(cut + 1 >= least) & (len(rows) - cut - 1 >= least)]
            if not len(cut):
                continue
            a, na = ones[cut], n[cut]
            b, nb = ones[-1] - a, len(rows) - na
            impurity = a * (na - a) / na + b * (nb - b) / nb
            k = int(np.argmin(impurity))
            if impurity[k] < best[0]:
                best = (float(impurity[k]), f, float(v[cut[k]] + v[cut[k] + 1]) / 2)
        if best[1] < 0:
            return at
        left = x[rows, best[1]] <= best[2]
        a = split(rows[left], level + 1)
        b = split(rows[~left], level + 1)
        nodes[at] = (best[1], best[2], a, b, share)
        return at

    split(np.arange(len(y)), 0)
    return nodes


def predict(tree: list[tuple[int, float, int, int, float]], x: np.ndarray) -> np.ndarray:
    """Share of positives in the leaf each row falls in."""
    f, t, a, b, share = (np.array(c) for c in zip(*tree))
    at = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    while True:
        inner = f[at] >= 0
        if not inner.any():
            return share[at]
        goes_left = x[rows, np.maximum(f[at], 0)] <= t[at]
        at = np.where(inner, np.where(goes_left, a[at], b[at]), at)


Tree = list[tuple[int, float, int, int, float]]


def fit(pages: list[list[tuple]], labels: list[list[bool]]) -> tuple[Tree, dict[str, float]]:
    """Tree and word odds. The tree is grown on odds that each page had no part in: those of the other half."""
    if not pages:
        return [(-1, 0.0, -1, -1, 0.0)], {}
    rows, said = [], []
    for half in (0, 1):
        odds = word_odds(pages[1 - half :: 2], labels[1 - half :: 2])
        for page, own in zip(pages[half::2], labels[half::2]):
            rows += features(page, odds)
            said += own
    return grow(np.array(rows, float), np.array(said, float)), word_odds(pages, labels)


def train(pages: DataFrame, names: dict[str, bool]) -> tuple[Tree, dict[str, float]]:
    """Fit on at most ``MAX_LABELLED_PAGES`` pages whose container names tell, the first by hash of the key.

    Only pages below a hash bound that leaves about ``CANDIDATES`` times that many are looked at for labels, so
    what is brought together for the choice doesn't grow with the pages.
    """
    order = F.xxhash64("record_kind", "record_key")
    share = min(1.0, CANDIDATES * MAX_LABELLED_PAGES / max(1, pages.count()))
    near = pages.filter(order <= F.lit(int(-(2**63) + share * (2**64 - 1)))) if share < 1 else pages
    articles = "|".join(sorted(re.escape(n) for n, one in names.items() if one))
    named = near.filter(F.col("body").rlike(rf"""(?i)<({articles})\b|(class|id|role)\s*=\s*["']?({articles})\b"""))
    listed = named.select("record_kind", "record_key", "body").orderBy(order, "record_kind", "record_key", "body").limit(MAX_LABELLED_PAGES).toPandas()
    cut, labels = [], []
    for body in listed["body"]:
        page = blocks(body)
        said = label(page, names)
        if said:
            cut.append(page)
            labels.append(said)
    return fit(cut, labels)


def article_blocks(pages: DataFrame, text: bool = False, names_file: str = NAMES_FILE) -> DataFrame:
    """Blocks of the article: ``record_kind, record_key, position, block_md5`` (and ``block``).

    ``pages`` has ``record_kind, record_key, body``. Bodies that are null, empty or no HTML have no rows, pages
    without labelled ones anywhere neither. Repeated rows give repeated blocks. ``names_file`` is the table of
    telling container names.
    """
    tree, odds = train(pages, container_names(names_file))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), PAGES_AT_ONCE):
                part = whole.iloc[lo : lo + PAGES_AT_ONCE]
                found, at, rows = [], [], []
                for i, body in enumerate(part["body"]):
                    page = blocks(body)
                    if page:
                        found += page
                        at += [(i, k) for k in range(len(page))]
                        rows += features(page, odds)
                if not rows:
                    continue
                keep = np.flatnonzero(predict(tree, np.array(rows, float)) > 0.5)
                if not len(keep):
                    continue
                of = [at[k][0] for k in keep]
                said = [found[k][0] for k in keep]
                out = {
                    "record_kind": part["record_kind"].to_numpy()[of],
                    "record_key": part["record_key"].to_numpy()[of],
                    "position": [at[k][1] for k in keep],
                    "block_md5": [hashlib.md5(s.encode("utf-8", "replace")).hexdigest() for s in said],
                }
                yield pd.DataFrame(out | ({"block": said} if text else {}))

    html_pages = pages.filter(F.col("body").rlike(r"^\s*﻿?\s*<[a-zA-Z!]"))
    return spread(html_pages).mapInPandas(run, "record_kind string, record_key string, position long, block_md5 string" + ", block string" * text)
