"""Declarative extractions: a definition names a selector, what to take, and a condition."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlmill.functions.html import Node, clean, css_steps, parse, select, xpath_steps
from crawlmill.sources.tables import spread

MODES = ("css", "xpath", "regex")
TAKES = ("text", "html", "attribute", "count")
CONDITIONS = ("always", "exists", "absent", "equals", "contains", "regex")
MAX_DEFINITIONS = 100


@dataclass(frozen=True)
class Definition:
    """What to extract and when it is a finding; limits bound matches and bytes."""

    id: str
    selector: str
    mode: str = "css"
    take: str = "text"
    attribute: str = ""
    condition: str = "exists"
    pattern: str = ""
    max_matches: int = 100
    max_value_bytes: int = 4096
    max_total_bytes: int = 65536

    def checked(self) -> Definition:
        """The definition, or ValueError where it breaks a rule."""
        ok = self.id and len(self.id) <= 128 and self.mode in MODES and self.take in TAKES and self.condition in CONDITIONS
        ok = ok and 0 < len(self.selector.encode()) <= 512 and len(self.pattern) <= 1024 and (self.take != "attribute" or self.attribute)
        ok = ok and 0 < self.max_matches <= 1000 and 0 < self.max_value_bytes <= 65536 and 0 < self.max_total_bytes <= 1 << 20
        if not ok:
            raise ValueError(f"definition {self.id}")
        if self.mode == "css":
            css_steps(self.selector)
        elif self.mode == "xpath":
            xpath_steps(self.selector)
        else:
            re.compile(self.selector)
        if self.condition == "regex":
            re.compile(self.pattern)
        return self


def load(listed: list[dict]) -> list[Definition]:
    """Definitions of an import: unknown members, double ids and more than a hundred are refused."""
    if len(listed) > MAX_DEFINITIONS:
        raise ValueError("too many definitions")
    try:
        out = [Definition(**d).checked() for d in listed]
    except TypeError as x:
        raise ValueError("unknown member") from x
    if len({d.id for d in out}) < len(out):
        raise ValueError("double id")
    return out


def dump(definitions: list[Definition]) -> list[dict]:
    """Export form of definitions."""
    return [asdict(d) for d in definitions]


def _cut(text: str, size: int) -> str:
    raw = text.encode("utf-8", "replace")
    return text if len(raw) <= size else raw[:size].decode("utf-8", "ignore")


def execute(d: Definition, body: str, tree: Node | None = None) -> tuple[list[str], int, bool, bool]:
    """Values, number of matches, whether the condition holds, whether limits cut anything."""
    if d.mode == "regex":
        found: list = [m.group(1) if m.re.groups else m.group() for m in re.finditer(d.selector, body)]
    else:
        found = select(tree or parse(body), css_steps(d.selector) if d.mode == "css" else xpath_steps(d.selector))
    count, truncated, total = len(found), len(found) > d.max_matches, 0
    values: list[str] = []
    for node in found[: d.max_matches] if d.take != "count" else ():
        if isinstance(node, str):
            said = node
        elif d.take == "html":
            said = node.inner()
        elif d.take == "attribute":
            if d.attribute.lower() not in node.attrs:
                continue
            said = node.get(d.attribute.lower())
        else:
            said = " ".join(filter(None, map(clean, node.texts())))
        short = _cut(said, d.max_value_bytes)
        truncated |= short != said
        if total + len(short.encode()) > d.max_total_bytes:
            truncated = True
            break
        total += len(short.encode())
        values.append(short)
    if d.take == "count":
        values = [str(count)]
    met = {
        "always": lambda: count > 0, "exists": lambda: count > 0, "absent": lambda: count == 0, "equals": lambda: d.pattern in values,
        "contains": lambda: any(d.pattern in v for v in values), "regex": lambda: any(re.search(d.pattern, v) for v in values),
    }[d.condition]()
    return values, count, met, truncated


def run_audits(pages: DataFrame, key: str, definitions: list[Definition]) -> DataFrame:
    """Results of all definitions on all pages: ``key, definition_id, values, match_count, condition_met, truncated``.

    Each document is parsed once, whatever the number of definitions. ``pages`` has ``key, body``; null bodies
    have no results.
    """
    checked = [d.checked() for d in definitions]
    if len(checked) > MAX_DEFINITIONS:
        raise ValueError("too many definitions")
    rows = spread(pages.select(key, "body").filter("body is not null"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for k, body in zip(part[key], part["body"]):
                tree = parse(body)
                out += [(k, d.id, *execute(d, body, tree)) for d in checked]
            yield pd.DataFrame(out, columns=[key, "definition_id", "values", "match_count", "condition_met", "truncated"])

    kind = pages.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"`{key}` {kind}, definition_id string, values array<string>, match_count long, condition_met boolean, truncated boolean")


def latest_results(results: DataFrame, key: str, order: str) -> DataFrame:
    """One result per page and definition, the last by ``order``."""
    rest = [c for c in results.columns if c not in (key, "definition_id")]
    return results.groupBy(key, "definition_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "definition_id", "r.*")
