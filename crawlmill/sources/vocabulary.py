"""Vocabulary of structured data from its published JSON-LD graph."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

TERMS = "kind string, name string, parents array<string>, domains array<string>, ranges array<string>, superseded_by string"
# What a node is and which members name others.
KINDS = {"rdfs:Class": "type", "rdf:Property": "property"}


def _names(value: Any) -> list[str]:
    """Names of the nodes a member refers to, sorted, each once."""
    listed = value if isinstance(value, list) else [value]
    return sorted({str(v["@id"]).rsplit("/", 1)[-1].removeprefix("schema:") for v in listed if isinstance(v, dict) and "@id" in v})


def graph_terms(text: str | None) -> list[tuple]:
    """Terms of one graph; null and broken texts have none, nodes without a name or kind are left out."""
    try:
        nodes = json.loads(text or "").get("@graph", [])
    except (ValueError, AttributeError):
        return []
    out = []
    for node in nodes if isinstance(nodes, list) else []:
        if not isinstance(node, dict) or not isinstance(node.get("@id"), str):
            continue
        said = node.get("@type", [])
        kind = next((KINDS[t] for t in (said if isinstance(said, list) else [said]) if t in KINDS), None)
        if kind:
            name = node["@id"].rsplit("/", 1)[-1].removeprefix("schema:")
            newer = _names(node.get("schema:supersededBy"))
            out.append((kind, name, _names(node.get("rdfs:subClassOf")), _names(node.get("schema:domainIncludes")), _names(node.get("schema:rangeIncludes")), newer[0] if newer else None))
    return out


def terms(files: DataFrame, column: str) -> DataFrame:
    """Terms of all graphs in ``column``, one row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [t for text in part[column] for t in graph_terms(text)]
            if rows:
                yield pd.DataFrame(rows, columns=["kind", "name", "parents", "domains", "ranges", "superseded_by"])

    return files.select(column).mapInPandas(run, TERMS).dropDuplicates(["kind", "name"])
