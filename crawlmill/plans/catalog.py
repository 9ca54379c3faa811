"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crawlmill.plans import general, site, stateful, surface

_PARTS = (general, site, stateful, surface)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for part in _PARTS for k, q in part.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for part in _PARTS for k, s in part.ORACLES.items()}
FLAGSHIP = "q_summary"
