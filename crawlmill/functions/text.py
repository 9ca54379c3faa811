"""Text fingerprints: SimHash over word shingles, and normalization."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlmill.functions import vectorized

SHINGLE = 3
_WHITE = re.compile("[\t\n\v\f\r \x85\xa0 -     　]+")


def simhash(text: str | None) -> int | None:
    """64-bit SimHash of lower-case word shingles, None for a text without words.

    Words are split at white space; a shingle is three words (all of them, if fewer) joined by NUL, its value
    the first eight bytes of its SHA-256; a bit is set where at least half of the shingles have it.
    """
    words = [w for w in _WHITE.split(text.lower()) if w] if text else []
    if not words:
        return None
    n = min(SHINGLE, len(words))
    raw = b"".join(hashlib.sha256("\0".join(words[i : i + n]).encode("utf-8", "replace")).digest()[:8] for i in range(len(words) - n + 1))
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) >= len(bits)).tobytes(), "big")


def simhash_hex(text: str | None) -> str:
    """Sixteen hexadecimal digits, or an empty text."""
    value = simhash(text)
    return "" if value is None else f"{value:016x}"


@vectorized("long")
def simhash64(texts: pd.Series) -> pd.Series:
    """SimHash as a signed long; null for texts without words."""
    found = [simhash(t) for t in texts]
    return pd.Series([None if v is None else v - (1 << 64) if v >> 63 else v for v in found], dtype="Int64")


def hex16(value: Column) -> Column:
    """Unsigned hexadecimal form of a signed long."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def normalize(text: Column) -> Column:
    """White space runs of any kind become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
