"""Column functions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorized(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """Arrow-batched column function of type ``kind``, made when first used, so importing needs no session."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap
