"""Timings and their percentiles, and queries to time."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import functions as F

from .index import Index


def percentiles(values: list[float], of=(50, 95, 99, 99.9)) -> dict[str, float]:
    """The value at index floor(n p / 100) of the sorted values, their mean, least and most; none of no values."""
    v = sorted(values)
    if not v:
        return {}
    return {f"p{p:g}": v[min(len(v) - 1, int(len(v) * p / 100))] for p in of} | {"mean": sum(v) / len(v), "min": v[0], "max": v[-1]}


def timed(action: Callable[[], object], times: int, warm_up: int = 1) -> dict[str, float]:
    """Percentiles of an action's seconds."""
    for _ in range(warm_up):
        action()
    out = []
    for _ in range(times):
        began = time.perf_counter()
        action()
        out.append(time.perf_counter() - began)
    return percentiles(out)


def query_words(index: Index, n: int, least_df: int = 3) -> list[str]:
    """n terms of at least least_df documents, in an order that only the terms decide."""
    return [r[0] for r in index.terms.filter(F.col("df") >= least_df).orderBy(F.xxhash64("term"), "term").limit(n).select("term").collect()]
