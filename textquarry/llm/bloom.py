"""A filter of bounded size that tells which strings may be among those of a table, however many those are."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 16 bits a string, MOST_BITS (8 MB) at most: past 4 million strings more of the others pass.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
#: The seed of Spark's xxhash64.
_SEED = 42


def bloom(keys: DataFrame, n: int) -> np.ndarray:
    """The filter of about n strings, the column key of keys. Nulls are not in it; repeated strings change nothing.

    Bits are set in the tasks and joined by words of 64, so the driver gets a million rows at most.
    """
    size = min(max(LEAST_BITS, 1 << (16 * n - 1).bit_length() if n else 0), MOST_BITS)
    places = keys.filter("key IS NOT NULL").select(F.xxhash64("key").alias("h")).select(F.expr(f"explode(array(h & {size - 1}L, shiftrightunsigned(h, 32) & {size - 1}L))").alias("at"))
    words = places.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits")).toArrow()
    out = np.zeros(size // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def among(bits: np.ndarray, strings: list[str]) -> np.ndarray:
    """Of each string whether it may be in the filter; True for all that are."""
    h = np.fromiter((xxhash.xxh64_intdigest(s.encode(), _SEED) for s in strings), dtype=np.uint64, count=len(strings))
    last = np.uint64(64 * len(bits) - 1)
    out = np.ones(len(strings), dtype=bool)
    for at in (h & last, (h >> np.uint64(32)) & last):
        out &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out
