"""Connected components of a written edge table: no edge reaches the driver, and no node's edges meet in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r and x != r:
            up[x], x = r, p
        return r

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of n nodes the least that it reaches by the edges (a, b): minima over all edges at once, until none changes."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def forests(edges: DataFrame, most: int = 500_000) -> DataFrame:
    """Fewer edges (u > v) that connect the same nodes: each task keeps a forest, and gives it out when it has `most` nodes."""

    def work(batches):
        f = Forest()

        def out():
            rows = [(n, r) for n in f.up if (r := f.root(n)) != n]
            f.up = {}
            a = np.array(rows, dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                f.join(a, b)
            if len(f.up) > most:
                yield out()
        yield out()

    return mapped(edges.select("u", "v").filter("u <> v"), work, "u long, v long", "components")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of edges (u, v) the smallest node it reaches. Nodes without edges have no row.

    Large-star and small-star steps in turn until the edges stay as they are: the rounds grow with the logarithm of
    the graph. A step is a minimum per node, taken in each task before the shuffle and written, and joined back to the
    edges. Both sides of that join are scans, so adaptive execution can split the rows of a node with very many edges.
    """
    e = written(forests(edges), "edges")
    mark = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(e)
    while before[0]:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        after = mark(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
