"""Deterministic range shards of an integer key, from histograms of all rows.

The bounds depend on the rows alone, never on how they are partitioned, so a rerun cuts the same shards. A cell of a
histogram that holds more than a shard's weight is cut into cells of its own, level by level, until none does or it
holds one key, which is never cut. A level collects and broadcasts 2 * CELLS rows at most, and cells are cut at most
64 / log2(CELLS) times. Rows with a null key are in shard 0; ties of the key share a shard; an empty table has one shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS, MOST = 8192, 65_536


def _cell(key: str, low: Column, width: Column) -> Column:
    """The cell of a key that is at least low; in decimals, since the range of longs is wider than a long."""
    key, low, width = (x.cast("decimal(38,0)") for x in (F.col(key), low, width))
    return ((key - low - F.pmod(key - low, width)) / width).cast("int")


def _placed(df: DataFrame, key: str, ranges: dict[int, tuple[int, int]]) -> DataFrame:
    """df with column `_at`, the cell of the key in its range `_parent`; null where there is no range."""
    if len(ranges) == 1:
        ((parent, (low, width)),) = ranges.items()
        return df.withColumn("_at", F.when(F.col("_parent") == parent, _cell(key, F.lit(low), F.lit(width))))
    rows = [(k, str(low), str(width)) for k, (low, width) in sorted(ranges.items())]
    bounds = df.sparkSession.createDataFrame(rows, "_range int, _low string, _width string")
    return df.join(F.broadcast(bounds), df["_parent"] == bounds["_range"], "left").withColumn("_at", _cell(key, F.col("_low"), F.col("_width"))).drop("_range", "_low", "_width")


def plan(df: DataFrame, key: str, weight: Column, target: float) -> tuple[int, list]:
    """(number of shards, what `deal` needs): ranges of `key` of about `target` weight each, MOST at most."""
    low, high, total = df.agg(F.min(key), F.max(key), F.sum(weight)).first()
    if low is None or not total or total <= target:
        return 1, []
    target = max(target, float(total) / MOST)
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), weight.alias("_weight"), F.lit(0).alias("_parent"))
    ranges, found, fan = {0: (int(low), (int(high) - int(low)) // CELLS + 1)}, [], CELLS
    while True:
        # rows outside of cells that are cut again are dropped at each level
        placed = _placed(rows, "_key", ranges)
        weights = {(p, c): float(w or 0) for p, c, w in placed.groupBy("_parent", "_at").agg(F.sum("_weight")).collect()}
        heavy = sorted(pc for pc, w in weights.items() if w > target and ranges[pc[0]][1] > 1)
        found.append((ranges, weights, {pc: k for k, pc in enumerate(heavy)}))
        if not heavy:
            break
        fan = max(16, CELLS // len(heavy))
        children = df.sparkSession.createDataFrame([(p, c, k) for k, (p, c) in enumerate(heavy)], "_parent int, _at int, _child int")
        rows = placed.join(F.broadcast(children), ["_parent", "_at"]).select("_key", "_weight", F.col("_child").alias("_parent"))
        ranges = {k: (ranges[p][0] + c * ranges[p][1], (ranges[p][1] - 1) // fan + 1) for k, (p, c) in enumerate(heavy)}
    of_cell: list[dict[tuple[int, int], int]] = [{} for _ in found]
    shard, filled = 0, 0.0
    by_parent = [{} for _ in found]
    for level, (_, weights, _) in enumerate(found):
        for p, c in sorted(weights):
            by_parent[level].setdefault(p, []).append(c)
    todo = [(0, 0, c) for c in reversed(by_parent[0][0])]
    while todo:  # cells in the order of their keys, those of a cut cell in its place
        level, p, c = todo.pop()
        _, weights, cut = found[level]
        if (p, c) in cut:
            todo += [(level + 1, cut[p, c], x) for x in reversed(by_parent[level + 1][cut[p, c]])]
            continue
        if filled and filled + weights[p, c] > target:
            shard, filled = shard + 1, 0.0
        filled += weights[p, c]
        of_cell[level][p, c] = shard
    levels = [(ranges, [(p, c, of_cell[k].get((p, c)), cut.get((p, c))) for p, c in sorted(weights)]) for k, (ranges, weights, cut) in enumerate(found)]
    return shard + 1, levels


def deal(df: DataFrame, key: str, levels: list, n: int) -> DataFrame:
    """df with int column `shard`, one partition per shard."""
    if n == 1:
        return df.withColumn("shard", F.lit(0)).repartition(1)
    columns = df.columns
    rows = df.withColumn("_parent", F.lit(0)).withColumn("shard", F.lit(None).cast("int"))
    for ranges, cells in levels:
        table = df.sparkSession.createDataFrame(cells, "_p int, _c int, _shard int, _child int")  # as many rows as cells
        found = _placed(rows, key, ranges).join(F.broadcast(table), (F.col("_parent") == F.col("_p")) & (F.col("_at") == F.col("_c")), "left")
        rows = found.select(*columns, F.coalesce("shard", "_shard").alias("shard"), F.col("_child").alias("_parent"))
    return rows.select(*columns, F.coalesce("shard", F.lit(0)).alias("shard")).repartitionById(n, F.col("shard"))
