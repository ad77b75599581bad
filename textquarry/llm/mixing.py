"""Mixing sources to target weights: pivotal dependent rounding by a reduction tree; DataFrame functions only.

A source's documents share one rate: its target over its size. A document gets the whole part of the rate as copies,
and one more with the fractional part as probability. Fractions are settled in pairs: of two open documents one hands
word mass to the other, in a direction drawn so that both keep their probability, until one of them is settled (0 or
1 more). A pair's total of words stays as it was, so after all pairs a source is off its target by at most one
document; one document is then turned over to make up for most of that. Blocks of BLOCK open documents are folded in parallel, the one document that each leaves open meets those of
other blocks at the next level, and the last of a source is settled by its own draw.

Draws are hashes of the pair's ids, blocks are hashes of the id: reruns agree, whatever the partitions. Rows that
repeat (doc_id, source, size) are one unit that is settled together, its mass being all of them. A null text has size
0; documents of size 0 take nothing. Null sources are a source of their own, the last; null ids are allowed. An empty
table, or one without a word, takes nothing. Extra columns are kept by `mix` and ignored by `takes`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: Open documents that one fold takes; a level leaves at most one document of each fold open.
BLOCK, WEIGHTS, CAP, SEED = 256, (1.0, 2.0, 3.0), 3.0, 17


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, cap: float = CAP) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources by code point, null last.

    The share of all sizes goes out by weight; a target stops at cap times its source's size, and the excess is shared
    again until none is above. Ranks and sums are per range of sources, so many sources need no single task; each
    round of sharing is one aggregation over the written sources, and ends when no source joins those at their cap.
    """
    ranged = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).repartitionByRange(F.col("source").asc_nulls_last())
    ranged = written(ranged.withColumn("part", F.spark_partition_id()), "sources")
    # partitions: a bounded number of rows
    before = ranged.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) + F.col("before") - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    found = written(ranged.join(F.broadcast(before.drop("count")), "part").select("source", "source_size", weight.alias("weight")), "weights")
    top = F.lit(float(cap)) * F.col("source_size")
    total = float(found.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = None, -1
    while True:
        at_cap = F.lit(False) if level is None else top <= F.lit(level) * F.col("weight")
        n, held, open_weight = found.agg(F.sum(at_cap.cast("long")), F.sum(F.when(at_cap, top)), F.sum(F.when(~at_cap, F.col("weight")))).first()
        if n == capped or not open_weight or not total:
            break
        capped, level = n, (total - (held or 0.0)) / open_weight
    target = F.lit(0.0) if level is None else F.least(top, F.lit(level) * F.col("weight"))
    return found.select("source", "source_size", target.cast("double").alias("target"))


def _fold(units: Column) -> Column:
    """array<struct<unit, mass, p>> folded in order: struct<open struct<unit, mass, p>, done array<struct<unit, more>>>."""
    item = "struct<unit:struct<doc_id:bigint,source:string,size:bigint>,mass:double,p:double>"
    start = F.struct(F.lit(None).cast(item).alias("open"), F.array().cast("array<struct<unit:struct<doc_id:bigint,source:string,size:bigint>,more:int>>").alias("done"))

    def pair(a: Column, x: Column) -> Column:
        o = a["open"]
        gain = F.least((1 - o["p"]) * o["mass"], x["p"] * x["mass"])  # the open one takes this much
        loss = F.least(o["p"] * o["mass"], (1 - x["p"]) * x["mass"])  # or gives this much
        draw = F.pmod(F.xxhash64(F.lit(SEED), o["unit"], x["unit"]), F.lit(1 << 52)) / F.lit(float(1 << 52))
        up = draw * (gain + loss) < loss
        moved = F.when(up, gain).otherwise(-loss)
        # which of the two is settled follows from which bound was the smaller, not from rounded sums
        first = F.when(up, (1 - o["p"]) * o["mass"] <= x["p"] * x["mass"]).otherwise(o["p"] * o["mass"] <= (1 - x["p"]) * x["mass"])
        stays = F.when(first, F.struct(x["unit"].alias("unit"), x["mass"].alias("mass"), (x["p"] - moved / x["mass"]).alias("p"))).otherwise(
            F.struct(o["unit"].alias("unit"), o["mass"].alias("mass"), (o["p"] + moved / o["mass"]).alias("p"))
        )
        # the open one ends at 1 when it gained and at 0 when it gave; the other the other way about
        settled = F.struct(F.when(first, o["unit"]).otherwise(x["unit"]).alias("unit"), F.when(first == up, F.lit(1)).otherwise(F.lit(0)).alias("more"))
        return F.struct(stays.alias("open"), F.concat(a["done"], F.array(settled)).alias("done"))

    return F.aggregate(units, start, lambda a, x: F.when(a["open"].isNull(), F.struct(x.alias("open"), a["done"].alias("done"))).otherwise(pair(a, x)))


def takes(sized: DataFrame, weights=WEIGHTS, share: float = 1.0, cap: float = CAP) -> DataFrame:
    """(doc_id, source, size, n, source_size, target, copies): a row for each unit of n equal rows of sized (doc_id, source, size)."""
    units = written(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "units")
    goal = targets(units.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, cap).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    with_goal = units.join(goal, units["source"].eqNullSafe(goal["_source"])).drop("_source").withColumn("rate", F.least(rate, F.lit(float(cap))))
    base = with_goal.withColumn("base", F.when(F.col("size") > 0, F.floor("rate").cast("int")).otherwise(F.lit(0))).withColumn("p", F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(F.lit(0.0)))
    base = written(base, "rates")
    unit = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("size").alias("size"))
    level = base.filter((F.col("p") > 0) & (F.col("p") < 1)).select(unit.alias("unit"), (F.col("size") * F.col("n")).cast("double").alias("mass"), "p")
    most = level.groupBy("unit.source").count().agg(F.max("count")).first()[0] or 0
    done, k = [], 0
    while most:
        # a block per BLOCK units of the largest source: smaller sources have smaller blocks, never more of them
        blocks = -(-most // BLOCK)
        block = F.pmod(F.xxhash64(F.lit(SEED + k), "unit"), F.lit(blocks))
        folded = level.groupBy(F.col("unit.source").alias("source"), block.alias("block")).agg(_fold(F.array_sort(F.collect_list(F.struct("unit", "mass", "p")))).alias("folded"))
        folded = written(folded.select("folded.open", "folded.done"), "folded")
        done.append(folded.select(F.explode("done").alias("d")).select("d.unit", "d.more"))
        level, k = folded.select("open.unit", "open.mass", "open.p"), k + 1
        if blocks == 1:
            draw = F.pmod(F.xxhash64(F.lit(SEED), "unit"), F.lit(1 << 52)) / F.lit(float(1 << 52))
            done.append(level.select("unit", (draw < F.col("p")).cast("int").alias("more")))
            break
        most = min(most - 1, blocks)
    if not done:
        return base.select("doc_id", "source", "size", "n", "source_size", "target", F.col("base").alias("copies"))
    more = done[0]
    for d in done[1:]:
        more = more.unionByName(d)
    more = more.select(F.col("unit.doc_id").alias("_d"), F.col("unit.source").alias("_s"), F.col("unit.size").alias("_z"), "more")
    same = base["doc_id"].eqNullSafe(more["_d"]) & base["source"].eqNullSafe(more["_s"]) & (base["size"] == more["_z"])
    rounded = written(base.join(more, same, "left").select("doc_id", "source", "size", "n", "source_size", "target", "base", F.coalesce("more", F.lit(0)).alias("more"), ((F.col("p") > 0) & (F.col("p") < 1)).alias("free")), "rounded")
    taken = rounded.groupBy("source").agg((F.first("target") - F.sum((F.col("base") + F.col("more")) * F.col("size") * F.col("n"))).alias("off")).withColumnRenamed("source", "_source")
    # the last draw of a source leaves up to one document too much or too little: the document that makes up for most of
    # it is settled the other way, so every document still has the whole part of its rate in copies, or one more
    free = rounded.filter("free").join(taken, rounded["source"].eqNullSafe(taken["_source"]))
    gap = F.abs(F.abs("off") - F.col("size") * F.col("n"))
    free = free.filter((F.col("more") == F.when(F.col("off") > 0, 0).otherwise(1)) & (gap < F.abs("off")))
    turned = free.groupBy("_source").agg(F.min(F.struct(gap.alias("gap"), "size", "doc_id", "n")).alias("t")).select("_source", F.col("t.doc_id").alias("_d"), F.col("t.size").alias("_z"))
    turned = written(turned, "turned")
    here = rounded["source"].eqNullSafe(turned["_source"]) & rounded["doc_id"].eqNullSafe(turned["_d"]) & (rounded["size"] == turned["_z"])
    more = F.when(F.col("_z").isNotNull(), 1 - F.col("more")).otherwise(F.col("more"))
    return rounded.join(turned, here, "left").select("doc_id", "source", "size", "n", "source_size", "target", (F.col("base") + more).alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs with every row as often as the mix takes it (0 to 3 times), columns as they were, whatever their names."""
    names = docs.columns
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    doc_id, source, text = (f"c{names.index(c)}" for c in ("doc_id", "source", "text"))
    sized = rows.withColumn("size", n_words(text))
    took = takes(sized.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), "size"), **how)
    took = took.filter("copies > 0").select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "copies")
    same = sized[doc_id].eqNullSafe(took["_d"]) & sized[source].eqNullSafe(took["_s"]) & (sized["size"] == took["_z"])
    copies = sized.join(took, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copies.select(*rows.columns).toDF(*names)
