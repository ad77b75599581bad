"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

1. Per document, in its task: the set of its shingles as 64-bit hashes, a 128-bit digest of the set, and a signature
   of bands x rows values from one hash of each shingle (the least per bin); an empty bin takes the value of a full one that
   its own sequence of hashes finds first. Each band's rows are hashed.
2. Documents with equal sets are one class; its smallest id stands for it from here on.
3. A bucket links its members to its smallest, so m members give m - 1 edges. The components of these edges are
   clusters of candidates: every pair that shares a bucket is in one.
4. Clusters are confirmed on the full sets: blocks of at most about BLOCK documents are compared by an inverted index,
   pair of blocks by pair of blocks, each in its own group, which gives out a spanning forest of the links that it
   finds, never its pairs. In a cluster of several blocks, PIVOTS members meet all others first: links within the largest
   group that this makes change nothing, so only members outside of it then meet all blocks. All links between members of
   a cluster count, whichever buckets they share. A cluster whose members are far from all pivots costs all its pairs.
5. The components of those links are the answer.

Bands and rows follow from the threshold J, so that two sets at it share no band with probability MISS at most: 24 bands
of 6 at 0.85 (op5; (1 - 0.85**6) ** 24 = 1.2e-5), 29 bands of 5 at 0.8 (the pipeline's stage; 1.0e-5).

A null or empty text has no shingles and links with nothing; one of fewer than `size` words has the one shingle of all
its words. Rows with a null id are not linked and not kept; rows that repeat an id with different texts are one node.
An empty table has an empty result. Extra columns are kept by `drop_copies` and ignored by `near_copies`.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import coded_words, filtered_join, mapped, written
from .components import components, least_reachable

MISS, BLOCK, PIVOTS = 1.25e-5, 512, 8
_LOWER = {c: c + 32 for c in range(65, 91)}
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(ws: list[str]) -> np.ndarray:
    """64-bit hashes of words, A-Z as a-z."""
    return np.fromiter((xxhash.xxh3_64_intdigest((w.lower() if w.isascii() else w.translate(_LOWER)).encode()) for w in ws), dtype=np.uint64, count=len(ws))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text, from the hashes of its words."""
    if not len(h):
        return h
    n = min(size, len(h))
    count = len(h) - n + 1
    out = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        out = _mix((out + _M) ^ h[k : k + count])
    return np.unique(out)


def sets_of(texts: pa.Array, size: int):
    """Each text's shingles; different words are hashed once."""
    codes, distinct, ends = coded_words(texts)
    h = word_hashes(distinct)[codes]
    start = 0
    for end in ends.tolist():
        yield shingles(h[start:end], size)
        start = end


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows for a threshold: rows fall with it, and bands are as many as MISS asks for."""
    rows = next(r for least, r in ((85, 6), (75, 5), (60, 4), (40, 3), (20, 2), (0, 1)) if percent >= least)
    j = min(max(percent, 1), 99) / 100
    return math.ceil(math.log(MISS) / math.log(1 - j**rows)), rows


def signature(s: np.ndarray, n: int) -> np.ndarray:
    """n values: the least hash of each bin; empty bins borrow by optimal densification."""
    bins = ((s >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    first = np.concatenate([[0], np.flatnonzero(np.diff(bins)) + 1])  # hashes are sorted, so bins are, too
    out, full = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
    at = bins[first].astype(np.int64)
    out[at], full[at] = s[first], True
    open_, attempt = np.flatnonzero(~full), 0
    values = out.copy()
    while len(open_):
        attempt += 1
        to = (_mix(open_.astype(np.uint64) * np.uint64(n + 1) + np.full(1, attempt, dtype=np.uint64) * _M) % np.uint64(n)).astype(np.int64)
        hit = full[to]
        out[open_[hit]] = values[to[hit]]
        open_ = open_[~hit]
    return out


def bands(s: np.ndarray, n: int, size: int) -> np.ndarray:
    rows = signature(s, n * size).reshape(n, size)
    out = np.arange(1, n + 1, dtype=np.uint64)
    for k in range(size):
        out = _mix((out + _M) ^ rows[:, k])
    return out.view(np.int64)


def sketch(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_hash binary, bands array<long> (none for an empty set)."""
    n_bands, rows = banding(percent)

    def work(batches):
        for batch in batches:
            n, sets, found = [], [], []
            for s in sets_of(batch.column("text"), size):
                n.append(len(s))
                sets.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                found.append(bands(s, n_bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_hash", "bands"])

    return mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), work, "doc_id long, n_shingles long, set_hash binary, bands array<long>", "minhash")


def _links(left: list[np.ndarray], right: list[np.ndarray], same: bool, percent: int):
    """Arrays (i, j) of pairs with 100 * intersection >= percent * union; only j > i if both sides are the same."""
    sizes = np.array([len(s) for s in right])
    owner = np.repeat(np.arange(len(right)), sizes)
    flat = np.concatenate(right)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    lefts, found = [], []
    for i, s in enumerate(left):
        low, high = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        n = high - low
        total = int(n.sum())
        if not total:
            continue
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        common = np.bincount(owner[at], minlength=len(right))
        hit = np.flatnonzero(100 * common >= percent * (len(s) + sizes - common))
        found.append(hit[hit > i] if same else hit)
        lefts.append(np.full(len(found[-1]), i))
    return np.concatenate(lefts or [np.empty(0, dtype=np.int64)]), np.concatenate(found or [np.empty(0, dtype=np.int64)])


def confirm(members: DataFrame, size: int, percent: int, parts: int) -> DataFrame:
    """Edges (u, v) that span the links of members (cluster, a, b, side, doc_id, text): groups are pairs of blocks."""

    def work(batches):
        def spanning(same, left, right):
            left, right = (left, left) if same else (left, right)
            if not left or not right:
                return []
            i, j = _links([s for _, s in left], [s for _, s in right], same, percent)
            ids, number = np.unique([d for d, _ in [*left, *right]], return_inverse=True)
            root = least_reachable(len(ids), number[: len(left)][i], number[-len(right) :][j])
            return [(n, r) for n, r in zip(ids.tolist(), ids[root].tolist(), strict=True) if n != r]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.int64())], ["u", "v"])

        key, sides, out = None, ([], []), []
        for batch in batches:
            for c, a, b, side, doc, s in zip(*(batch.column(x).to_pylist() for x in ("cluster", "a", "b", "side", "doc_id")), sets_of(batch.column("text"), size), strict=True):
                if (c, a, b) != key:
                    if key:
                        out += spanning(key[1] == key[2], *sides)
                    key, sides = (c, a, b), ([], [])
                    if len(out) > 4096:
                        yield batch_of(out)
                        out = []
                sides[side].append((doc, s))
        if key:
            out += spanning(key[1] == key[2], *sides)
        yield batch_of(out)

    return mapped(members.repartition(parts, "cluster", "a", "b").sortWithinPartitions("cluster", "a", "b", "side", "doc_id"), work, "u long, v long", "minhash")


def near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text).

    size: words of a shingle; percent: of the union that the intersection of linked sets has, at least.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketched = written(sketch(docs, size, percent), "sketches")
    # classes of equal sets; equal sets have equal bands
    full = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(full.groupBy("set_hash").agg(F.min("doc_id").alias("rep")), "classes")
    of_rep = full.join(classes, (full["doc_id"] == classes["rep"]) & (full["set_hash"] == classes["set_hash"]), "left_semi")
    buckets = of_rep.select("doc_id", F.explode("bands").alias("bucket")).distinct()
    center = buckets.groupBy("bucket").agg(F.min("doc_id").alias("center"), F.count("*").alias("n")).filter("n > 1").drop("n")
    star = buckets.join(center, "bucket").filter(F.col("doc_id") != F.col("center")).select(F.col("doc_id").alias("u"), F.col("center").alias("v"))
    clusters = written(components(star), "clusters")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    labels = components(written(confirmed(texts, clusters, size, percent, parts), "confirmed"))
    # nodes are the classes' smallest ids; every row finds its class by its set
    by_set = classes.join(labels, classes["rep"] == labels["node"], "left").select(F.col("set_hash").alias("_set"), F.coalesce("component", "rep").alias("_component"))
    by_set = written(by_set, "by-set")
    # rows without a set have no class, and would all be one key of the join
    some = sketched.filter("n_shingles > 0").join(by_set, F.col("set_hash") == F.col("_set"), "left").select("doc_id", "n_shingles", "_component")
    none = sketched.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("_component"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("_component"))
    return some.unionByName(none).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def confirmed(texts: DataFrame, clusters: DataFrame, size: int, percent: int, parts: int) -> DataFrame:
    """Edges (u, v) that span all links between members of a cluster, of texts (doc_id, text) and clusters (node, component)."""
    spark = texts.sparkSession
    sizes = clusters.groupBy("component").agg(F.count("*").alias("members")).withColumnRenamed("component", "cluster")
    placed = clusters.join(sizes, F.col("component") == F.col("cluster")).select(F.col("node").alias("id"), "cluster", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    placed = written(placed.withColumn("block", _block("id", "blocks")), "blocks")

    def members(wanted: DataFrame) -> DataFrame:
        """The texts of wanted (id, cluster, pairs): a row for each pair of blocks that a text is in."""
        wanted = written(wanted.select("id", "cluster", "pairs"), "pairs")
        # texts outside of all clusters, nearly all of them, are held back before the shuffle
        with filtered_join(spark, wanted.count()):
            found = texts.join(wanted, texts["doc_id"] == wanted["id"]).select("cluster", "doc_id", "text", F.explode("pairs").alias("p"))
            return written(confirm(found.select("cluster", "p.a", "p.b", "p.side", "doc_id", "text"), size, percent, parts), "links")

    pair = lambda a, b, side: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(side).alias("side"))
    links = members(placed.filter("blocks = 1").withColumn("pairs", F.array(pair(F.lit(0), F.lit(0), 0))))
    large = placed.filter("blocks > 1")
    if large.isEmpty():
        return links
    # PIVOTS members of a large cluster, by a hash of their ids, meet all of its blocks: each text moves once, a pivot once per block
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("id"), "id"))
    pivot = large.withColumn("rank", rank).filter(F.col("rank") <= PIVOTS)
    as_pivot = pivot.withColumn("pairs", F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: pair(F.lit(-1), k, 0)))
    as_member = large.withColumn("pairs", F.array(pair(F.lit(-1), F.col("block"), 1)))
    near = members(as_pivot.select("id", "cluster", "pairs").unionByName(as_member.select("id", "cluster", "pairs")))
    # links within the largest group of a cluster change nothing; of all others one end at least is outside of it
    groups = large.join(components(near), F.col("id") == F.col("node"), "left").select("id", "cluster", "blocks", "block", F.coalesce("component", "id").alias("group"))
    groups = written(groups, "pivot-groups")
    largest = groups.groupBy("cluster", "group").count().groupBy("cluster").agg(F.max_by("group", F.struct("count", "group")).alias("_largest")).withColumnRenamed("cluster", "_cluster")
    apart = groups.join(written(largest, "largest"), F.col("cluster") == F.col("_cluster")).filter(F.col("group") != F.col("_largest")).select("id", "cluster", "blocks")
    apart = written(apart, "apart")
    counts = written(apart.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("others")).withColumnRenamed("cluster", "_cluster"), "apart-blocks")
    # those outside, in blocks of their own numbered -1, -2, .., meet all blocks of the cluster
    outside = apart.join(counts, F.col("cluster") == F.col("_cluster")).withColumn("own", _block("id", "others"))
    outside = outside.withColumn("pairs", F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: pair(-1 - F.col("own"), k, 0)))
    inside = large.join(counts, F.col("cluster") == F.col("_cluster")).withColumn("pairs", F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda k: pair(-1 - k, F.col("block"), 1)))
    far = members(outside.select("id", "cluster", "pairs").unionByName(inside.select("id", "cluster", "pairs")))
    return links.unionByName(near).unionByName(far)


def _block(of: str, blocks: str):
    return F.pmod(F.xxhash64(of), F.col(blocks).cast("long")).cast("int")


def drop_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with exactly one row of each group, its columns as they were: the one of the smallest id, null ids last.

    Groups are of rows, told apart by numbers of their own, so repeated ids and null ids are like any others.
    """
    names = docs.columns
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    doc_id, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    ids = rows.select("row", F.col(doc_id).cast("long").alias("id"))
    groups = near_copies(rows.select(F.col("row").alias("doc_id"), F.col(text).alias("text")), size, percent).select(F.col("doc_id").alias("_of"), "component_id")
    placed = written(groups.join(ids, groups["_of"] == ids["row"]).select("row", "id", "component_id"), "row-groups")
    stays = placed.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")).select(F.col("first.row").alias("_stays"))
    dropped = written(placed.join(stays, placed["row"] == stays["_stays"], "left_anti").select(F.col("row").alias("_dropped")), "dropped")
    return rows.join(dropped, rows["row"] == dropped["_dropped"], "left_anti").drop("row").toDF(*names)
