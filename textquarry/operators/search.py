"""Ranked retrieval: a query tree becomes one lazy DataFrame of one scan, one aggregation and one top-k."""

from __future__ import annotations

from collections import Counter, OrderedDict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.query import And, Node, Not, Or, Phrase, Term, all_terms, has_phrase, parse, scoring_terms
from .index import Index
from .numbering import numbered

#: Up to here each task keeps its best in a heap and the driver's plan merges them; larger results are ranked by ranges.
HEAP = 10_000
#: Words of a batch of queries that are sent to all tasks.
WORDS = 100_000
RESULT = "rank int, doc_id long, score double, title string"


@dataclass(frozen=True)
class Config:
    top_k: int = 10
    k1: float = 1.2
    b: float = 0.75


def bm25(tf: Column, idf: Column, length: Column, avgdl: Column, c: Config) -> Column:
    return idf * tf * (c.k1 + 1) / (tf + c.k1 * (1 - c.b) + c.k1 * c.b * length / F.greatest(avgdl, F.lit(1.0)))


def _condition(node: Node, flag: dict[str, Column], positions: Column | None) -> Column:
    """The tree over per-document flags; a phrase also over the map of positions."""
    match node:
        case Term(t):
            return flag[t]
        case And(a, b):
            return _condition(a, flag, positions) & _condition(b, flag, positions)
        case Or(a, b):
            return _condition(a, flag, positions) | _condition(b, flag, positions)
        case Not(a, b):
            return _condition(a, flag, positions) & ~_condition(b, flag, positions)
        case Phrase(()):
            return F.lit(False)
        case Phrase((t,)):
            return flag[t]
        case Phrase(ts):
            present = reduce(lambda x, y: x & y, (flag[t] for t in dict.fromkeys(ts)))
            at = lambda t: F.element_at(positions, F.lit(t))
            follows = F.exists(at(ts[0]), lambda p: reduce(lambda x, y: x & y, (F.array_contains(at(t), (p + i).cast("int")) for i, t in enumerate(ts) if i)))
            return present & F.coalesce(follows, F.lit(False))


def _avgdl(index: Index) -> DataFrame:
    return F.broadcast(index.stats.select("avg_doc_length"))  # one row


def _in_order(parts: list[Column]) -> Column:
    """Their sum, from the left: equal documents get equal scores, whatever the order that rows came in."""
    return reduce(lambda x, y: x + y, parts)


def matches(index: Index, node: Node, config: Config = Config()) -> DataFrame:
    """(doc_id, score) of every document that the tree admits, whatever its score.

    Any match holds a term of the tree, since NOT has a left side, so the postings of the tree's terms are all that is
    read: positions only for phrases. Every scoring term counts on every admitted document.
    """
    terms, times = sorted(all_terms(node)), scoring_terms(node)
    index = index.restricted(terms)
    phrase = has_phrase(node)
    rows = index.postings.filter(F.col("term").isin(terms)).select("term", "doc_id", "tf", "length", *(["positions"] if phrase else []))
    # as many rows as the query has words
    idfs = index.terms.filter(F.col("term").isin(terms)).select("term", F.col("idf").cast("double").alias("idf"))
    scored = rows.join(F.broadcast(idfs), "term").crossJoin(_avgdl(index))
    one = bm25(F.col("tf"), F.col("idf"), F.col("length"), F.col("avg_doc_length"), config)
    # a document has one posting of a term at most
    of = {t: f"w{i}" for i, t in enumerate(terms)}
    aggs = [F.max(F.when(F.col("term") == t, float(times[t]) * one)).alias(w) for t, w in of.items()]
    if phrase:
        aggs.append(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    found = scored.groupBy("doc_id").agg(*aggs)
    keep = _condition(node, {t: F.col(w).isNotNull() for t, w in of.items()}, F.col("at") if phrase else None)
    return found.filter(keep).select("doc_id", _in_order([F.coalesce(w, F.lit(0.0)) for w in of.values()]).alias("score"))


def execute(index: Index, node: Node | None, config: Config = Config()) -> DataFrame:
    """(rank, doc_id, score, title): the top_k best, ties by doc_id; none for top_k <= 0. Scores are shown to 6 places.

    On a saved index the best are found at once, and only their titles are read: docs is sorted by doc_id.
    """
    spark = index.docs.sparkSession
    if node is None or config.top_k <= 0:
        return spark.createDataFrame([], RESULT)
    index = index.restricted(all_terms(node))
    top = matches(index, node, config).filter(F.col("score") > 0)
    order = (F.desc("score"), F.col("doc_id"))
    shown = ("rank", "doc_id", F.round("score", 6).alias("score"), "title")
    if config.top_k > HEAP:
        ranked = numbered(top, "rank", *order).withColumn("rank", (F.col("rank") + 1).cast("int")).filter(F.col("rank") <= config.top_k)
        return index.docs.select("doc_id", "title").join(ranked, "doc_id").select(*shown)
    best = top.orderBy(*order).limit(config.top_k)
    if index.name:
        rows = [(i, r["doc_id"], r["score"]) for i, r in enumerate(best.collect(), 1)]  # top_k rows, HEAP at most
        titles = index.docs.filter(F.col("doc_id").isin([d for _, d, _ in rows])).select("doc_id", "title")
        return titles.join(F.broadcast(spark.createDataFrame(rows, "rank int, doc_id long, score double")), "doc_id").select(*shown)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return index.docs.select("doc_id", "title").join(F.broadcast(ranked), "doc_id").select(*shown)


def search(index: Index, query: str, config: Config = Config()) -> DataFrame:
    return execute(index, parse(query), config)


def score_document(index: Index, terms: list[str], doc_id: int, config: Config = Config()) -> DataFrame:
    """(doc_id, score): one document's score for a list of terms; 0 where nothing is found."""
    times = Counter(terms)
    index = index.restricted(times)
    spark = index.docs.sparkSession
    weights = F.broadcast(spark.createDataFrame([(t, float(n)) for t, n in times.items()], "term string, times double"))
    rows = index.postings.filter((F.col("doc_id") == doc_id) & F.col("term").isin(list(times))).join(weights, "term").join(F.broadcast(index.terms.filter(F.col("term").isin(list(times)))), "term")
    one = F.col("times") * bm25(F.col("tf"), F.col("idf").cast("double"), F.col("length"), F.col("avg_doc_length"), config)
    return rows.crossJoin(_avgdl(index)).agg(F.coalesce(F.round(F.sum(one), 6), F.lit(0.0)).alias("score")).select(F.lit(doc_id).cast("long").alias("doc_id"), "score")


def search_batch(index: Index, queries: list[tuple[int, str]] | dict[int, str], config: Config = Config()) -> DataFrame:
    """(query_id, rank, doc_id, score, title) of many queries in one job: one scan of the postings for all of them.

    A row per query, document and term is aggregated to a row per query and document, map-side first. Trees are
    grouped by shape: queries whose trees are alike but for their words share one condition, so the plan grows with
    the number of shapes, not with the number of queries. Phrases carry their positions.
    """
    spark = index.docs.sparkSession
    trees = [(i, n) for i, q in sorted(dict(queries).items()) if (n := parse(q)) is not None]
    if not trees or config.top_k <= 0:
        return spark.createDataFrame([], "query_id long, " + RESULT)
    shapes: dict[str, tuple[int, Node]] = {}
    rows = []
    for i, node in trees:
        slots = {t: f"s{j}" for j, t in enumerate(sorted(all_terms(node)))}
        shape = _shape(node, slots)
        k, _ = shapes.setdefault(repr(shape), (len(shapes), shape))
        times = scoring_terms(node)
        rows += [(i, k, int(slot[1:]), t, float(times[t])) for t, slot in slots.items()]
    if not rows:
        return spark.createDataFrame([], "query_id long, " + RESULT)
    index = index.restricted(r[3] for r in rows)
    most = max(r[2] for r in rows) + 1
    wanted = spark.createDataFrame(rows, "query_id long, shape int, slot int, term string, times double")  # the queries' words
    phrase = any(has_phrase(n) for _, n in shapes.values())
    lists = index.postings.filter(F.col("term").isin(sorted({r[3] for r in rows}))) if len(rows) <= 5000 else index.postings
    lists = lists.select("term", "doc_id", "tf", "length", *(["positions"] if phrase else []))
    wanted = wanted.join(index.terms.select("term", F.col("idf").cast("double").alias("idf")), "term")
    # a row per query and word: broadcast up to WORDS of them, else joined by its own size
    scored = lists.join(F.broadcast(wanted) if len(rows) <= WORDS else wanted, "term").crossJoin(_avgdl(index))
    one = F.col("times") * bm25(F.col("tf"), F.col("idf"), F.col("length"), F.col("avg_doc_length"), config)
    aggs = [F.max(F.when(F.col("slot") == j, one)).alias(f"w{j}") for j in range(most)]
    if phrase:
        aggs.append(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("s"), F.col("slot")).alias("slot"), "positions"))).alias("at"))
    found = scored.groupBy("query_id", "shape", "doc_id").agg(*aggs)
    flag = {f"s{j}": F.col(f"w{j}").isNotNull() for j in range(most)}
    keep = reduce(lambda x, s: x.when(F.col("shape") == s[0], _condition(s[1], flag, F.col("at") if phrase else None)), shapes.values(), F.when(F.lit(False), F.lit(False))).otherwise(F.lit(False))
    best = found.filter(keep).select("query_id", "doc_id", _in_order([F.coalesce(f"w{j}", F.lit(0.0)) for j in range(most)]).alias("score")).filter(F.col("score") > 0)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    top = best.withColumn("rank", rank).filter(F.col("rank") <= config.top_k)
    return top.join(index.docs.select("doc_id", "title"), "doc_id").select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"), "title")


def _shape(node: Node, slots: dict[str, str]) -> Node:
    """The tree with slots in place of its words."""
    match node:
        case Term(t):
            return Term(slots[t])
        case Phrase(ts):
            return Phrase(tuple(map(slots.__getitem__, ts)))
        case _:
            return type(node)(_shape(node.left, slots), _shape(node.right, slots))


class Cache:
    """The most recent results, by query, parameters and index; capacity 0 keeps nothing."""

    def __init__(self, capacity: int = 1024):
        self.capacity, self.hits, self.misses = capacity, 0, 0
        self.rows: OrderedDict[tuple, list] = OrderedDict()

    def get(self, key: tuple):
        if key in self.rows:
            self.hits += 1
            self.rows.move_to_end(key)
            return self.rows[key]
        self.misses += 1
        return None

    def put(self, key: tuple, rows: list) -> None:
        if self.capacity <= 0:
            return
        self.rows[key] = rows
        self.rows.move_to_end(key)
        while len(self.rows) > self.capacity:
            self.rows.popitem(last=False)

    def __len__(self) -> int:
        return len(self.rows)

    def clear(self) -> None:
        self.rows.clear()
        self.hits = self.misses = 0


def search_cached(index: Index, query: str, config: Config, cache: Cache) -> list:
    """The result rows (top_k of them) of a query, from the cache if they are there."""
    key = (query, config, index.key)
    rows = cache.get(key)
    if rows is None:
        rows = search(index, query, config).orderBy("rank").collect()  # top_k rows
        cache.put(key, rows)
    return rows
