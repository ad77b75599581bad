"""Saved indexes: four Parquet tables below one folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analyse import ROWS, analysed, ranged
from ..operators.index import FORMAT_VERSION, Index, from_postings, from_rows

SCHEMAS = {
    "docs": "doc_id long, length int, title string", "postings": "term string, doc_id long, tf int, positions array<int>, length int", "terms": "term string, df long, idf double",
    "stats": "num_docs long, avg_doc_length double, format_version int",
}


#: Tokens of a range of postings, documents that ranges are found from, and their postings that the driver sees per range.
RANGE, TRIED, SEEN = 2_000_000, 4096, 48


def save(index: Index, path: str) -> None:
    """Postings and terms are cut into ranges and sorted, so a term's filter skips all but its row groups; docs by their ids.

    Ranges of (term, doc_id) split a term that many documents hold. Those of a corpus that is not cached are known before
    its postings are made, so a posting moves once and is written once; what else docs and postings are made of is
    written first, and the ranges are sampled from that. stats comes last: without it there is no index.
    """
    spark = index.docs.sparkSession
    removed(spark, f"{path}/stats")
    if index.source is not None:
        corpus, stopwords = index.source
        index.docs.write.mode("overwrite").parquet(f"{path}/_rows")
        docs = spark.read.schema(SCHEMAS["docs"]).parquet(f"{path}/_rows")
        bounds = _bounds(corpus, stopwords, docs)
        lists = ranged(corpus, bounds, stopwords).repartitionById(len(bounds) + 1, "part").drop("part")
    else:
        if index.rows is not None:
            index.rows.write.mode("overwrite").parquet(f"{path}/_rows")
            index = from_rows(spark.read.schema(ROWS).parquet(f"{path}/_rows"))
        docs, lists = index.docs, index.postings.repartitionByRange("term", "doc_id")
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/docs")
    lists.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    made = from_postings(*(spark.read.schema(SCHEMAS[t]).parquet(f"{path}/{t}") for t in ("docs", "postings")))
    made.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    made.stats.select("num_docs", "avg_doc_length", F.lit(FORMAT_VERSION).alias("format_version")).write.mode("overwrite").parquet(f"{path}/stats")
    removed(spark, f"{path}/_rows")


def _bounds(corpus: DataFrame, stopwords: frozenset[str], docs: DataFrame) -> list[tuple[str, int]]:
    """Sorted (term, doc_id) that cut the postings of corpus into ranges of about RANGE tokens: from TRIED documents, or all of few.

    Only where ranges begin depends on these documents; every posting goes into one of them.
    """
    count = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
    every, pieces = max(1, count["docs"] // TRIED), -(-count["tokens"] // RANGE)
    if pieces < 2:
        return []
    some = corpus.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    thin = max(1, count["tokens"] // every // (SEEN * pieces))
    lists = analysed(some, stopwords).filter("term IS NOT NULL").filter(F.pmod(F.xxhash64("doc_id", "term"), F.lit(thin)) == 0)
    found = sorted((r["term"], r["doc_id"], r["tf"]) for r in lists.select("term", "doc_id", "tf").collect())  # SEEN a range, about
    # a posting weighs as much as its row's columns and positions
    weights = np.cumsum([16 + n for _, _, n in found])
    at = np.searchsorted(weights, weights[-1] * np.arange(1, pieces) / pieces) if found else []
    return sorted({found[i][:2] for i in at})


def load(spark: SparkSession, path: str) -> Index:
    tables = {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()}
    version = tables["stats"].first()
    if version is None or version["format_version"] != FORMAT_VERSION:
        raise ValueError(f"{path} is not an index of format {FORMAT_VERSION}")
    return Index(tables["docs"], tables["postings"], tables["terms"], tables["stats"], path)


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _at(spark, f"{path}/stats")
    return store.exists(at)


def removed(spark: SparkSession, path: str) -> None:
    store, at = _at(spark, path)
    store.delete(at, True)
