"""Command line: build, query and interactive modes over an index folder."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .functions.stopwords import DEFAULT
from .operators import index as indexes
from .operators.search import Cache, Config, search_cached
from .plans.query import parse
from .sources import ingest, store


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="textquarry", description=__doc__, allow_abbrev=False)
    p.add_argument("--corpus", default="", help="a JSON lines file, or a folder of text files")
    p.add_argument("--index", default="index", help="the folder of the index")
    p.add_argument("--stopwords", default="", help="a file with a word per line; the default list if not given")
    p.add_argument("--mode", default="interactive", help="build, query or interactive (any other counts as interactive)")
    p.add_argument("--query", default="")
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--k1", type=float, default=1.2)
    p.add_argument("--b", type=float, default=0.75)
    p.add_argument("--cache-size", type=int, default=1024)
    return p.parse_args(argv)


def is_directory(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def build(spark: SparkSession, a: argparse.Namespace) -> indexes.Index:
    words = ingest.read_stopwords(spark, a.stopwords) if a.stopwords else DEFAULT
    corpus = ingest.read_directory(spark, a.corpus) if is_directory(spark, a.corpus) else ingest.read_jsonl(spark, a.corpus)
    store.save(indexes.build(corpus, words), a.index)
    return store.load(spark, a.index)


def shown(rows: list) -> str:
    lines = [f"  {i}. [{r['doc_id']}] {r['title']}  (score: {r['score']:.4f})" for i, r in enumerate(rows, 1)]
    return "\n".join(lines or ["  (no results)"])


def main(argv: list[str] | None = None, spark: SparkSession | None = None, lines=None, out=print) -> int:
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("textquarry").getOrCreate()
    config, cache = Config(a.top_k, a.k1, a.b), Cache(a.cache_size)
    if a.mode == "build":
        if not a.corpus:
            out("build needs --corpus")
            return 1
        began = time.perf_counter()
        found = build(spark, a).summary()
        out(f"documents {found['docs_indexed']}, terms {found['vocab_size']}, postings {found['total_postings']}, {1000 * (time.perf_counter() - began):.0f} ms")
        return 0
    if store.exists(spark, a.index):
        index = store.load(spark, a.index)
    elif a.corpus:
        index = build(spark, a)
    else:
        out("no index, and no --corpus to build one from")
        return 1
    if a.mode == "query":
        if parse(a.query) is None:
            out("a blank query")
            return 1
        out(shown(search_cached(index, a.query, config, cache)))
        return 0
    index = index.cached()
    for line in lines if lines is not None else sys.stdin:
        if not line.strip():
            break
        began = time.perf_counter()
        rows = search_cached(index, line.rstrip("\n"), config, cache)
        out(shown(rows))
        out(f"  {1000 * (time.perf_counter() - began):.1f} ms, cache {cache.hits} hits, {cache.misses} misses")
    return 0


if __name__ == "__main__":
    sys.exit(main())
