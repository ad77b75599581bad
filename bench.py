"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from textquarry.operators import index as indexes
from textquarry.operators.measure import query_words
from textquarry.operators.search import search, search_batch
from textquarry.plans.retrieval import corpus
from textquarry.sources import store

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-")
    seconds, extra = {}, {}

    def timed(name, action, warm=1, times=3):
        for _ in range(warm):
            action()
        took = []
        for _ in range(times):
            began = time.perf_counter()
            action()
            took.append(time.perf_counter() - began)
        seconds[name] = round(sorted(took)[len(took) // 2], 3)

    docs = corpus(spark, SF_DIR)
    chars = docs.selectExpr("sum(length(text)) c", "count(*) n").first()

    def build():
        # read, normalise, finalize: all four tables are made and held, none is written
        built = indexes.build(docs).cached()
        for made in (built.postings, built.docs, built.terms, built.stats):
            made.write.format("noop").mode("overwrite").save()
        built.dropped()

    timed("index_build", build)
    timed("index_save", lambda: store.save(indexes.build(docs), f"{folder}/index"), warm=0, times=1)
    index = store.load(spark, f"{folder}/index").cached()
    timed("search_term", lambda: search(index, "tion").collect(), times=5)
    timed("search_or", lambda: search(index, "tion ther").collect(), times=5)
    timed("search_and", lambda: search(index, "tion AND ther").collect(), times=5)
    timed("search_phrase", lambda: search(index, '"anea eriner thanea"').collect(), times=5)
    words = query_words(index, 1000)
    timed("search_batch_1000", lambda: search_batch(index, dict(enumerate(words))).write.format("noop").mode("overwrite").save())
    extra["build_docs_per_s"] = round(chars["n"] / seconds["index_build"])
    extra["build_chars_per_s"] = round(chars["c"] / seconds["index_build"])
    extra["batch_queries_per_s"] = round(1000 / seconds["search_batch_1000"])
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "sum of headline query seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), **extra}))


if __name__ == "__main__":
    main()
