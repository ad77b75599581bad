import math

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as driver
from tests.compare import same_as_sql
from textquarry import cli
from textquarry.functions import analyse
from textquarry.operators.index import Index, build, from_postings
from textquarry.operators.measure import percentiles, timed
from textquarry.operators.search import Cache, Config, execute, score_document, search, search_batch, search_cached
from textquarry.plans import retrieval
from textquarry.plans.query import And, Not, Term
from textquarry.sources import ingest, store
from textquarry.streaming import ingest as ingest_stream

SF = "/root/testdata/sf0.001"
DOCS, LISTS = "doc_id long, length int, title string", "term string, doc_id long, tf int, positions array<int>"


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame([(0, 10, "doc about rust"), (1, 15, "doc about python"), (2, 12, "doc about rust and python")], DOCS)
    lists = [("rust", 0, 3, [0, 4, 8]), ("rust", 2, 2, [0, 6]), ("python", 1, 4, [0, 3, 7, 12]), ("python", 2, 1, [3])]
    return from_postings(docs, spark.createDataFrame(lists, LISTS))


def test_ranking(small):
    hits = lambda node: [(r["doc_id"], r["score"]) for r in execute(small, node).orderBy("rank").collect()]
    assert hits(Term("rust")) == [(0, pytest.approx(0.769785, abs=2e-6)), (2, pytest.approx(0.651205, abs=2e-6))]
    assert hits(Term("python"))[0] == (1, pytest.approx(0.766699, abs=2e-6))
    assert hits(And(Term("rust"), Term("python"))) == [(2, pytest.approx(1.126463, abs=2e-6))]
    assert hits(Not(Term("rust"), Term("python"))) == [(0, pytest.approx(0.769785, abs=2e-6))]
    assert hits(None) == [] and execute(small, Term("rust"), Config(top_k=0)).count() == 0
    assert score_document(small, ["rust"], 1).first()["score"] == 0.0


def test_batch_is_single_queries(spark):
    index = build(ingest.from_table(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")).cached()
    words = [r[0] for r in index.terms.orderBy("df", ascending=False).limit(5).collect()]
    asked = {0: words[0], 1: f"{words[0]} {words[1]}", 2: f"{words[2]} AND {words[3]}", 3: f"{words[1]} NOT {words[4]}", 4: "", 5: "the"}
    batch = {(r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in search_batch(index, asked).collect()}
    assert batch == {(i, r["rank"], r["doc_id"], r["score"]) for i, q in asked.items() for r in search(index, q).collect()}
    cache = Cache(2)
    assert search_cached(index, words[0], Config(), cache) == search_cached(index, words[0], Config(), cache) and cache.hits == 1


def test_terms_of_all_documents_still_rank(spark):
    """20 million documents, all with the term: its idf is below half a millionth, and the order is that of the scores."""
    n = 20_000_000
    docs = spark.createDataFrame([(i, 10 + i, f"d{i}") for i in range(5)], DOCS)
    lists = spark.createDataFrame([("rust", i, 1 + (i == 3), [0]) for i in range(5)], LISTS)
    made = from_postings(docs, lists)
    terms = spark.createDataFrame([("rust", n, math.log(0.5 / (n + 0.5) + 1))], "term string, df long, idf double")
    stats = spark.createDataFrame([(n, 12.0, 2)], "num_docs long, avg_doc_length double, format_version int")
    index = Index(made.docs, made.postings, terms, stats)
    assert 0 < terms.first()["idf"] < 5e-7
    assert [r["doc_id"] for r in search(index, "rust").orderBy("rank").collect()] == [3, 0, 1, 2, 4]
    assert [r["doc_id"] for r in search_batch(index, {0: "rust"}).orderBy("rank").collect()] == [3, 0, 1, 2, 4]


def test_large_results_and_long_queries(spark, small, monkeypatch):
    from textquarry.operators import search as module

    want = [tuple(r) for r in search(small, "rust python").orderBy("rank").collect()]
    monkeypatch.setattr(module, "HEAP", 1)
    assert [tuple(r) for r in search(small, "rust python").orderBy("rank").collect()] == want and len(want) == 3
    words = " ".join(["rust", "python", *(f"word{i}" for i in range(100))])
    monkeypatch.setattr(module, "WORDS", 1)
    assert [tuple(r)[1:] for r in search_batch(small, {7: words}).orderBy("rank").collect()] == [tuple(r) for r in search(small, words).orderBy("rank").collect()] == want
    assert search_batch(small, {1: '""', 2: "  "}).count() == 0


def test_cache(small):
    cache = Cache(2)
    for query, k in (("rust", 10), ("rust", 1), ("rust", 10), ("python", 10), ("rust", 1)):
        assert len(search_cached(small, query, Config(top_k=k), cache)) == min(k, 2)
    # the second result was the oldest when the third came
    assert (cache.hits, cache.misses, len(cache)) == (1, 4, 2)
    again = from_postings(small.docs, small.postings)
    search_cached(again, "rust", Config(top_k=1), cache)
    assert cache.misses == 5  # another index is another key
    cache.clear()
    assert (cache.hits, cache.misses, len(cache)) == (0, 0, 0)
    none = Cache(0)
    search_cached(small, "rust", Config(), none)
    assert len(none) == 0 and none.misses == 1


def test_percentiles():
    assert percentiles([]) == {}
    assert percentiles(list(range(100, 0, -1))) == {"p50": 51, "p95": 96, "p99": 100, "p99.9": 100, "mean": 50.5, "min": 1, "max": 100}
    calls = []
    assert timed(lambda: calls.append(1), 4, 2).keys() >= {"p50", "mean"} and len(calls) == 6


def test_command_line(spark, tmp_path, monkeypatch):
    corpus = f"file://{tmp_path}/c.jsonl"
    (tmp_path / "c.jsonl").write_text('{"id":"a","title":"Rust book","text":"rust is a language"}\n{"id":"b","title":"","text":"python and rust"}\n')
    (tmp_path / "stop.txt").write_text("rust\r\n")
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "x.txt").write_text("only\npython here")

    def run(*argv, lines=None):
        out = []
        code = cli.main([*argv], spark, lines, out.append)
        return code, "\n".join(out)

    index = f"file://{tmp_path}/index"
    assert run("--mode", "build")[0] == 1 and run("--mode", "query", "--query", "rust", "--index", index)[0] == 1
    assert run("--mode", "build", "--corpus", corpus, "--index", index)[1].startswith("documents 2, terms 5, postings 6")
    code, text = run("--mode", "query", "--query", "rust", "--index", index, "--top-k", "1")
    assert code == 0 and text.startswith("  1. [0] Rust book  (score: 0.") and "2." not in text
    assert run("--mode", "query", "--query", "absent", "--index", index)[1] == "  (no results)" and run("--mode", "query", "--query", " ", "--index", index)[0] == 1
    # no index yet: it is built from the corpus, and saved
    code, text = run("--index", f"{index}2", "--corpus", f"file://{tmp_path}/texts", "--cache-size", "4", lines=["python\n", "python\n", "\n", "rust\n"])
    assert code == 0 and text.count("x.txt") == 2 and "cache 1 hits, 1 misses" in text and store.exists(spark, f"{index}2")
    assert run("--mode", "build", "--corpus", corpus, "--index", f"{index}3", "--stopwords", f"file://{tmp_path}/stop.txt")[0] == 0
    assert run("--mode", "query", "--query", "rust", "--index", f"{index}3")[1] == "  (no results)"
    with pytest.raises(SystemExit):
        cli.arguments(["--unknown"])


def _passes(df):
    """How often the plan cuts texts."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_queries_cut_texts_once(spark):
    """A query on an index that is neither saved nor cached: one pass over the texts, which sends back its own words alone."""
    texts = [(i, "", t) for i, t in enumerate(["Tions of tioning, the tie 12 1234", "ties ties ther", "", None, "tion ther tion reed", "AY ayed aying ai a"])]
    made = build(spark.createDataFrame(texts, "doc_id long, title string, text string"))
    whole, words = made.cached(), ["tion", "ther", "ti", "ai", "12", "1234", "absent"]
    part = made.restricted(words)
    rows = lambda df: sorted(map(tuple, df.collect()))
    asked = lambda df: rows(df.filter(df["term"].isin(words)))
    assert rows(part.postings) == asked(whole.postings) != [] and rows(part.terms) == asked(whole.terms)
    assert rows(part.docs) == rows(whole.docs) == rows(made.docs) and rows(part.stats) == rows(whole.stats) and whole.restricted(words) is whole
    for query in ("tion ther", "tion AND ther", '"tion ther"', "reed tion NOT ther", "absent"):
        got = search(made, query)
        assert _passes(got) == 0 and rows(got) == rows(search(whole, query))
    assert _passes(search_batch(made, {0: "tion", 1: "ther reed"})) == _passes(score_document(made, ["tion"], 4)) == 0
    assert _passes(made.docs) == 1
    whole.dropped()


def test_many_probes_are_one_scan(spark):
    df = retrieval.queries()["posting_find_all"](spark, SF)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1 and _passes(df) == 0


def test_streaming(spark, tmp_path):
    fields = "doc_id long, title string, text string"
    for i, rows in enumerate(([(1, "a", "rust rust"), (2, "b", "python")], [(2, "b", "rust only now"), (3, "c", ""), (3, "c", "")])):
        spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(fields).parquet(f"{tmp_path}/in")
        ingest_stream.append_postings(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", availableNow=True).awaitTermination()
    index = ingest_stream.read_appended(spark, f"{tmp_path}/out")
    assert sorted(tuple(r) for r in index.docs.collect()) == [(1, 2, "a"), (2, 2, "b"), (3, 0, "c")]
    assert [r["doc_id"] for r in search(index, "rust").orderBy("rank").collect()] == [1, 2] and search(index, "python").count() == 0
    assert [r["doc_id"] for r in search(index, '"rust rust"').collect()] == [1]


def test_synthetic_corpus(spark):
    made = ingest.synthetic(spark, 50).collect()
    assert made == ingest.synthetic(spark.newSession(), 50).collect() and len({r["id"] for r in made}) == 50 and all(r["title"] and r["text"] for r in made)
    assert ingest.synthetic(spark, 50, 1).collect() != made


def test_json_fields(spark, tmp_path):
    long = "x\\n\\\"y\\\\ " * 20_000
    lines = ['{"id":"1","title":"t","text":"' + long + '"}', '{"title":"no id","text":"a \\u00e9 b"}', '{"id": 7, "title" : null, "text":"cut off', "not json", '{"id":"9","text":""}', '{"id":"10","title":"q\\"q","text":"tab\\tend"}']
    (tmp_path / "c.jsonl").write_text("\n".join(lines) + "\n")
    got = [tuple(r) for r in ingest.read_jsonl(spark, f"file://{tmp_path}/c.jsonl", compat=True).orderBy("doc_id").collect()]
    assert got[0] == (0, "t", "t " + 'x\n"y\\ ' * 20_000)
    assert got[1:] == [(1, "no id", "no id a u00e9 b"), (2, "null", "null cut off"), (3, 'q"q', 'q"q tab\tend')]


def test_ids_follow_files_and_lines(spark, tmp_path):
    """Files of many blocks, small files that share a task, and lines without text."""
    (tmp_path / "in").mkdir()
    want = []
    for f in range(7):
        lines = [f'{{"id":"{f}-{i}","title":"","text":"{"" if i % 5 == 4 else "word " * (1 + (f * 31 + i) % 40)}"}}' for i in range(3 + 150 * (f % 3))]
        want += [f"{f}-{i}" for i in range(len(lines)) if i % 5 != 4]
        (tmp_path / "in" / f"{f}.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for compat in (False, True):
            assert [(r["doc_id"], r["title"]) for r in ingest.read_jsonl(spark, f"file://{tmp_path}/in", compat).orderBy("doc_id").collect()] == list(enumerate(want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_filters_reach_the_scan_of_a_saved_index(spark):
    index = retrieval.saved(spark, SF)
    plan = index.postings.filter("term = 'tion'").select("doc_id")._jdf.queryExecution().toString()
    assert "EqualTo(term,tion)" in plan and "positions" not in plan.split("Physical Plan")[1]
    plan = search(index, "tion ther")._jdf.queryExecution().toString()
    assert "docs]" not in plan or "In(doc_id" in plan or "PushedFilters: [In" in plan


def test_sources(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id":"7","title":"","text":"x y"}\n{"id":"8","title":"t","text":""}\n\n{"id":"9","title":"u","text":"z"}\n')
    rows = ingest.read_jsonl(spark, f"file://{tmp_path}/c.jsonl").orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(0, "7", "7 x y"), (1, "u", "u z")]
    assert [tuple(r) for r in ingest.read_jsonl(spark, f"file://{tmp_path}/c.jsonl", compat=True).orderBy("doc_id").collect()] == [tuple(r) for r in rows]
    (tmp_path / "d" / "e").mkdir(parents=True)
    for name, text in (("d/a.txt", "one\ntwo"), ("d/empty.md", ""), ("d/e/b.text", "two"), ("d/A.TXT", "no"), ("d/x.csv", "no")):
        (tmp_path / name).write_text(text)
    assert {(r["title"], r["text"]) for r in ingest.read_directory(spark, f"file://{tmp_path}/d").collect()} == {("a.txt", "one\ntwo"), ("empty.md", ""), ("b.text", "two")}


def test_folders_are_listed_in_one_call(spark, tmp_path, monkeypatch):
    """The driver asks the JVM no question per file; names with odd letters and empty files are found."""
    from py4j.java_gateway import GatewayClient
    from py4j.clientserver import JavaClient

    names = [f"{i:03}.txt" for i in range(300)] + ["x é+ %41.md"]
    for name in names:
        (tmp_path / name).write_text("" if name == "007.txt" else name)
    asked, send = [], JavaClient.send_command
    assert issubclass(JavaClient, GatewayClient)
    monkeypatch.setattr(JavaClient, "send_command", lambda self, *a, **b: asked.append(1) or send(self, *a, **b))
    made = ingest.read_directory(spark, f"file://{tmp_path}")
    assert len(asked) < 250
    monkeypatch.undo()
    assert [tuple(r) for r in made.orderBy("doc_id").collect()] == [(i, n, "" if n == "007.txt" else n) for i, n in enumerate(names)]


def test_saved_index(spark, small, tmp_path):
    path = f"file://{tmp_path}/index"
    store.save(small, path)
    again = store.load(spark, path)
    assert sorted(map(tuple, again.postings.collect())) == sorted(map(tuple, small.postings.collect()))
    assert again.stats.first()["avg_doc_length"] == pytest.approx(37 / 3) and store.exists(spark, path)
    with pytest.raises(Exception):
        store.load(spark, f"file://{tmp_path}/none").stats.collect()


@pytest.mark.parametrize("name", sorted(retrieval.queries()))
def test_queries_match_sql(spark, name):
    same_as_sql(spark, retrieval.queries()[name], retrieval.oracle_sql()[name], SF)


def test_driver_entry(spark):
    assert driver.entry(spark).count() >= 0
    assert set(driver.oracle_sql()) <= set(driver.queries()) >= set(retrieval.queries())


def test_saved_ranges(spark, tmp_path, monkeypatch):
    """Ranges that are known before the postings are made hold every posting once, in order, and divide a frequent term."""
    monkeypatch.setattr(store, "RANGE", 3000)
    monkeypatch.setattr(store, "TRIED", 100)
    corpus = ingest.from_table(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text").union(spark.createDataFrame([(10**6 + i, "t", "common " * (i % 3)) for i in range(2000)], "doc_id long, title string, text string"))
    made, path = build(corpus), f"file://{tmp_path}/index"
    store.save(made, path)
    again = store.load(spark, path)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(again.postings) == rows(made.postings) and rows(again.docs) == rows(made.docs) and rows(again.terms) == rows(made.terms) and again.summary() == made.summary()
    files = [[(r["term"], r["doc_id"]) for r in spark.read.parquet(f"file://{f}").collect()] for f in (tmp_path / "index" / "postings").glob("*.parquet")]
    files = sorted(f for f in files if f)
    assert all(f == sorted(f) for f in files) and all(a[-1] < b[0] for a, b in zip(files, files[1:], strict=False))
    assert len(files) > 5 and sum(any(t == "common" for t, _ in f) for f in files) > 1 and max(map(len, files)) < 3 * sum(map(len, files)) / len(files)
    assert not (tmp_path / "index" / "_rows").exists()


@given(st.lists(st.tuples(st.sampled_from("abcd"), st.integers(0, 9)), unique=True), st.lists(st.tuples(st.sampled_from("abcde"), st.integers(-1, 10))))
@settings(deadline=None, database=None)
def test_parts(bounds, rows):
    bounds, rows = sorted(bounds), sorted(rows, key=lambda r: r[0])
    found = analyse.parts(pa.array([t for t, _ in rows], pa.string()), pa.array([d for _, d in rows], pa.int64()), bounds)
    assert found.tolist() == [sum(b <= r for b in bounds) for r in rows]
