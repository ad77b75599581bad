import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textquarry.functions import analyse
from textquarry.functions.analyse import analysed
from textquarry.functions.stem import STEP2, STEP3, STEP4, stem, stems, with_stem
from textquarry.functions.stopwords import DEFAULT, parse
from textquarry.functions.text import normalized, token_rows
from textquarry.plans.query import And, Not, Or, Phrase, Term
from textquarry.plans.query import parse as parse_query

STEMS = {
    "running": "run", "cats": "cat", "caresses": "caress", "ponies": "poni", "a": "a", "an": "an", "relational": "relat", "foxes": "fox", "jumping": "jump", "lazy": "lazi",
    "databases": "databas", "mechanics": "mechan", "compiler": "compil", "eat": "eat", "eating": "eate", "edit": "edit", "editing": "edite", "opening": "opene", "agreed": "agreed",
    "agree": "agree", "apples": "apple", "argue": "argue", "adoption": "adoption", "companion": "compan", "rebellion": "rebel",
}


def test_stems(spark):
    assert {w: stem(w) for w in STEMS} == STEMS
    native = with_stem(spark.createDataFrame([(w,) for w in STEMS], "token string"))
    assert {r["token"]: r["stem"] for r in native.collect()} == STEMS


def test_stopwords():
    assert len(DEFAULT) == 148 and {"the", "is", "and"} <= DEFAULT and not {"computer", "algorithm"} & DEFAULT
    assert parse("one\r\ntwo \r\n\r\n Three") == {"one", "two", " Three"}


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("Hello, World! This is a TEST.", "hello world this is a test"), ("", ""), ("...---!!!", ""), ("café résumé naïve", "caf r sum na ve"), ("K Kelvin", "kelvin")],
)
def test_tokens(spark, text, tokens):
    rows = token_rows(spark.createDataFrame([(1, text)], "doc_id long, text string"), "text", "doc_id").orderBy("position").collect()
    assert [r[1] if isinstance(r[1], str) else r["token"] for r in rows] == tokens.split() and [r["position"] for r in rows] == list(range(len(rows)))


@pytest.mark.parametrize(
    ("text", "want"),
    [("The quick brown foxes are jumping over the lazy dogs.", [("quick", 1), ("brown", 2), ("fox", 3), ("jump", 5), ("lazi", 8), ("dog", 9)]), ("7 42 123 2024 3d", [("2024", 3), ("3d", 4)])],
)
def test_normalized(spark, text, want):
    df = normalized(spark.createDataFrame([(1, text)], "doc_id long, text string"), "text", "doc_id")
    assert [(r["term"], r["position"]) for r in df.select("term", F.col("position")).orderBy("position").collect()] == want


WORDS = st.text(alphabet="abcdefghijklmnopqrstuvwxyz", min_size=1, max_size=5)
ENDINGS = st.sampled_from([*STEP2, *STEP3, *STEP4, "", "s", "ed", "ing", "eed", "sses", "ies", "e", "y", "ll", "ate"])


def test_native_stems_are_the_same(spark):
    made = []

    @settings(max_examples=3000, deadline=None, database=None)
    @given(WORDS, ENDINGS, ENDINGS)
    def collect(word, a, b):
        made.append(word + a + b)

    collect()
    words = sorted(set(made))
    got = {r["token"]: r["stem"] for r in with_stem(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    assert len(words) > 500 and got == {w: stem(w) for w in words}


def test_stems_of_arrays_are_the_same():
    made = ["", "s", "y", "yyy", "ies", "sses", "eed", "x" * 10000 + "ing"]

    @settings(max_examples=5000, deadline=None, database=None)
    @given(st.text(alphabet="abcdeiloustyyz09", max_size=6), ENDINGS, ENDINGS, ENDINGS)
    def collect(word, a, b, c):
        made.append(word + a + b + c)

    collect()
    want = [stem(w) for w in made]
    assert stems(pa.array(made)).to_pylist() == want and stems(pa.array(made)[7:99]).to_pylist() == want[7:99]
    assert [stems(pa.array(ws, pa.string())).to_pylist() for ws in ([], [""], ["ab", ""])] == [[], [""], ["ab", ""]]


def test_postings_are_those_of_the_tokens(spark):
    """One pass over many texts, against the tokens one by one: odd characters, empty and null texts, slices."""
    made = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.text(alphabet="aBcT eiING0129 .,'-\n\u212aéß日\x00", max_size=40))
    def collect(text):
        made.append(text)

    collect()
    rows = [(10 * i, f"t{i}", text) for i, text in enumerate(["", None, "the of 12", "ab", "cd", *made])]
    corpus = spark.createDataFrame(rows, "doc_id long, title string, text string").repartition(3)
    want = {}
    for r in normalized(corpus, "text", "doc_id").collect():
        want.setdefault((r["term"], r["doc_id"]), []).append(r["position"])
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "title": [r[1] for r in rows], "text": [r[2] for r in rows]})
    found = analysed(corpus).collect()
    whole = analyse.postings_of(*(table[c].combine_chunks().fill_null("") if c == "text" else table[c].combine_chunks() for c in ("text", "doc_id", "title")), analyse.Terms(DEFAULT)).to_pylist()
    for got in ([r.asDict() for r in found], whole):
        lists = {(r["term"], r["doc_id"]): r for r in got if r["term"] is not None}
        assert {k: sorted(v) for k, v in want.items()} == {k: r["positions"] for k, r in lists.items()} and all(r["tf"] == len(r["positions"]) for r in lists.values())
        length = {i: sum(len(p) for (_, d), p in want.items() if d == i) for i, _, _ in rows}
        assert {r["doc_id"]: (r["length"], r["title"]) for r in got if r["term"] is None} == {i: (length[i], t) for i, t, _ in rows} and len(got) == len(lists) + len(rows)
        assert all(r["length"] == length[r["doc_id"]] for r in lists.values())


def test_parser():
    assert parse_query("hello") == Term("hello")
    assert parse_query("hello world") == Or(Term("hello"), Term("world"))
    assert parse_query("hello AND world") == And(Term("hello"), Term("world"))
    assert parse_query("hello NOT world") == Not(Term("hello"), Term("world"))
    assert parse_query('"hello world"') == Phrase(("hello", "world"))
    assert parse_query("   ") is None
