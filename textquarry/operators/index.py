"""The inverted and forward index as four tables: docs, postings, terms, stats."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analyse import analysed
from ..functions.stopwords import DEFAULT
from ..sources.shared import new_path

FORMAT_VERSION = 2
#: Terms that the tasks of one pass are told to look for; for more, a pass makes the postings of all.
MOST = 100_000


@dataclass(frozen=True)
class Index:
    """docs (doc_id, length, title), postings (term, doc_id, tf, positions, length), terms (term, df, idf), stats (one row).

    A posting carries its document's length, so ranking reads no other table. rows: what docs and postings are both made
    of, if they are. source: the corpus and stopwords of an index that is neither saved nor cached, which each use cuts
    anew. name: the folder of a saved index. key: of this object alone.
    """

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    name: str = ""
    rows: DataFrame | None = None
    source: tuple[DataFrame, frozenset[str]] | None = None
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def cached(self) -> Index:
        made = self if self.source is None else replace(from_rows(self.rows), name=self.name, key=self.key)
        for df in (made.rows or made.postings, made.docs, made.terms, made.stats):
            df.persist()
        return made

    def restricted(self, terms) -> Index:
        """The same index as far as these terms go: their postings, frequencies and idfs, all documents, the same statistics.

        Of a corpus that is not saved or cached, one pass over all texts makes them. It is run at once, and what it
        makes, small beside the texts, is written to the shared folder: all that a query asks afterwards reads that.
        """
        if self.source is None:
            return self
        corpus, stopwords = self.source
        wanted = frozenset(terms)
        rows, path = analysed(corpus, stopwords, wanted if len(wanted) <= MOST else None), new_path(corpus.sparkSession, "rows")
        rows.write.parquet(path)
        return replace(from_rows(corpus.sparkSession.read.schema(rows.schema).parquet(path)), key=self.key)

    def dropped(self) -> None:
        for df in (self.rows or self.postings, self.docs, self.terms, self.stats):
            df.unpersist()

    def summary(self) -> dict:
        """docs_indexed, vocab_size, total_postings, avg_doc_length."""
        row = self.stats.first()
        n = self.terms.agg(F.count("*").alias("v"), F.coalesce(F.sum("df"), F.lit(0)).alias("p")).first()
        return {"docs_indexed": row["num_docs"], "vocab_size": n["v"], "total_postings": n["p"], "avg_doc_length": row["avg_doc_length"]}


def postings(corpus: DataFrame, stopwords: frozenset[str] = DEFAULT) -> DataFrame:
    """(term, doc_id, tf, positions ascending, length) of corpus (doc_id, title, text), without a shuffle."""
    return _postings(analysed(corpus, stopwords))


def _postings(rows: DataFrame) -> DataFrame:
    return rows.filter("term IS NOT NULL").select("term", "doc_id", "tf", "positions", "length")


def idf(df, n):
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def from_postings(docs: DataFrame, lists: DataFrame, name: str = "", rows: DataFrame | None = None) -> Index:
    """An index of given docs (doc_id, length, title) and postings; postings without lengths get those of docs."""
    if "length" not in lists.columns:
        lists = lists.join(docs.select("doc_id", "length"), "doc_id").select("term", "doc_id", "tf", "positions", "length")
    stats = docs.agg(F.count("*").alias("num_docs"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_doc_length"))
    counts = lists.groupBy("term").agg(F.count("*").alias("df"))
    terms = counts.crossJoin(F.broadcast(stats.select("num_docs"))).select("term", "df", idf(F.col("df"), F.col("num_docs")).alias("idf"))  # one row is broadcast
    return Index(docs, lists, terms, stats.withColumn("format_version", F.lit(FORMAT_VERSION)), name, rows)


def from_rows(rows: DataFrame) -> Index:
    """An index of what `analysed` made of a corpus."""
    return from_postings(_docs(rows), _postings(rows), rows=rows)


def _docs(rows: DataFrame) -> DataFrame:
    return rows.filter("term IS NULL").select("doc_id", "length", "title")


def build(corpus: DataFrame, stopwords: frozenset[str] = DEFAULT) -> Index:
    """An index of corpus (doc_id, title, text). Documents without a kept token have length 0 and count in the average.

    Documents and statistics come from a pass of their own that makes no postings.
    """
    rows = analysed(corpus, stopwords)
    return replace(from_postings(_docs(analysed(corpus, stopwords, frozenset())), _postings(rows), rows=rows), source=(corpus, stopwords))
