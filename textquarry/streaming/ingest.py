"""An extension: new documents are added to saved postings as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analyse import analysed
from ..functions.stopwords import DEFAULT
from ..operators.index import Index, from_postings, from_rows


def append_postings(corpus: DataFrame, path: str, checkpoint: str, stopwords: frozenset[str] = DEFAULT, **trigger):
    """A query, started, that adds each micro-batch of a streaming corpus (doc_id, title, text) to docs and postings below path.

    A batch that is written again after a failure takes the place of its first attempt. trigger: arguments of the
    writer's own; without them batches follow each other until the query is stopped. A document that comes again takes
    the place of its earlier version when the tables are read; of one that comes twice in a batch, one row stays.
    """

    def add(batch: DataFrame, number: int) -> None:
        made = from_rows(analysed(batch.dropDuplicates(["doc_id"]), stopwords).persist())
        made.postings.write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        made.docs.write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
        made.rows.unpersist()

    writer = corpus.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_appended(spark, path: str) -> Index:
    """The index of what has arrived; document frequencies and lengths are those of all batches."""
    docs, lists = (spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings"))
    latest = docs.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    docs, lists = (t.join(latest, ["doc_id", "batch"]) for t in (docs, lists))
    return from_postings(docs.select("doc_id", "length", "title"), lists.select("term", "doc_id", "tf", "positions", "length"))
