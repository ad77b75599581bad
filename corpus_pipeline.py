"""A training corpus from documents, in stages that each work on all that the one before kept.

Every stage but the last returns the columns of documents, others beside them included, whatever their names: extra
columns stay with their rows. Repeated rows are rows of their own, null ids are allowed, and an empty table gives an
empty table. What each stage does with null, empty and very long texts and with ties is said beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import bpe, langid, minhash, mixing, pii
from textquarry.llm.common import free, new_path, removed, scratch, table
from textquarry.llm.queries import held_out, vocabulary

#: A text whose language is not told at this score is rejected, and so is one without a letter.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of a language that is told; lang becomes the predicted one, the other columns stay.

    Null texts and those without a letter go; a text is read whole, however long. Of languages that fit equally well
    the first by name is taken. Null labels teach nothing; without any label every text goes.
    """
    model = langid.train(docs, ~F.coalesce(held_out(), F.lit(True)))
    names = docs.columns
    lang, score = free("lang_pred", names), free("score", names)
    found = langid.predict(docs, model, [c for c in names if c != "lang"], names=(lang, score))
    return found.filter((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).withColumnRenamed(lang, "lang").select(*names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: five-word shingles, similarity 0.8 or more.

    The row of the smallest id stays, null ids last, and of equal ids an earlier row of the table. Null texts, and texts
    without a word, are copies of nothing and stay; texts of fewer than five words are copies if all words agree.
    """
    return minhash.drop_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars, if there, is made anew.

    Null and empty texts stay as they are. Spans that overlap are replaced once, by the kind of the first of them.
    """
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for: from not at all to three times.

    Null sources are a source of their own, the last. Null texts, and texts without a word, have no size and are not taken.
    """
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256) of each row: its text's ids, and a digest of what they decode to.

    Null and empty texts have no ids. A text is encoded whole, however long.
    """
    return bpe.encode(docs, vocabulary("word_bpe_49k.json"), ["doc_id", "lang", "source"], ("n_tokens", "ids", "decoded_sha256"))


STAGES = [("language", language), ("near_copies", near_copies), ("personal_data", personal_data), ("mixture", mixture), ("encoding", encoding)]

#: Language models, hashes and draws are not SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages make of documents. A stage's table is removed when the next one's is whole, but for the last's input."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
