"""Algebra and probes of posting lists: DataFrames of postings, keyed by doc_id within a term."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(postings: DataFrame, term: str) -> DataFrame:
    """The postings of a term; the filter reaches the Parquet scan, whose row groups are sorted by term."""
    return postings.filter(F.col("term") == term)


def doc_ids(postings: DataFrame, term: str) -> DataFrame:
    return lookup(postings, term).select("doc_id")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").intersect(b.select("doc_id"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").union(b.select("doc_id")).distinct()


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").subtract(b.select("doc_id"))


def find(postings: DataFrame, term: str, doc_id: int) -> DataFrame:
    """The posting of a term in a document, or no row."""
    return lookup(postings, term).filter(F.col("doc_id") == doc_id)


def find_all(postings: DataFrame, terms: Iterable[str], doc_ids: Iterable[int]) -> DataFrame:
    """The postings of each of the terms in each of the documents that hold it, in one scan."""
    return postings.filter(F.col("term").isin(sorted(set(terms))) & F.col("doc_id").isin(sorted(set(doc_ids))))


def seek(postings: DataFrame, term: str, doc_id: int, past: bool = False) -> DataFrame:
    """The first posting of a term at doc_id or later; strictly later if past."""
    after = F.col("doc_id") > doc_id if past else F.col("doc_id") >= doc_id
    return lookup(postings, term).filter(after).orderBy("doc_id").limit(1)
