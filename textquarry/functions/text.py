"""Text normalisation: tokens of [A-Za-z0-9], stopwords, short numbers, stems; positions count every token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stem import stem, stem_tokens
from .stopwords import DEFAULT

TOKEN = "[A-Za-z0-9]+"
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text: str | Column) -> Column:
    """Lower-case tokens in order. They are cut out before they are lowered: some letters lower into ASCII."""
    return F.transform(F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def is_stopword(token: Column, stopwords: frozenset[str] = DEFAULT) -> Column:
    return token.isin(sorted(stopwords)) if stopwords else F.lit(False)


def is_short_number(token: Column) -> Column:
    return token.rlike("^[0-9]{1,3}$")


def token_rows(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """(keep.., position, token): a row for every token."""
    return docs.select(*keep, F.posexplode(tokens(text)).alias("position", "token"))


def normalized(docs: DataFrame, text: str, *keep: str, stopwords: frozenset[str] = DEFAULT) -> DataFrame:
    """(keep.., position, token, term): tokens that are kept, their positions with the gaps of those that are not."""
    # the tokens are worked out once: they go to Python and come back beside their stems
    rows = docs.select(*keep, tokens(text).alias("_tokens")).withColumn("_terms", stem_tokens("_tokens"))
    pairs = rows.select(*keep, F.posexplode(F.arrays_zip("_tokens", "_terms")).alias("position", "_t"))
    token = F.col("_t._tokens")
    return pairs.filter(~is_stopword(token, stopwords) & ~is_short_number(token)).select(*keep, "position", token.alias("token"), F.col("_t._terms").alias("term"))


def normalize_term(word: str) -> str:
    """A query word: lowered (ASCII alone) and stemmed; nothing else, so what no token holds never matches."""
    return stem(word.translate(_ASCII_LOWER))
