"""Quality rules: tokeniser fertility with rejection bands per script or language, beside word and line rules.

A text's words are encoded with a public byte-fallback vocabulary. Measured are characters per token, the share of
byte-fallback tokens, and the entropy of its tokens relative to the most that so many tokens, or ENTROPY_TOKENS if
there are more, can have.

`rate` judges each text by itself, by fixed bands per language or script: nothing is shuffled, and a row's cost follows
its own length. `rate_corpus` takes the bands from the corpus: over all texts that pass the word rules, the median of
characters per token and of entropy, and the median distance from it, per language (where there is no label, per
script) and power of two of the number of tokens, since the longer a text, the nearer it comes to its language's. A text
fails more than DEVIATIONS scaled distances from the median (entropy: below it), or by its script's band of byte tokens.
Where fewer than LEAST_TEXTS texts share a language and length, the fixed bands hold. Medians come from exact counts of
rounded values: a few thousand rows a language, the same in every run.

A null or empty text has no words: base_failed, not kept. A null label, null ids, repeated rows (each counts), ties and
extra columns are allowed; an empty table has an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, coded_words, mapped, written
from .scripts import script_of


@dataclass(frozen=True)
class Band:
    """Bounds of what is kept. The entropy bound holds from `entropy_from` tokens on: short texts say little."""

    chars_per_token: tuple[float, float] = (1.15, 12.0)
    byte_share: float = 0.25
    entropy: float = 0.45
    entropy_from: int = 40


#: By script, for texts of a labelled language without statistics. The tables have only Latin documents; the others' bounds
#: lie between random letters of the script (bytes: hangul 0.94, han 0.92, devanagari 0.61, kana 0.53, thai 0.40, emoji 0.85;
#: characters per token: cyrillic 1.12) and an article of the Declaration of Human Rights (bytes at most 0.12; Russian 2.2).
#: "other" has scripts that are spelled in bytes (Amharic 0.83), "signs" is "other" with fewer letters than half. Random
#: letters of greek, arabic, hebrew and of scripts in "other" stay inside their bands: these measures do not tell them.
BANDS = {
    "latin": Band(), "cyrillic": Band((1.4, 8.0), 0.3), "greek": Band((0.6, 6.0), 0.6), "arabic": Band((0.5, 5.0), 0.5), "hebrew": Band((0.5, 5.0), 0.5),
    "devanagari": Band((0.3, 4.0), 0.4), "thai": Band((0.3, 4.0), 0.25), "hangul": Band((0.3, 4.0), 0.5), "kana": Band((0.3, 4.0), 0.35), "han": Band((0.3, 4.0), 0.5), "other": Band((0.25, 12.0), 0.95), "signs": Band((0.25, 12.0), 0.5),
}
#: By language, before its script's; "" is a Latin text without a label. From the 9,154 sf0.1 documents that pass the word
#: rules: the 0.1% and 0.5% quantiles of characters per token are en 1.79, 1.92; de 1.40, 1.96; fr 1.60, 1.75; es 1.56, 1.72.
#: Random letters have 1.64 at most in texts of 80 words, base64 1.25. The label counts for Latin texts only. Without a
#: label, a Latin text of a language that the vocabulary spells in short pieces is rejected (Vietnamese: 1.09).
LANGUAGE_BANDS: dict[str, Band] = {"en": Band((1.75, 12.0)), "de": Band((1.75, 12.0)), "fr": Band((1.66, 12.0)), "es": Band((1.66, 12.0)), "": Band((1.66, 12.0))}
#: Base limits.
LEAST_WORDS, REPEATED_PERCENT, WINDOW = 10, 20, 5
#: Of the corpus's own bands: distances from the median, in standard deviations of a normal distribution, and least texts.
DEVIATIONS, LEAST_TEXTS = 6.0, 50
#: Longer texts do not use more tokens evenly: entropy stops growing at about this length.
ENTROPY_TOKENS = 1024

_SYMBOL = re.compile(r"[#*$%&|<>]")
FIELDS = (
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
    ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("token_entropy", pa.float64()), ("script", pa.string()), ("bytes_fine", pa.bool_()),
)
SCHEMA = ", ".join(f"{n} {({'int64': 'long', 'bool': 'boolean', 'double': 'double', 'string': 'string'})[str(t)]}" for n, t in FIELDS)


def n_repeat_words(numbers: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of `window` words that the text has twice or more; numbers: of its words, equal for equal ones."""
    if len(numbers) <= window:
        return 0
    codes = numbers.astype(np.uint64)
    n = len(numbers) - window + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        h = (h ^ (codes[k : k + n] + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    # equal hashes may be chance: the windows themselves decide
    suspects = np.unique(np.concatenate([order[1:][same], order[:-1][same]])).tolist()
    windows = list(map(tuple, np.lib.stride_tricks.sliding_window_view(numbers, window)[suspects].tolist()))
    counts = Counter(windows)
    starts = [i for i, w in zip(suspects, windows, strict=True) if counts[w] > 1]
    covered = np.zeros(len(numbers) + 1, dtype=np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, np.asarray(starts, dtype=np.int64) + window, -1)
    return int((np.cumsum(covered)[: len(numbers)] > 0).sum())


def n_dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            n += line in seen
            seen.add(line)
    return n


class Pieces:
    """Token ids of words, looked up many at a time and kept; ids of byte tokens are those of the vocabulary's <0x..> pieces."""

    def __init__(self, path: str, most: int = 150_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.size, self.flat = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)

    def learned(self, words: list[str]) -> np.ndarray:
        """The rows of different words in the table, which is emptied first if it would hold more than `most`."""
        new = [w for w in words if w not in self.number]
        if len(self.number) + len(new) > self.most:
            self.clear()
            new = words
        sizes, flats = [self.size], [self.flat]
        for i in range(0, len(new), 8192):
            made = self.model.encode(new[i : i + 8192], num_threads=1)
            sizes.append(np.fromiter(map(len, made), dtype=np.int64, count=len(made)))
            flats.append(np.fromiter(chain.from_iterable(made), dtype=np.int32, count=int(sizes[-1].sum())))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.size, self.flat = np.concatenate(sizes), np.concatenate(flats)
        self.begin = np.cumsum(self.size) - self.size
        return np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        size = self.size[numbers]
        upto = np.cumsum(size)
        return self.flat[np.repeat(self.begin[numbers] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]


def fertility(ids: np.ndarray, chars: int, is_byte: np.ndarray) -> tuple[float, float, float]:
    """Characters per token, share of byte tokens, and entropy as a share of log2 of the number of tokens, ENTROPY_TOKENS at most."""
    n = len(ids)
    if not n:
        return 0.0, 0.0, 0.0
    counts = np.unique(ids, return_counts=True)[1] / n
    entropy = float(-(counts * np.log2(counts)).sum())
    return chars / n, float(is_byte[ids].mean()), entropy / math.log2(min(n, ENTROPY_TOKENS)) if n > 1 else 1.0


def judge(text: str, numbers: np.ndarray, chars: int, lang: str | None, pieces: Pieces, bands=None, language_bands=None) -> tuple:
    """The values of FIELDS for one text. numbers: of its words, which pieces has learned; chars: in its words."""
    n = len(numbers)
    repeated = n_repeat_words(numbers)
    failed = n < LEAST_WORDS or 100 * repeated > REPEATED_PERCENT * n
    ids = pieces.ids(numbers)
    per_token, byte_share, entropy = fertility(ids, chars, pieces.is_byte)
    script = script_of(text)
    by_language = LANGUAGE_BANDS if language_bands is None and bands is None and script == "latin" else language_bands or {}
    own = bands or BANDS
    band = by_language.get(lang or "") or own[script]
    if script == "other" and 2 * sum(c.isalpha() or category(c)[0] == "M" for c in text) < len(text) - text.count(" "):
        band = own.get("signs", band)
    fine = band.chars_per_token[0] <= per_token <= band.chars_per_token[1] and byte_share <= band.byte_share and (len(ids) < band.entropy_from or entropy >= band.entropy)
    return n, chars, len(_SYMBOL.findall(text)), n_dup_lines(text), repeated, failed, not failed and fine, len(ids), per_token, byte_share, entropy, script, byte_share <= band.byte_share


def rate(docs: DataFrame, vocabulary: str, keep: list[str], lang: str | None = None, bands=None, language_bands=None) -> DataFrame:
    """Columns `keep` of docs and FIELDS, which replace kept columns of their names. vocabulary: a path that every executor has; lang: a column, if one is to choose the band."""
    keep = [c for c in keep if c.lower() not in {n for n, _ in FIELDS}]
    rows = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs["text"].alias("text"), *([docs[lang].alias("lang")] if lang else []))

    def work(batches):
        pieces = Kept.get(vocabulary, lambda: Pieces(vocabulary))
        for batch in batches:
            langs = batch.column("lang").to_pylist() if lang else [None] * batch.num_rows
            texts = [t or "" for t in batch.column("text").to_pylist()]
            codes, distinct, ends = coded_words(batch.column("text"))
            numbers, size = pieces.learned(distinct)[codes], np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct))[codes]
            starts = [0, *ends.tolist()]
            made = [judge(t, numbers[a:b], int(size[a:b].sum()), g, pieces, bands, language_bands) for t, g, a, b in zip(texts, langs, starts, starts[1:], strict=False)]
            columns = list(zip(*made, strict=True)) or [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([*(batch.column(f"k{i}") for i in range(len(keep))), *(pa.array(c, t) for c, (_, t) in zip(columns, FIELDS, strict=True))], [*(f"k{i}" for i in range(len(keep))), *(n for n, _ in FIELDS)])

    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), SCHEMA])
    return mapped(rows, work, schema, "quality").toDF(*keep, *(n for n, _ in FIELDS))


def corpus_bands(rated: DataFrame, group: str) -> DataFrame:
    """(_group, _size, low, high, least): bands of characters per token and of entropy, from all rated rows that pass the word rules."""
    keys = ["_group", "_size", "measure"]
    size = F.floor(F.log2("n_tokens")).cast("int")
    both = F.array(F.struct(F.lit("chars").alias("measure"), F.round("chars_per_token", 3).alias("value")), F.struct(F.lit("entropy").alias("measure"), F.round("token_entropy", 3).alias("value")))
    passed = rated.filter(~F.col("base_failed") & (F.col("n_tokens") > 0)).select(F.col(group).alias("_group"), size.alias("_size"), F.explode(both).alias("m"))
    counts = passed.select("_group", "_size", "m.*").groupBy(*keys, "value").count()

    def median(rows: DataFrame, of: str, out: str) -> DataFrame:
        """The value of column `of` that half of the counted rows do not pass."""
        upto = F.sum("count").over(Window.partitionBy(*keys).orderBy(of).rowsBetween(Window.unboundedPreceding, 0))
        total = F.sum("count").over(Window.partitionBy(*keys))
        return rows.withColumn("upto", upto).withColumn("total", total).filter(2 * F.col("upto") >= F.col("total")).groupBy(*keys).agg(F.min(of).alias(out), F.first("total").alias("texts"))

    counts = written(counts, "measures")
    far = counts.join(median(counts, "value", "middle").drop("texts"), keys).withColumn("distance", F.abs(F.col("value") - F.col("middle")))
    spread = median(far.groupBy(*keys, "middle", "distance").agg(F.sum("count").alias("count")), "distance", "distance").filter(F.col("texts") >= LEAST_TEXTS)
    middle = median(counts, "value", "middle").drop("texts")
    # 1.4826 times the median distance is the standard deviation of a normal distribution; rounded values are no nearer than 0.001
    reach = DEVIATIONS * 1.4826 * F.greatest("distance", F.lit(0.001))
    found = spread.join(middle, keys).withColumn("low", F.col("middle") - reach).withColumn("high", F.col("middle") + reach)
    of = lambda measure, column: F.max(F.when(F.col("measure") == measure, F.col(column)))
    return found.groupBy("_group", "_size").agg(of("chars", "low").alias("low"), of("chars", "high").alias("high"), of("entropy", "low").alias("least"))


def rate_corpus(docs: DataFrame, vocabulary: str, keep: list[str], lang: str) -> DataFrame:
    """Columns `keep` of docs and FIELDS; kept by the corpus's own bands. lang: the column of labels."""
    keep = [c for c in keep if c.lower() not in {n for n, _ in FIELDS}]
    own = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(docs[c].alias(k) for c, k in zip(keep, own, strict=True)), docs["text"].alias("text"), docs[lang].alias("label"))
    rated = rate(rows, vocabulary, [*own, "label"], "label")
    rated = written(rated.withColumn("group", F.coalesce("label", F.concat(F.lit("script "), "script"))), "rated")
    bands = written(corpus_bands(rated, "group"), "bands")
    same = (rated["group"] == bands["_group"]) & (F.floor(F.log2("n_tokens")).cast("int") == bands["_size"])
    fine = F.col("chars_per_token").between(F.col("low"), F.col("high")) & (F.col("token_entropy") >= F.col("least")) & F.col("bytes_fine")
    kept = ~F.col("base_failed") & F.when(F.col("low").isNull(), F.col("kept")).otherwise(fine)
    out = rated.join(bands, same, "left").withColumn("kept", kept)
    return out.select(*own, *(n for n, _ in FIELDS)).toDF(*keep, *(n for n, _ in FIELDS))
