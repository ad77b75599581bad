"""Language ID: script ranges narrow the candidates of each word, Viterbi with a switching penalty labels the spans.

Words are runs of letters. A word's score for a language is the log probability of its character n-grams (1 to 4, word
ends included) under that language's smoothed counts. Languages that never used the word's script in training are no
candidates. The best path over a text's words, where each change of language costs `penalty`, gives spans; a text's
language is the one with most letters, and the score is its share of letters times how sure its words are.

The model is fitted on about `per_language` labelled texts of each language, those whose id's hash is below a threshold:
a documented bound. Everything else, and every text whole, is labelled by tasks that share nothing.

A null text, or one without a letter, is `und` with score 0. Without labelled texts every text is `und`. Null ids and
labels, repeated rows and extra columns are allowed; ties go to the language that sorts first.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Kept, coded, mapped
from .scripts import _RUNS

#: Bound of the fit: texts per language, and n-grams per language.
PER_LANGUAGE, GRAMS, PENALTY = 500, 20_000, 12.0
_LETTERS = re.compile(r"[^\W\d_]+")


def grams(word: str) -> list[str]:
    w = f" {word.lower()} "
    return [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1) if n > 1 or w[i] != " "]


def gram_key(gram: str) -> int:
    """An n-gram of at most four characters as one integer of 16 bits each; characters past U+FFFF count as one."""
    return sum(min(ord(c), 0xFFFF) << 16 * k for k, c in enumerate(gram))


def script_of_word(word: str) -> str:
    return "latin" if word.isascii() else next((name for name, run in _RUNS.items() if run.match(word)), "other")


def fit(rows: list[tuple[str, str]], most_grams: int = GRAMS) -> dict:
    """A model from (lang, text): log probabilities of n-grams, their default, and each script's languages."""
    counts: dict[str, Counter] = defaultdict(Counter)
    scripts: dict[str, Counter] = defaultdict(Counter)
    for lang, text in rows:
        for word, n in Counter(_LETTERS.findall(text or "")).items():
            scripts[script_of_word(word)][lang] += n * len(word)
            for g in grams(word):
                counts[lang][g] += n
    langs = sorted(counts)
    known = sorted({g for c in counts.values() for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most_grams]})
    total = [sum(c.values()) for c in (counts[x] for x in langs)]
    width = len(known) + 1
    score = {g: [math.log((counts[x][g] + 0.5) / (t + 0.5 * width)) for x, t in zip(langs, total, strict=True)] for g in known}
    used = {x: sum(c[x] for c in scripts.values()) for x in langs}
    of_script = {s: [c[x] >= 0.001 * used[x] and c[x] > 0 for x in langs] for s, c in scripts.items()}
    return {"langs": langs, "score": score, "default": [math.log(0.5 / (t + 0.5 * width)) for t in total], "scripts": of_script}


class Words:
    """Scores of words under a model, one row per distinct word, from a table that is emptied when it is full."""

    FAR = -60.0  # of a language that is no candidate

    def __init__(self, model: dict, most: int = 150_000):
        self.langs, self.scripts, self.most = model["langs"], model["scripts"], most
        # a row per known n-gram in the order of their keys, and the last one for all others
        keys = np.array([gram_key(g) for g in model["score"]], dtype=np.uint64)
        self.keys, first = np.unique(keys, return_index=True)
        self.score = np.array([*model["score"].values(), model["default"]]).reshape(-1 if self.langs else len(model["score"]) + 1, len(self.langs))[[*first, -1]]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.langs)))

    def many(self, new: list[str]) -> np.ndarray:
        """The scores of words, all n-grams of all of them looked up at once."""
        lower = [f" {w.lower()} " for w in new]
        size = np.fromiter(map(len, lower), dtype=np.int64, count=len(new))
        begin = np.cumsum(size) - size
        codes = np.minimum(np.frombuffer("".join(lower).encode("utf-32-le"), "<u4"), 0xFFFF).astype(np.uint64)
        left = np.repeat(size, size) - (np.arange(len(codes)) - np.repeat(begin, size))  # characters from here to the word's end
        total, key = np.zeros((len(codes), len(self.langs))), np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, 5):
            key[: len(codes) - n + 1] |= codes[n - 1 :] << np.uint64(16 * (n - 1))
            here = np.flatnonzero((left >= n) & ((n > 1) | (codes != 32)))
            total[here] += self.score[self._row(key[here])]
        n = 4 * size - 8  # n-grams of each word: size - 2, size - 1, size - 2 and size - 3
        # mean per letter times a slowly growing length, so that one long word does not outvote a sentence
        s = np.add.reduceat(total, begin) / n[:, None]
        s = (s - s.max(axis=1, keepdims=True)) * np.minimum(np.fromiter(map(len, new), dtype=np.int64, count=len(new)), 12)[:, None]
        for script in set(map(script_of_word, new)):
            fits = self.scripts.get(script)
            if fits is not None and any(fits) and not all(fits):
                here = np.array([script_of_word(w) == script for w in new])
                s[here] = np.where(fits, s[here], self.FAR)
        return s

    def _row(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, len(self.score) - 1)

    def learned(self, words: list[str]) -> np.ndarray:
        """The rows of different words in the table, which is emptied first if it would hold more than `most`."""
        new = [w for w in words if w not in self.number]
        if len(self.number) + len(new) > self.most:
            self.clear()
            new = words
        for i in range(0, len(new), 4096):  # a bounded number of n-grams at once
            part, k = new[i : i + 4096], len(self.number)
            while k + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[k : k + len(part)] = self.many(part)
            self.number.update(zip(part, range(k, k + len(part))))
        return np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))


def viterbi(s: np.ndarray, penalty: float) -> np.ndarray:
    """The path of most score over rows of s, each change costing `penalty`; ties keep the language, then take the first."""
    n, m = s.shape
    # The best constant path j is the best of all if two things hold. No stretch of one other language gains more than a
    # change costs: a path that uses j and k other stretches has k changes at least. And all words together gain no more
    # than that by their own best other languages: a path without j that is not constant has one change at least.
    j = int(s.sum(axis=0).argmax())
    more = s - s[:, j : j + 1]
    gain = np.zeros((n + 1, m))
    np.cumsum(more, axis=0, out=gain[1:])
    most = (gain - np.minimum.accumulate(gain, axis=0)).max()
    # k stretches gain k * most together, which k - 1 changes cost at least if most is half a penalty
    if most <= penalty and (m < 3 or 2 * most <= penalty or np.delete(more, j, axis=1).max(axis=1).sum() <= penalty):
        return np.full(n, j)
    d = s[0].tolist()
    back = []
    for row in s[1:].tolist():
        best = max(d)
        b = d.index(best)
        low = best - penalty
        back.append([k if x >= low else b for k, x in enumerate(d)])
        d = [(x if x >= low else low) + r for x, r in zip(d, row, strict=True)]
    k = d.index(max(d))
    path = [k]
    for step in reversed(back):
        k = step[k]
        path.append(k)
    return np.array(path[::-1])


def label(text: str | None, words: Words, penalty: float = PENALTY) -> tuple[str, float, list[tuple[int, int, str]]]:
    """(language, score, spans of (start, end, language) in code points)."""
    return labels([text], words, penalty)[0]


def labels(texts: list[str | None], words: Words, penalty: float = PENALTY) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """The same of many texts, whose new words are looked up together."""
    if not words.langs:
        return [("und", 0.0, [])] * len(texts)
    found = [_LETTERS.findall(t or "") for t in texts]
    codes, distinct = coded(found)
    rows, size = words.learned(distinct)[codes], np.fromiter(map(len, distinct), dtype=np.float64, count=len(distinct))[codes]
    upto = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
    return [_label(t, ws, words.table[rows[b - len(ws) : b]], size[b - len(ws) : b], words, penalty) if ws else ("und", 0.0, []) for t, ws, b in zip(texts, found, upto.tolist(), strict=True)]


def _label(text: str, ws: list[str], s: np.ndarray, sizes: np.ndarray, words: Words, penalty: float) -> tuple[str, float, list[tuple[int, int, str]]]:
    path = viterbi(s, penalty)
    share = np.bincount(path, weights=sizes, minlength=len(words.langs)) / sizes.sum()
    j = int(share.argmax())
    mine = s[path == j].mean(axis=0)
    p = np.exp(mine - mine.max())
    cuts = np.flatnonzero(np.diff(path)) + 1
    if len(cuts):
        at = [m.span() for m in _LETTERS.finditer(text)]
        spans = [(at[a][0], at[b - 1][1], words.langs[path[a]]) for a, b in zip([0, *cuts], [*cuts, len(ws)], strict=True)]
    else:  # no letter stands before the first word or after the last
        spans = [(text.index(ws[0]), text.rindex(ws[-1]) + len(ws[-1]), words.langs[j])]
    return words.langs[j], float(min(1.0, share[j] * p[j] / p.sum())), spans


def sample(docs: DataFrame, train: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text) of the fit: of the rows for which `train` holds, about per_language different texts of each language, whole.

    They are those whose id's hash is below a threshold of their language, so no task meets all rows of a language.
    """
    labelled = docs.filter(train & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    share = labelled.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share"))  # a row per language
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return labelled.join(F.broadcast(share), "lang").filter(draw < F.col("share")).select("lang", "text").distinct()


def train(docs: DataFrame, which: Column, per_language: int = PER_LANGUAGE) -> dict:
    rows = sorted((r[0], r[1] or "") for r in sample(docs, which, per_language).collect())
    return fit(rows)


def predict(docs: DataFrame, model: dict, keep: list[str], penalty: float = PENALTY, spans: bool = False, names: tuple[str, ...] = ("lang_pred", "score", "spans")) -> DataFrame:
    """Columns `keep` of docs and, under `names`, lang_pred, score and, if asked for, spans array<struct<start, end, lang>>.

    They replace kept columns of their names.
    """
    names = names[: 2 + spans]
    keep = [c for c in keep if c not in names]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most GRAMS n-grams per language
    rows = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs["text"].alias("text"))
    key = uuid.uuid4().hex  # of this model in these tasks
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def work(batches):
        known = Kept.get(key, lambda: Words(sent.value))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            made = labels(texts, known, penalty)
            out = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]
            if spans:
                out.append(pa.array([[{"start": a, "end": b, "lang": g} for a, b, g in m[2]] for m in made], kind))
            yield pa.RecordBatch.from_arrays([*(batch.column(f"k{i}") for i in range(len(keep))), *out], [*(f"k{i}" for i in range(len(keep))), "lang_pred", "score", *(["spans"] if spans else [])])

    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans])
    return mapped(rows, work, schema, "language").toDF(*keep, *names)
