"""The suffix stemmer, four times: per word in Python, of whole arrays of words, as an Arrow function with a cache, and as a chain of native columns.

It resembles the published Porter stemmer but measures a stem by its consonant-vowel changes ("CV" in the mask below),
drops -ion after any letter, and keeps a final e after a stem that ends in CV. Words are lower-case [a-z0-9]+.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Endings and what replaces them, in the order of the published algorithm. No ending of a step ends
# another but a longer one of the same step, so the longest that fits is the one.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = dict.fromkeys(["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"], "")


def _endings(table: dict[str, str]) -> list[tuple[str, str]]:
    return sorted(table.items(), key=lambda x: -len(x[0]))


_STEPS = ((_endings(STEP2), 0), (_endings(STEP3), 0), (_endings(STEP4), 1))


def mask(word: str) -> str:
    out, last = [], "V"
    for i, c in enumerate(word):
        if c in "aeiou":
            last = "V"
        elif c == "y":
            last = "C" if i == 0 or last == "V" else "V"
        else:
            last = "C"
        out.append(last)
    return "".join(out)


def _cvc(w: str, m: str) -> bool:
    return len(w) > 2 and m.endswith("CVC") and w[-1] not in "wxy"


def stem(word: str) -> str:
    """The stem of one lower-case word."""
    w = word
    if len(w) < 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    m = mask(w)
    if w.endswith("eed"):
        w = w[:-1] if "CV" in m[:-3] else w
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and "V" in m[:-cut]:
            w, m = w[:-cut], m[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and m[-1] == "C":
                w = w if w[-1] in "lsz" else w[:-1]
            elif m.count("CV") == 1 and _cvc(w, m):
                w += "e"
    if len(w) > 1 and w[-1] == "y" and "V" in mask(w)[:-1]:
        w = w[:-1] + "i"
    for endings, least in _STEPS:
        if len(w) > 2:
            for e, to in endings:
                if w.endswith(e):
                    if mask(w)[: -len(e)].count("CV") > least:
                        w = w[: -len(e)] + to
                    break
    m = mask(w)
    if w.endswith("e"):
        inner = m[:-1]
        n = inner.count("CV")
        # a blank after the stem makes it CVC when the stem ends in CV
        if n > 1 or n == 1 and not (len(inner) > 1 and inner.endswith("CV")) and not _cvc(w[:-1], inner):
            w, m = w[:-1], inner
    return w[:-1] if w.endswith("ll") and m.count("CV") > 1 else w


class _Words:
    """Many words as one run of bytes that steps change in place: no step makes a word longer than it came."""

    def __init__(self, words: pa.Array):
        at = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        self.data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]].copy()
        self.begin, self.came = at[:-1] - at[0], np.diff(at)
        self.size = self.came.copy()
        self.opens = np.zeros(len(self.data) + 1, dtype=bool)
        self.opens[self.begin[self.came > 0]] = True
        self.opens = self.opens[:-1]
        v = _VOWEL[self.data]
        ys = np.flatnonzero(self.data == ord("y"))
        if len(ys):
            begins = self.opens[ys]
            first = begins | (self.data[ys - 1] != ord("y"))  # of a run of y, within which vowels and consonants take turns
            run = np.maximum.accumulate(np.where(first, np.arange(len(ys)), 0))
            v[ys] = (~begins & ~v[ys - 1])[run] ^ ((ys - ys[run]) & 1).astype(bool)
        self.v, self.tail = v, np.zeros(len(self.size), dtype=np.uint64)
        self.vowels, self.changes = (np.zeros(len(v) + 1, dtype=np.int32) for _ in range(2))
        self.seen(np.arange(len(self.size)))

    def seen(self, words: np.ndarray, vowels: bool = True) -> None:
        """After a step that changed these words: the last bytes of each as one number, and the counts.

        What stands after a word's end counts for nothing, as counts go up to its end.
        """
        tail, end, size = np.zeros(len(words), dtype=np.uint64), self.begin[words] + self.size[words], self.size[words]
        for k in range(1, 8):
            tail |= np.where(size >= k, self.data[np.maximum(end - k, 0)], 0).astype(np.uint64) << np.uint64(8 * k - 8)
        self.tail[words] = tail
        change = self.v.copy()
        change[1:] &= ~self.v[:-1]
        change &= ~self.opens
        np.cumsum(change, out=self.changes[1:])
        if vowels:
            np.cumsum(self.v, out=self.vowels[1:])

    def ends(self, *endings: str) -> np.ndarray:
        out = np.zeros(len(self.size), dtype=bool)
        for e in endings:
            out |= (self.tail & np.uint64((1 << 8 * len(e)) - 1)) == np.uint64(int.from_bytes(e.encode(), "big"))
        return out

    def count(self, of: np.ndarray, less: np.ndarray | int) -> np.ndarray:
        """How many of `vowels` or `changes` each word has before its last `less` characters."""
        return of[self.begin + np.maximum(self.size - less, 0)] - of[self.begin]

    def last(self, k: int, of: np.ndarray, size: np.ndarray) -> np.ndarray:
        """data or v at the k-th character from the end of words cut to this size; that of shorter words has no meaning."""
        return of[np.maximum(self.begin + size - k, 0)]

    def cvc(self, size: np.ndarray) -> np.ndarray:
        return (size > 2) & ~self.last(1, self.v, size) & self.last(2, self.v, size) & ~self.last(3, self.v, size) & ~np.isin(self.last(1, self.data, size), list(b"wxy"))

    def put(self, words: np.ndarray, less: int, text: str) -> None:
        """text in place of the last `less` characters of these words."""
        at = self.begin[words] + self.size[words] - less
        for k, c in enumerate(text.encode()):
            self.data[at + k], self.v[at + k] = c, _VOWEL[c]  # no y is ever put
        self.size[words] += len(text) - less

    def array(self) -> pa.Array:
        within = np.arange(len(self.data)) - np.repeat(self.begin, self.came)
        at = np.append(0, np.cumsum(self.size)).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(self.size), [None, pa.py_buffer(at), pa.py_buffer(self.data[within < np.repeat(self.size, self.came)])])


_VOWEL = np.isin(np.arange(256), list(b"aeiou"))


def stems(words: pa.Array) -> pa.Array:
    """The stems of an array of lower-case words without nulls, as `stem` has them: a step is a few operations on all words."""
    if (pc.max(pc.binary_length(words)).as_py() or 0) < 3:
        return words.cast(pa.string())
    w = _Words(words)
    live = w.size > 2
    two = live & w.ends("sses", "ies")
    less = 2 * two + (live & ~two & w.ends("s") & ~w.ends("ss"))
    w.size -= less
    w.seen(np.flatnonzero(less), False)
    eed, ed, ing = (live & w.ends(e) for e in ("eed", "ed", "ing"))
    cut = np.where(ing, 3, np.where(ed, 2, 0))
    cut[eed | (w.count(w.vowels, cut) == 0)] = 0
    w.size -= (eed & (w.count(w.changes, 3) > 0)) + cut
    # vowels and counts of what is left are as they were
    a, b = w.last(1, w.data, w.size), w.last(2, w.data, w.size)
    longer = (w.size > 1) & np.isin(b.astype(np.int32) << 8 | a, [int.from_bytes(e, "big") for e in (b"at", b"bl", b"iz")])
    double = ~longer & (w.size > 1) & (a == b) & ~w.last(1, w.v, w.size)
    longer |= ~longer & ~double & (w.count(w.changes, 0) == 1) & w.cvc(w.size)
    w.size -= (cut > 0) & double & ~np.isin(a, list(b"lsz"))
    w.put(np.flatnonzero((cut > 0) & longer), 0, "e")
    w.seen(np.flatnonzero(eed | (cut > 0)))
    changed = np.flatnonzero(live & (w.size > 1) & w.ends("y") & (w.count(w.vowels, 1) > 0))
    w.put(changed, 1, "i")
    for endings, least in _STEPS:
        w.seen(changed, False)
        left, parts = live & (w.size > 2), []
        for e, to in endings:
            fits = np.flatnonzero(left & w.ends(e))
            left[fits] = False
            at = w.begin[fits]
            parts.append(fits[w.changes[at + w.size[fits] - len(e)] - w.changes[at] > least])
            w.put(parts[-1], len(e), to)
        changed = np.concatenate(parts)
    w.seen(changed, False)
    n, inner = w.count(w.changes, 1), w.size - 1
    # a blank after the stem makes it CVC when the stem ends in CV
    ends_cv = (inner > 1) & w.last(1, w.v, inner) & ~w.last(2, w.v, inner)
    less = live & w.ends("e") & ((n > 1) | ((n == 1) & ~ends_cv & ~w.cvc(inner)))
    w.size -= less
    w.seen(np.flatnonzero(less), False)
    w.size -= live & w.ends("ll") & (w.count(w.changes, 0) > 1)
    return w.array()


_KNOWN: dict[str, str] = {}


def stem_cached(word: str) -> str:
    found = _KNOWN.get(word)
    if found is None:
        if len(_KNOWN) > 500_000:
            _KNOWN.clear()
        found = _KNOWN[word] = stem(word)
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_tokens(tokens: pd.Series) -> pd.Series:
    """Arrays of lower-case tokens as arrays of stems: batches over Arrow, each distinct token worked out once per worker."""
    return tokens.map(lambda ws: None if ws is None else [stem_cached(w) for w in ws])


def mask_column(w: Column) -> Column:
    m = F.translate(F.regexp_replace(w, "[^aeiouy]", "C"), "aeiou", "VVVVV")
    m = F.regexp_replace(m, "^y", "C")
    for a, b in (("Vy", "VC"), ("yy", "VC"), ("y", "V")):
        m = F.regexp_replace(m, a, b)
    return m


def with_stem(words: DataFrame, word: str = "token", out: str = "stem") -> DataFrame:
    """words with a column of stems, JVM-side: one projection per step, so no step's expression repeats another's.

    Meant for distinct words: a step costs a few regular expressions.
    """
    w, m, n = F.col("_w"), F.col("_m"), F.length("_w")
    cut = lambda k: F.substring(w, 1, n - k)
    count = lambda k: F.regexp_count(F.substring(m, 1, n - k), F.lit("CV"))
    vowel = lambda k: F.substring(m, 1, n - k).contains("V")
    cvc = (n >= 3) & m.endswith("CVC") & ~F.substring(w, -1, 1).isin("w", "x", "y")
    double = (n >= 2) & (F.substring(w, -1, 1) == F.substring(w, -2, 1)) & m.endswith("C")
    df = words.withColumn("_w", F.col(word))

    def step(df: DataFrame, expr: Column) -> DataFrame:
        return df.withColumn("_m", mask_column(w)).withColumn("_w", expr)

    df = step(df, F.when(w.endswith("sses") | w.endswith("ies"), cut(2)).when(w.endswith("s") & ~w.endswith("ss"), cut(1)).otherwise(w))
    df = df.withColumn("_m", mask_column(w))
    ed, ing = w.endswith("ed") & ~w.endswith("eed") & vowel(2), w.endswith("ing") & vowel(3)
    df = df.withColumn("_cut", ed | ing).withColumn("_w", F.when(w.endswith("eed") & (count(3) > 0), cut(1)).when(ed, cut(2)).when(ing, cut(3)).otherwise(w))
    mended = F.when(~F.col("_cut"), w).when(w.endswith("at") | w.endswith("bl") | w.endswith("iz"), F.concat(w, F.lit("e")))
    df = step(df, mended.when(double, F.when(F.substring(w, -1, 1).isin("l", "s", "z"), w).otherwise(cut(1))).when((count(0) == 1) & cvc, F.concat(w, F.lit("e"))).otherwise(w)).drop("_cut")
    df = step(df, F.when((n > 1) & w.endswith("y") & vowel(1), F.concat(cut(1), F.lit("i"))).otherwise(w))
    for endings, least in _STEPS:
        expr = F.when(n < 3, w)
        for e, to in endings:
            expr = expr.when(w.endswith(e), F.when(count(len(e)) > least, F.concat(cut(len(e)), F.lit(to))).otherwise(w))
        df = step(df, expr.otherwise(w))
    inner, shorter = F.substring(m, 1, n - 1), cut(1)
    ends_cv = (n > 2) & inner.endswith("CV")
    inner_cvc = (n > 3) & inner.endswith("CVC") & ~F.substring(shorter, -1, 1).isin("w", "x", "y")
    df = step(df, F.when(w.endswith("e") & ((count(1) > 1) | ((count(1) == 1) & ~ends_cv & ~inner_cvc)), shorter).otherwise(w))
    df = step(df, F.when(w.endswith("ll") & (count(0) > 1), cut(1)).otherwise(w))
    return df.withColumn(out, F.when(F.length(word) <= 2, F.col(word)).otherwise(w)).drop("_w", "_m")
