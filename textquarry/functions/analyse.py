"""Documents to postings in one pass: a task cuts, filters, stems and groups the tokens of many documents at once.

Tokens are found where bytes stop being [A-Za-z0-9]; the different ones of a slice are lowered, filtered and stemmed
once; one sort by term and document then gives every posting of the slice. All tokens of a document are in its row, so
nothing is shuffled. A slice holds SLICE bytes of text, or one document.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..sources.shared import limited, tidy
from .stem import stems
from .stopwords import DEFAULT

SLICE = 4 << 20
ROWS = "term string, doc_id long, tf int, positions array<int>, length int, title string"
_LOWER = np.zeros(256, dtype=np.uint8)
for _a, _b, _to in ((48, 58, 48), (65, 91, 97), (97, 123, 97)):
    _LOWER[_a:_b] = np.arange(_to, _to + _b - _a)


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All tokens of an array of texts in order, lower-case, and how many there are up to each text's end."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    low = _LOWER[np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.empty(0, dtype=np.uint8)
    bounds = (offsets - offsets[0]).astype(np.int64)
    full = low != 0
    first = full.copy()
    first[1:] &= ~full[:-1]
    begins = bounds[:-1][bounds[:-1] < len(low)]  # no token runs on into the next text
    first[begins] = full[begins]
    at = np.append(np.flatnonzero(first[full]), full.sum()).astype(np.int32)
    tokens = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(low[full])])
    return tokens, np.searchsorted(np.flatnonzero(first), bounds[1:])


class Terms:
    """Terms of tokens; stopwords and numbers of up to three digits have none. only: the terms that are asked for, if not all."""

    def __init__(self, stopwords: frozenset[str], only: frozenset[str] | None = None):
        self.stopwords, self.only = pa.array(sorted(stopwords), pa.string()), None if only is None else pa.array(sorted(only), pa.string())
        # no ending that the stemmer takes off or changes has the first letter in it
        self.begins = np.isin(np.arange(256), [ord(t[0]) for t in only if t]) if only is not None else np.ones(256, dtype=bool)

    def of(self, tokens: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The terms that are asked for or found, sorted; a number per token: its term's, their count if not asked for, -1 for none."""
        words = tokens.cast(pa.string())
        short = pc.and_(pc.less(pc.binary_length(words), 4), pc.ascii_is_decimal(words))
        kept = ~pc.or_(short, pc.is_in(words, value_set=self.stopwords)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(kept)
        if self.only is not None and len(at):
            first = np.frombuffer(tokens.buffers()[2], dtype=np.uint8)[np.frombuffer(tokens.buffers()[1], dtype=np.int32)[tokens.offset :][at]]
            at = at[self.begins[first]]
        found = stems(words.take(pa.array(at)))
        names = self.only if self.only is not None else (different := found.unique()).take(pc.sort_indices(different))
        out = np.where(kept, len(names), -1)
        out[at] = pc.index_in(found, value_set=names).fill_null(len(names)).to_numpy(zero_copy_only=False)
        return names, out


def postings_of(texts: pa.Array, doc_ids: pa.Array, titles: pa.Array, terms: Terms) -> pa.RecordBatch:
    """ROWS: the postings of these documents, in order of term and place of the document, then a row without a term for each document."""
    tokens, upto = cut(texts)
    coded = tokens.dictionary_encode()
    count = np.diff(upto, prepend=0)
    doc = np.repeat(np.arange(len(texts)), count)
    names, of_token = terms.of(coded.dictionary)
    term = of_token[coded.indices.to_numpy(zero_copy_only=False)] if len(tokens) else np.empty(0, dtype=np.int64)
    length = np.bincount(doc[term >= 0], minlength=len(texts)).astype(np.int32)
    kept = np.flatnonzero((term >= 0) & (term < len(names)))
    doc = doc[kept]
    position = kept - (upto - count)[doc]
    key = term[kept] * max(1, len(texts)) + doc
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, dtype=np.int64)
    ends = np.append(begin, len(key))
    of_doc = key[begin] % max(1, len(texts))
    none, n = len(texts), len(begin)
    lists = pa.ListArray.from_arrays(pa.array(np.append(ends, np.full(none, len(key))).astype(np.int32)), pa.array(position[order].astype(np.int32)))
    every = np.append(of_doc, np.arange(none))
    spelled = names.take(pa.array(key[begin] // max(1, len(texts))))
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([spelled, pa.nulls(none, pa.string())]), doc_ids.take(pa.array(every)), pa.array(np.append(np.diff(ends), np.zeros(none)).astype(np.int32)),
            lists, pa.array(length[every]), pa.concat_arrays([pa.nulls(n, pa.string()), titles]),
        ],
        ["term", "doc_id", "tf", "positions", "length", "title"],
    )


def analysed(corpus: DataFrame, stopwords: frozenset[str] = DEFAULT, only: frozenset[str] | None = None) -> DataFrame:
    """ROWS of corpus (doc_id, title, text), whose ids are different: its postings, and a row without a term for each document.

    A null text is empty: its document has length 0. only: the terms whose postings are wanted; lengths count all terms,
    but tokens that cannot become one of these are not stemmed, sorted or sent back. Workers get batches that are bounded
    in bytes.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(stopwords, only)
        for batch in batches:
            yield from _slices(batch, terms)
        tidy()

    return _columns(corpus).mapInArrow(work, ROWS)


def ranged(corpus: DataFrame, bounds: list[tuple[str, int]], stopwords: frozenset[str] = DEFAULT) -> DataFrame:
    """The postings of corpus (term, doc_id, tf, positions, length), and part: how many of the sorted bounds (term, doc_id) each has reached."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(stopwords)
        for batch in batches:
            for rows in _slices(batch, terms):
                lists = rows.slice(0, rows.num_rows - rows.column("term").null_count).select(["term", "doc_id", "tf", "positions", "length"])
                yield lists.append_column("part", pa.array(parts(lists.column("term"), lists.column("doc_id"), bounds)))
        tidy()

    return _columns(corpus).mapInArrow(work, "term string, doc_id long, tf int, positions array<int>, length int, part int")


def parts(terms: pa.Array, doc_ids: pa.Array, bounds: list[tuple[str, int]]) -> np.ndarray:
    """How many of the sorted bounds are at most (term, doc_id), of rows sorted by term: bounds are looked up in the terms."""
    coded = terms.dictionary_encode()
    names, of = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    high, low = (np.cumsum(np.bincount([f(names, t) for t, _ in bounds], minlength=len(names) + 1), dtype=np.int32) if bounds else np.zeros(len(names) + 1, dtype=np.int32) for f in (bisect_left, bisect_right))
    out = low[of] if len(of) else np.empty(0, dtype=np.int32)
    ids = doc_ids.to_numpy(zero_copy_only=False)
    divided = np.flatnonzero(high[: len(names)] > low[: len(names)]).astype(of.dtype)
    for k, begin, end in zip(divided, np.searchsorted(of, divided), np.searchsorted(of, divided, "right"), strict=True):
        out[begin:end] += np.searchsorted(np.array([d for _, d in bounds[low[k] : high[k]]]), ids[begin:end], "right").astype(np.int32)
    return out


def _columns(corpus: DataFrame) -> DataFrame:
    limited(corpus.sparkSession)
    return corpus.select(corpus["doc_id"].cast("long").alias("doc_id"), corpus["title"].cast("string").alias("title"), "text")


def _slices(batch: pa.RecordBatch, terms: Terms) -> Iterator[pa.RecordBatch]:
    """ROWS of a batch (doc_id, title, text), slice by slice."""
    texts = batch.column("text").cast(pa.string()).fill_null("")
    size = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + SLICE, "right")))
        part = slice(start, stop)
        yield postings_of(texts[part], batch.column("doc_id")[part], batch.column("title")[part], terms)
        start = stop
