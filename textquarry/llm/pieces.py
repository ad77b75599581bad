"""Texts as words of a BPE vocabulary, group by group: what the BPE operators share.

For a tokenizer of this kind (NFC, white space as one blank, lower case; runs of letters, single numbers and runs of
others as words; merges within a word) the ids of a text are those of its words in order. Texts of ASCII and common
Latin letters are cut where the class of a byte changes, many texts at once; in any other text, each chunk between white
space goes by the same rules or, if it holds other characters, through the library's own normalizer and pre-tokenizer.
A group of texts comes to its different words and, for each text, the numbers of its words among them.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from .common import words  # noqa: E402

#: Characters for which lower() and the classes below do what the library does: ASCII and the Latin letters up to U+017F but U+0130.
_LATIN = "À-ÖØ-öø-įı-ſ"
_PLAIN = re.compile(f"[\x00-\x7f{_LATIN}]*")
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+")
#: Classes of the bytes of lower-case plain text: white space, letter (all bytes of a Latin letter, too), digit, other.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[32, *range(9, 14)]] = _SPACE
_CLASS[[*range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


_OF_BYTE = byte_letters()
_SPELLING = dict(enumerate(_OF_BYTE))


def spell(word: bytes) -> str:
    """A word in byte letters."""
    text = word.decode("latin-1")
    return text if text.isascii() and text.isprintable() else text.translate(_SPELLING)  # a word has no blank


def cut(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of plain texts in one array, as bytes, and how many there are up to each text's end."""
    parts = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n\n\n", dtype=np.uint8)  # what follows a word can be asked for
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    kind = _CLASS[data]
    first = np.empty(len(data), dtype=bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= kind == _DIGIT
    full = kind != _SPACE
    first &= full
    # an apostrophe that begins a word takes one of its endings, and what follows begins anew
    at = np.flatnonzero(data == 39)
    at = at[first[at]]
    if len(at):
        a, b = data[at + 1], data[at + 2]
        two = (a == 115) | (a == 116) | (a == 109) | (a == 100)  # 's 't 'm 'd
        three = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)  # 're 've 'll
        for which, size in ((two, 2), (three, 3)):
            here = at[which]
            first[here + 1] = False
            first[here + size] = full[here + size]
    offsets = np.append(np.flatnonzero(first[full]), full.sum()).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[full])])
    return found, np.searchsorted(np.flatnonzero(first), ends)


class Splitter:
    """Chunks into words, spelled in byte letters; special tokens, matched in the raw text, are words of their own."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.marks = tuple({s[:2] for s in self.special})

    def __call__(self, chunk: str) -> list[str]:
        if any(m in chunk for m in self.marks) and self.at_special.search(chunk):
            return [w for part in self.at_special.split(chunk) if part for w in ([part] if part in self.special else self._plain(part))]
        return self._plain(chunk)

    def _plain(self, chunk: str) -> list[str]:
        if _PLAIN.fullmatch(chunk):
            return [spell(w.encode()) for w in _SPLIT.findall(chunk.lower())]
        t = self.tokenizer
        return [w for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(chunk))]

    def is_plain(self, text: str) -> bool:
        return (text.isascii() or _PLAIN.fullmatch(text) is not None) and not any(m in text for m in self.marks)

    def group(self, texts: list[str]) -> Group:
        plain = [k for k, t in enumerate(texts) if self.is_plain(t)]
        found, upto = cut([texts[k] for k in plain])
        coded = found.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(zero_copy_only=False), [spell(w) for w in coded.dictionary.to_pylist()]
        if len(plain) == len(texts):
            return Group(distinct, codes, upto)
        number = {w: k for k, w in enumerate(distinct)}
        of_text: list[np.ndarray] = [np.empty(0, dtype=np.int32)] * len(texts)
        for k, a, b in zip(plain, [0, *upto.tolist()], upto.tolist(), strict=False):
            of_text[k] = codes[a:b]
        known: dict[str, list[int]] = {}
        for k in set(range(len(texts))).difference(plain):
            numbers = []
            for chunk in words(texts[k]):
                if chunk not in known:
                    known[chunk] = [number.setdefault(w, len(number)) for w in self(chunk)]
                numbers += known[chunk]
            of_text[k] = np.array(numbers, dtype=np.int32)
        return Group(list(number), np.concatenate(of_text), np.cumsum([len(x) for x in of_text]))


@dataclass(frozen=True)
class Group:
    """Different words; the numbers of all words of all texts, in order; and how many there are up to each text's end."""

    words: list[str]
    codes: np.ndarray
    ends: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.codes, minlength=len(self.words))


class Encoder:
    """Ids of words by the vocabulary's own merges: the library's model without its normalizer and pre-tokenizer."""

    def __init__(self, splitter: Splitter):
        self.special, self.model = splitter.special, Tokenizer(splitter.tokenizer.model)

    def __call__(self, ws: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(ws), 4096):  # an encoding holds much more than its ids
            part = ws[i : i + 4096]
            made = self.model.encode_batch_fast(part, add_special_tokens=False)
            out += [e.ids if w not in self.special else [self.special[w]] for w, e in zip(part, made, strict=True)]
        return out


class Values:
    """A value for each word, from the last `most` of them or so; new ones are worked out by fill, many at a time."""

    def __init__(self, fill: Callable[[list[str]], list], most: int = 60_000):
        self.fill, self.most = fill, most
        self.known: dict[str, object] = {}

    def of(self, ws: list[str]) -> list:
        found = list(map(self.known.get, ws))
        new = [w for w, v in zip(ws, found, strict=True) if v is None]
        if new:
            made = iter(self.fill(new))
            found = [next(made) if v is None else v for v in found]
            if len(self.known) + len(new) > self.most:
                self.known = {}
            self.known.update(zip(ws[: self.most], found, strict=False))
        return found


def gathered(values: list[bytes], group: Group) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a group's texts in order, from each word's ids as little-endian bytes; and where each text's end is."""
    flat = np.frombuffer(b"".join(values), dtype="<u4")
    size = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
    begin = np.cumsum(size) - size
    of = size[group.codes]
    upto = np.concatenate([[0], np.cumsum(of)])
    return flat[np.repeat(begin[group.codes] - upto[:-1], of) + np.arange(upto[-1])], upto[group.ends]


def in_groups(texts: list[str], chars: int = 4_000_000):
    """Slices of texts of about so many characters."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group
