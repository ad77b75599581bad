"""A minimal acyclic automaton of words with id sequences as outputs, in flat arrays that are memory-mapped.

Words are added in order and finished states are merged with equal ones (the incremental construction for sorted
input), so suffixes are shared. An edge carries how many words sort before its subtree; the sum along a word's path is
the word's number, and the number gives its run in the ids array. Lookups walk all words of a batch at once.
"""

from __future__ import annotations

import json
import struct

import numpy as np

MAGIC = b"TQLEXIC1"
_ARRAYS = ("keys", "targets", "skips", "final", "offsets", "ids")


def build(words: list[bytes], outputs: list[list[int]]) -> bytes:
    """The file of the automaton of words, sorted and distinct."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(final: bool, edges: list[tuple[int, int]]) -> int:
        key = (final, tuple(edges))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    open_ = [[False, []]]  # the path of the last word: [final, edges]; labels of open edges are the word's bytes
    last = b""
    for word in words:
        if word <= last and last:
            raise ValueError("words are not sorted and distinct")
        same = 0
        while same < len(last) and same < len(word) and last[same] == word[same]:
            same += 1
        for i in range(len(last), same, -1):
            final, edges = open_.pop()
            open_[-1][1].append((last[i - 1], settle(final, edges)))
        open_ += [[False, []] for _ in word[same:]]
        open_[-1][0] = True
        last = word
    for i in range(len(last), 0, -1):
        final, edges = open_.pop()
        open_[-1][1].append((last[i - 1], settle(final, edges)))
    start = settle(*open_[0])
    counts = [0] * len(states)  # targets are settled before their sources
    keys, targets, skips = [], [], []
    for s, (final, edges) in enumerate(states):
        n = int(final)
        for label, target in edges:
            keys.append(s * 256 + label)
            targets.append(target)
            skips.append(n)
            n += counts[target]
        counts[s] = n
    offsets = np.cumsum([0, *map(len, outputs)])
    arrays = {
        "keys": np.array(keys, "<i8"), "targets": np.array(targets, "<i4"), "skips": np.array(skips, "<i4"), "final": np.array([f for f, _ in states], "<u1"),
        "offsets": offsets.astype("<i8"), "ids": np.array([i for o in outputs for i in o], "<i4"),
    }
    head = json.dumps({"start": start, "arrays": {k: [a.dtype.str, len(a)] for k, a in arrays.items()}}).encode()
    out = bytearray(MAGIC + struct.pack("<I", len(head)) + head)
    for a in arrays.values():
        out += b"\0" * (-len(out) % 8) + a.tobytes()
    return bytes(out)


class Lexicon:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            if f.read(8) != MAGIC:
                raise ValueError(f"{path} is not a lexicon")
            head = json.loads(f.read(struct.unpack("<I", f.read(4))[0]))
            at = f.tell()
        self.start = head["start"]
        for name, (kind, n) in head["arrays"].items():
            at += -at % 8
            setattr(self, name, np.memmap(path, kind, "r", at, (n,)) if n else np.empty(0, kind))
            at += n * np.dtype(kind).itemsize

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, or -1."""
        n = len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        found = np.full(n, -1, dtype=np.int64)
        if not n or not len(self.keys):
            return found
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        live, state, number, k = np.flatnonzero(lengths > 0), None, None, 0
        state, number = np.full(len(live), self.start, dtype=np.int64), np.zeros(len(live), dtype=np.int64)
        while len(live):
            key = state * 256 + flat[begin[live] + k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            state, number = self.targets[at].astype(np.int64), number[ok] + self.skips[at]
            k += 1
            ended = lengths[live] == k
            hit = ended & (self.final[state] == 1)
            found[live[hit]] = number[hit]
            live, state, number = live[~ended], state[~ended], number[~ended]
        return found

    def outputs(self, number: int) -> list[int]:
        return self.ids[self.offsets[number] : self.offsets[number + 1]].tolist()
