"""The query language: blank-separated words, "phrases", infix AND and NOT, adjacency as OR. Driver-side only."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from ..functions.text import normalize_term


@dataclass(frozen=True)
class Term:
    term: str


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


@dataclass(frozen=True)
class Not:
    """What left finds and right does not; there is no complement of its own."""

    left: Node
    right: Node


Node = Term | Phrase | And | Or | Not
_PIECE = re.compile(r'"[^"]*"?|[^ "]+')


def lex(query: str) -> list[str]:
    """Pieces: quoted ones with both quotes (an open quote ends with the query), and words, which end at a blank or quote."""
    return [p if p[0] != '"' or (len(p) > 1 and p[-1] == '"') else p + '"' for p in _PIECE.findall(query)]


def atom(piece: str) -> Node:
    if len(piece) > 2 and piece[0] == '"':
        words = tuple(map(normalize_term, re.split(r"[ \t\n\v\f\r]+", piece[1:-1].strip(" \t\n\v\f\r")) if piece[1:-1].strip(" \t\n\v\f\r") else ()))
        return Term(words[0]) if len(words) == 1 else Phrase(words)
    return Term(normalize_term(piece))


def parse(query: str) -> Node | None:
    """The tree of a query, None for a blank one. NOT binds first, then AND, then OR, each from the left.

    The piece after an operator is always an operand, so is the first piece; an operator at the end has no effect.
    """
    pieces = lex(query)
    if not pieces:
        return None
    operands, between, i = [atom(pieces[0])], [], 1
    while i < len(pieces):
        joined = pieces[i] in ("AND", "NOT")
        if joined and i + 1 == len(pieces):
            break
        between.append({"AND": And, "NOT": Not}[pieces[i]] if joined else Or)
        i += joined
        operands.append(atom(pieces[i]))
        i += 1
    for kind in (Not, And, Or):
        kept, rest = [operands[0]], []
        for op, x in zip(between, operands[1:], strict=True):
            if op is kind:
                kept[-1] = kind(kept[-1], x)
            else:
                kept.append(x)
                rest.append(op)
        operands, between = kept, rest
    return operands[0]


def scoring_terms(node: Node) -> Counter[str]:
    """How often each term counts in the score: every occurrence, but nothing to the right of a NOT."""
    match node:
        case Term(t):
            return Counter([t])
        case Phrase(ts):
            return Counter(ts)
        case Not(left, _):
            return scoring_terms(left)
        case _:
            return scoring_terms(node.left) + scoring_terms(node.right)


def all_terms(node: Node) -> set[str]:
    match node:
        case Term(t):
            return {t}
        case Phrase(ts):
            return set(ts)
        case _:
            return all_terms(node.left) | all_terms(node.right)


def has_phrase(node: Node) -> bool:
    match node:
        case Term(_):
            return False
        case Phrase(_):
            return True
        case _:
            return has_phrase(node.left) or has_phrase(node.right)
