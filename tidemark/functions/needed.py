"""What every match of a pattern holds, so that texts without it need no search."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import product
from re import _constants as K
from re import _parser

MOST = 64
#: letters that a pattern without case takes for i and s, but that lower() doesn't turn into them alone
ODD = re.compile("[İıſ]").search
_DIGIT = re.compile(r"\d").search

#: (all strings that match, if few; whether a match holds a digit; strings of which it holds one)
Node = tuple[frozenset[str] | None, bool, frozenset[str] | None]
NOTHING: Node = (None, False, None)
EMPTY: Node = (frozenset([""]), False, None)


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    if not b or "" in b:
        return a
    return b if a is None or (min(map(len, b)), -len(b)) > (min(map(len, a)), -len(a)) else a


def _row(items) -> Node:
    run, whole, digit, best = EMPTY[0], True, False, None
    for x in items:
        exact, d, held = _node(x)
        digit |= d
        best = _better(best, held)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = frozenset(a + b for a, b in product(run, exact))
            continue
        best = _better(best, run)
        whole, run = False, EMPTY[0] if exact is None else exact
    return (run if whole else None), digit, _better(best, run)


def _node(x) -> Node:
    op, arg = x
    if op is K.LITERAL:
        return (frozenset([chr(arg).lower()]), chr(arg).isdecimal(), None) if arg < 128 else NOTHING
    if op is K.IN:
        digit = all(o is K.CATEGORY and a is K.CATEGORY_DIGIT or o is K.LITERAL and 48 <= a <= 57 or o is K.RANGE and 48 <= a[0] and a[1] <= 57 for o, a in arg)
        plain = all(o is K.LITERAL and a < 128 for o, a in arg)
        return (frozenset(chr(a).lower() for _, a in arg) if plain else None), digit, None
    if op is K.BRANCH:
        all_ = [_row(r) for r in arg[1]]
        exact = None if any(e is None for e, _, _ in all_) else frozenset().union(*(e for e, _, _ in all_))
        held = [h for _, _, h in all_]
        return (exact if exact and len(exact) <= MOST else None), all(d for _, d, _ in all_), None if None in held else frozenset().union(*held)
    if op is K.SUBPATTERN:
        return _row(arg[3])
    if op is K.ATOMIC_GROUP:
        return _row(arg)
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        least, most, inner = arg
        exact, digit, held = _row(inner)
        if most == 1 and exact is not None:
            return (exact, digit, held) if least else (exact | {""}, False, None)
        return (None, digit, held) if least else NOTHING
    if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
        return EMPTY
    return NOTHING


def needed(pattern: str) -> tuple[bool, frozenset[str] | None]:
    """Whether every match holds a digit, and lower-case ASCII strings of which every match holds one, without case; None for none known."""
    _, digit, held = _row(_parser.parse(pattern))
    return digit, held


def sieve(patterns: list[str]) -> Callable[[str], list[bool]]:
    """For a text, which of the patterns may match it."""
    needs = [needed(p) for p in patterns]
    kinds = list(dict.fromkeys(needs))
    where = [kinds.index(n) for n in needs]
    every = [True] * len(patterns)

    def may(text: str) -> list[bool]:
        ascii_ = text.isascii()
        if not ascii_ and ODD(text):
            return every
        low = text.lower()
        digit = any(c in text for c in "0123456789") or not ascii_ and _DIGIT(text) is not None
        ok = [(digit or not d) and (held is None or any(x in low for x in held)) for d, held in kinds]
        return [ok[k] for k in where]

    return may
