"""Boolean trigram queries from regular expressions.

``clauses(pattern)`` gives the query in disjunctive form: a text can only match
if it holds, case aside, all trigrams of at least one clause. ``None`` means
that the pattern has no mandatory trigram, so that every text must be scanned.
"""

from __future__ import annotations

import re
from itertools import product

try:                                    # the standard library's own parser of its patterns
    from re import _constants as C
    from re import _parser as parser
except ImportError:                     # before Python 3.11
    import sre_constants as C
    import sre_parse as parser

LIMIT = 24                              # most alternatives that are followed one by one
Clauses = frozenset | None              # of frozensets of trigrams; None: no condition


def _grams(word: str) -> frozenset[str]:
    return frozenset(word[i:i + 3] for i in range(len(word) - 2))


def _either(queries: list[Clauses]) -> Clauses:
    if any(q is None for q in queries):
        return None
    every = frozenset().union(*queries)
    return frozenset(c for c in every if not any(d < c for d in every))     # a weaker clause suffices


def _both(a: Clauses, b: Clauses) -> Clauses:
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > LIMIT ** 2:
        return min(a, b, key=len)
    return _either([frozenset([x | y]) for x, y in product(a, b)])


def _of_words(words: set[str]) -> Clauses:
    """Some of the words must be there."""
    return _either([frozenset([_grams(w)]) if len(w) > 2 else None for w in words])


def _few(items) -> set[str] | None:
    """The characters of a set, lower-cased, if they are few."""
    found: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            found.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < 4:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return found if len(found) <= 6 else None


def _walk(sequence) -> tuple[set[str] | None, Clauses]:
    """(all words that the sequence can be, or None if not known, and its query)."""
    exact, words, query = True, {""}, None

    def flush():
        nonlocal exact, words, query
        query, words, exact = _both(query, _of_words(words)), {""}, False

    for op, value in sequence:
        more, inner = None, None
        if op is C.LITERAL:
            more = {chr(value).lower()}
        elif op is C.IN:
            more = _few(value)
        elif op is C.SUBPATTERN:
            more, inner = _walk(value[-1])
        elif op is C.BRANCH:
            parts = [_walk(p) for p in value[1]]
            if all(w is not None for w, _ in parts):
                more = set().union(*(w for w, _ in parts))
            else:
                inner = _either([_of_words(w) if w is not None else q for w, q in parts])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, getattr(C, "POSSESSIVE_REPEAT", None)):
            low, high, body = value
            more, inner = _walk(body)
            if more is not None and high == 1:
                more = more | {""} if low == 0 else more
            elif more is not None and low == high and len(more) ** low <= LIMIT:
                more = {"".join(p) for p in product(more, repeat=low)}
            else:
                inner = (_of_words(more) if more is not None else inner) if low else None
                more = None
        elif op in (C.AT, C.ASSERT_NOT):
            continue                    # takes no characters
        if more is not None and len(words) * len(more) <= LIMIT:
            words = {a + b for a, b in product(words, more)}
        else:
            if more is not None:
                inner = _of_words(more)
            flush()
            query = _both(query, inner)
    if exact:
        return words, None
    flush()
    return None, query


def clauses(pattern: str) -> list[list[str]] | None:
    """Clauses of trigrams, lower-cased; None if texts without any given trigram can match."""
    words, query = _walk(parser.parse(pattern, re.ASCII))
    query = _of_words(words) if words is not None else query
    return None if query is None else sorted(sorted(c) for c in query)
