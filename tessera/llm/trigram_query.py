"""Boolean trigram queries of regular expressions.

A query is a tree: None (anything may match), a frozenset of trigrams that all must be there, ("and", parts) or
("or", parts).  It holds for every text with a match; texts and trigrams are lower-cased, which can only let more through.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as kinds  # the parse tree of Python's own regular expressions
from re import _parser as parser

#: Sets of strings grow to MOST_STRINGS, classes are spelt out up to MOST_CHARACTERS.
MOST_STRINGS, MOST_CHARACTERS = 64, 12

Query = None | frozenset | tuple


def trigrams(text: str) -> frozenset[str]:
    low = text.lower()
    return frozenset(low[i : i + 3] for i in range(len(low) - 2))


def all_of(parts: list[Query]) -> Query:
    """The query that all parts hold."""
    known = [p for p in parts if p is not None]
    sets = [p for p in known if isinstance(p, frozenset)]
    rest = list(dict.fromkeys(p for p in known if not isinstance(p, frozenset)))
    if sets:
        rest.insert(0, frozenset().union(*sets))
    return None if not rest else rest[0] if len(rest) == 1 else ("and", tuple(rest))


def any_of(parts: list[Query]) -> Query:
    """The query that one of the parts holds; sets that contain another part's set add nothing."""
    if not parts or any(p is None for p in parts):
        return None
    sets = {p for p in parts if isinstance(p, frozenset)}
    least = sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)
    rest = least + list(dict.fromkeys(p for p in parts if not isinstance(p, frozenset)))
    return rest[0] if len(rest) == 1 else ("or", tuple(rest))


def of_strings(strings: frozenset[str]) -> Query:
    """The query of texts that hold one of the strings."""
    return any_of([trigrams(s) or None for s in sorted(strings)])


@dataclass(frozen=True)
class Part:
    """What a piece of an expression can match: one of `strings` where these are known, and always something that query holds.

    What is not one of a few strings may still begin and end with one of `ends`.
    """

    strings: frozenset[str] | None
    query: Query = None
    ends: frozenset[str] = frozenset({""})

    def needed(self) -> Query:
        return self.query if self.strings is None else all_of([of_strings(self.strings), self.query])


ANYTHING = Part(None)


def _in_class(items: list) -> Part:
    found: set[str] = set()
    for kind, value in items:
        if kind is kinds.LITERAL:
            found.add(chr(value))
        elif kind is kinds.RANGE and value[1] - value[0] < MOST_CHARACTERS:
            found |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:  # negations, wide ranges and named classes
            return ANYTHING
    return Part(frozenset(found)) if len(found) <= MOST_CHARACTERS else ANYTHING


def _repeated(low: int, high: int, items: list) -> Part:
    part = _in_row(items)
    if low == 0:
        return Part(part.strings | {""}) if high == 1 and part.strings is not None else ANYTHING
    if part.strings is not None and len(part.strings) ** low <= MOST_STRINGS:
        out = frozenset({""})
        for _ in range(low):
            out = frozenset(a + b for a in out for b in part.strings)
        return Part(out, part.query) if low == high else Part(None, part.needed(), out)
    return Part(None, part.needed())


def _item(kind: object, value: object) -> Part:
    if kind is kinds.LITERAL:
        return Part(frozenset({chr(value)}))
    if kind is kinds.IN:
        return _in_class(value)
    if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
        return _repeated(*value)
    if kind is kinds.SUBPATTERN:
        return _in_row(value[3])
    if kind is kinds.ATOMIC_GROUP:
        return _in_row(value)
    if kind is kinds.BRANCH:
        parts = [_in_row(x) for x in value[1]]
        if all(p.strings is not None and p.query is None for p in parts):
            return Part(frozenset().union(*(p.strings for p in parts)))
        return Part(None, any_of([p.needed() for p in parts]))
    if kind in (kinds.AT, kinds.ASSERT, kinds.ASSERT_NOT):  # match no characters
        return Part(frozenset({""}))
    return ANYTHING


def _in_row(items: list) -> Part:
    """Strings of pieces in a row are joined as long as there are few; where that ends, what was joined must be there."""
    joined, queries, whole = frozenset({""}), [], True
    for kind, value in items:
        part = _item(kind, value)
        queries.append(part.query)
        if part.strings is None:
            before = joined if len(joined) * len(part.ends) > MOST_STRINGS else frozenset(a + b for a in joined for b in part.ends)
            queries += [part.needed(), of_strings(before)]
            joined, whole = part.ends, False
        elif len(joined) * len(part.strings) > MOST_STRINGS:
            queries.append(of_strings(joined))
            joined, whole = part.strings, False
        else:
            joined = frozenset(a + b for a in joined for b in part.strings)
    if whole and len(joined) <= MOST_STRINGS:
        return Part(joined, all_of(queries))
    return Part(None, all_of([*queries, of_strings(joined)]))


def pattern_query(pattern: str) -> Query:
    """The query of a pattern; None where it holds no mandatory trigram or is not understood."""
    try:
        return _in_row(list(parser.parse(pattern))).needed()
    except (parser.error, RecursionError):
        return None


def disjunctive(query: Query) -> list[frozenset]:
    """The query as clauses of which one must hold, each a set of trigrams; none where anything may match.

    A part that would make more than MOST_STRINGS clauses is left out, which can only let more through.
    """
    if query is None or isinstance(query, frozenset):
        return [query] if query else []
    parts = [disjunctive(p) for p in query[1]]
    if query[0] == "or":
        return list(dict.fromkeys(c for p in parts for c in p)) if all(parts) else []
    out: list[frozenset] = []
    for part in parts:
        if part and len(out or [0]) * len(part) <= MOST_STRINGS:
            out = [a | b for a in out for b in part] if out else part
    return out
